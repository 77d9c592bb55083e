"""Best-fit packing by a grouping genetic algorithm (operator 5).

Documents are tokenized once (end mark appended) and cut only where they exceed the capacity: into pieces
of exactly the capacity, of which the first may be shorter. Full pieces are sequences by themselves. The
others are dealt by hash into islands of about ``island_items`` pieces: one row each, so no island grows
with the input. On an island a small population of packings evolves. Crossover injects whole well-filled
bins of one parent into the other, removes the bins that hold a copy of an injected piece, and puts the
displaced pieces back by best fit, longest first. Between rounds every island's elite bins travel to the next island as
patterns of lengths, where they are rebuilt from local pieces and injected in the same way. After the last round only
bins filled to within ``slack`` tokens stay; the pieces of all others are pooled, dealt into fewer islands
and packed again, level by level, until one island is left. A level after which an eighth of the islands would not be saved keeps all its bins
and is the last: such pieces don't fill bins that well.

The text ``<|endoftext|>`` is that token, as in the tokenizer file. A null text is an empty document: one piece, the end mark
alone. Equal ids and repeated rows are pieces of their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import materialize

CAPACITY, END = 1024, 2
ISLAND_ITEMS, ROUNDS, POPULATION, OFFSPRING, ELITES, SLACK = 4096, 2, 4, 12, 24, 1
CACHE = 400_000
#: Special tokens of the tokenizer file (fixed values).
SPECIAL = {"<|endoftext|>": 50256}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; its folder is a parameter of the installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids, as little-endian 32-bit bytes, by the ranks of the byte-level BPE.

    Pre-tokens never cross a single space, so a text is the concatenation of its space-separated units, of
    which the frequent ones are kept (at most ``CACHE``). Unknown units of a block of texts are encoded in
    one call. Texts with two spaces in a row are encoded as a whole. Texts in ``special`` are single ids wherever they stand.
    """

    def __init__(self, path: str, pattern: str, special: dict[str, int] | None = None):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})
        self.plain, self.special = self.encoding.encode_ordinary, tuple(special or ())
        self.units: dict[str, bytes] = {}
        self.line = ranks[b"\n"]
        self.solid = re.compile(r"\S+").fullmatch

    def whole(self, text: str) -> bytes:
        ids = self.encoding.encode(text, allowed_special="all") if any(t in text for t in self.special) else self.plain(text)
        return np.array(ids, np.uint32).tobytes()

    def _learn(self, new: list[str]) -> None:
        if len(self.units) + len(new) > CACHE:
            self.units.clear()
        solid = [u for u in new if self.solid(u)]
        ids = np.array(self.plain("\n " + "\n ".join(solid)) if solid else [], np.uint32)
        cuts = np.flatnonzero(ids == self.line)
        if solid and len(cuts) == len(solid):
            raw = ids.tobytes()
            ends = [*(4 * cuts[1:]).tolist(), len(raw)]
            self.units.update((u, raw[a:b]) for u, a, b in zip(solid, (4 * cuts + 4).tolist(), ends, strict=True))
        for u in new:
            if u not in self.units:
                self.units[u] = self.whole(" " + u)

    def block(self, texts: list[str]) -> list[bytes]:
        out, todo = [], []
        get = self.units.get
        for text in texts:
            if "  " in text or any(t in text for t in self.special):
                out.append(self.whole(text))
                continue
            units = text.split(" ")
            values = list(map(get, units))
            values[0] = self.whole(units[0]) if units[0] else b""
            at = values.index(None) if None in values else -1
            if at >= 0:
                miss = [i for i in range(at, len(values)) if values[i] is None]
                todo.append((len(out), values, units, miss))
                out.append(b"")
            else:
                out.append(b"".join(values))
        if todo:
            self._learn(list({units[i]: 0 for _, _, units, miss in todo for i in miss}))
            get = self.units.__getitem__
            for k, values, units, miss in todo:
                for i in miss:
                    values[i] = get(units[i])
                out[k] = b"".join(values)
        return out


def _cut(path: str, pattern: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, mark = Encoder(path, pattern, SPECIAL), np.array([end], np.uint32).tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                doc, piece, start, length, crc = [], [], [], [], []
                for i, raw in zip(part.column(0).to_pylist(), encoder.block([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    raw += mark
                    n = len(raw) // 4
                    at = 0
                    size = n % capacity or min(n, capacity)
                    k = 0
                    while at < n:
                        doc.append(i), piece.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                        at, k, size = at + size, k + 1, capacity
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document (doc_id, text)."""
    import public_tokenizers

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_cut(vocabulary(vocab), public_tokenizers.PATTERN, capacity, end), PIECES)


# --------------------------------------------------------------------------- one island


class Bins:
    """A packing under construction: bins of item numbers, and the open bins by free room."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some bin has r tokens free

    def add(self, items: list[int], free: int) -> None:
        self.bins.append(items)
        self.free.append(free)
        self._open(len(self.bins) - 1)

    def _open(self, b: int) -> None:
        r = self.free[b]
        if r:
            self.by_room[r].append(b)
            self.rooms |= 1 << r

    def best_fit(self, item: int) -> None:
        size = self.sizes[item]
        fitting = self.rooms >> size
        if not fitting:
            self.add([item], self.capacity - size)
            return
        r = size + (fitting & -fitting).bit_length() - 1
        here = self.by_room[r]
        b = here.pop()
        if not here:
            self.rooms &= ~(1 << r)
        self.bins[b] = [*self.bins[b], item]
        self.free[b] = r - size
        self._open(b)


def _pack(order: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    p = Bins(sizes, capacity)
    for i in order:
        p.best_fit(i)
    return p.bins


def _fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenness: full bins leave more usable room in the others."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def _inject(bins: list[list[int]], new: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Whole bins ``new`` go in, bins that hold any of their items go out, displaced items are best-fitted."""
    taken = {i for b in new for i in b}
    p = Bins(sizes, capacity)
    displaced = []
    for b in bins:
        if taken.isdisjoint(b):
            p.add(b, capacity - sum(sizes[i] for i in b))
        else:
            displaced += [i for i in b if i not in taken]
    for b in new:
        p.add(b, capacity - sum(sizes[i] for i in b))
    for i in sorted(displaced, key=lambda i: -sizes[i]):
        p.best_fit(i)
    return p.bins


def _rebuild(patterns: list[list[int]], sizes: list[int]) -> list[list[int]]:
    """Bins of local items for patterns of lengths that came from another island, as far as items suffice."""
    stock: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        stock.setdefault(s, []).append(i)
    out = []
    for pattern in patterns:
        picked = []
        for s in pattern:
            if not stock.get(s):
                break
            picked.append(stock[s].pop())
        if len(picked) == len(pattern):
            out.append(picked)
        else:
            for i in picked:
                stock[sizes[i]].append(i)
    return out


def evolve(sizes: list[int], population: list[list[list[int]]], patterns: list[list[int]], capacity: int, seed: int, offspring: int = OFFSPRING) -> list[list[list[int]]]:
    """A round on one island; returns the population, best first."""
    rng = random.Random(seed)
    n = len(sizes)
    if not population:
        down = sorted(range(n), key=lambda i: -sizes[i])
        population = [_pack(down, sizes, capacity)]
        for _ in range(POPULATION - 1):
            population.append(_pack(sorted(range(n), key=lambda i: -sizes[i] * rng.uniform(0.8, 1.0)), sizes, capacity))
    scored = sorted(((_fitness(p, sizes, capacity), p) for p in population), key=lambda x: x[0], reverse=True)
    if patterns:
        child = _inject(scored[0][1], _rebuild(patterns, sizes), sizes, capacity)
        scored = sorted([*scored, (_fitness(child, sizes, capacity), child)], key=lambda x: x[0], reverse=True)[:POPULATION]
    least = -(-sum(sizes) // capacity)
    for _ in range(offspring if n > 2 else 0):
        if -scored[0][0][0] <= least:
            break  # no packing has fewer bins
        a, b = rng.sample(range(len(scored)), 2) if len(scored) > 1 else (0, 0)
        full = [x for x in scored[b][1] if sum(sizes[i] for i in x) >= capacity - SLACK]
        if not full:
            continue
        new = rng.sample(full, max(1, min(len(full), len(full) * rng.randint(5, 30) // 100)))
        child = _inject(scored[a][1], new, sizes, capacity)
        scored = sorted([*scored, (_fitness(child, sizes, capacity), child)], key=lambda x: x[0], reverse=True)[:POPULATION]
    return [p for _, p in scored]


def _freeze(population: list[list[list[int]]], n: int) -> list[bytes]:
    out = []
    for bins in population:
        of = np.zeros(n, np.int32)
        for k, b in enumerate(bins):
            of[b] = k
        out.append(of.tobytes())
    return out


def _thaw(raw: bytes) -> list[list[int]]:
    of = np.frombuffer(raw, np.int32)
    bins: list[list[int]] = [[] for _ in range(int(of.max()) + 1 if len(of) else 0)]
    for i, b in enumerate(of.tolist()):
        bins[b].append(i)
    return bins


def _elite(bins: list[list[int]], sizes: list[int], capacity: int) -> bytes:
    """Patterns of the fullest bins, those of long pieces first; a 0 ends each."""
    best = sorted(bins, key=lambda b: (-sum(sizes[i] for i in b), len(b)))[:ELITES]
    return np.array([x for b in best if sum(sizes[i] for i in b) >= capacity - SLACK for x in (*sorted((sizes[i] for i in b), reverse=True), 0)], np.int32).tobytes()


def _patterns(raw: bytes | None) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for x in np.frombuffer(raw or b"", np.int32).tolist():
        out[-1].append(x) if x else out.append([])
    return out[:-1]


def _round(capacity: int, offspring: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                island, length, frozen, guests = (row.column(c)[0].as_py() for c in ("island", "length", "population", "guests"))
                population = evolve(length, [_thaw(x) for x in frozen or []], _patterns(guests), capacity, seed=island, offspring=offspring)
                yield pa.RecordBatch.from_arrays(
                    [row.column("island"), row.column("item"), row.column("length"), pa.array([_freeze(population, len(length))], pa.list_(pa.binary())), pa.array([_elite(population[0], length, capacity)], pa.binary())],
                    names=["island", "item", "length", "population", "elite"],
                )

    return run


def _settle(capacity: int, slack: int):
    """Each item with its bin; bin -1: the bin is not full enough and the item is to be packed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                island, items, length, frozen = (batch.column(c)[k].as_py() for c in ("island", "item", "length", "population"))
                item, bin_, offset = [], [], []
                for b, members in enumerate(_thaw(frozen[0])):
                    full = sum(length[i] for i in members) >= capacity - slack
                    at = 0
                    for i in members:
                        item.append(items[i]), bin_.append(b if full else -1), offset.append(at)
                        at += length[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item, pa.int64()), pa.array([island] * len(item), pa.int32()), pa.array(bin_, pa.int32()), pa.array(offset, pa.int64())], names=["item", "island", "bin", "offset"]
                )

    return run


# --------------------------------------------------------------------------- islands on Spark


def _level(items: DataFrame, islands: int, capacity: int, rounds: int, offspring: int, slack: int) -> DataFrame:
    """Items (item, length) packed on ``islands`` islands: (item, island, bin, offset)."""
    at = F.pmod(F.xxhash64("item", F.lit(islands)), F.lit(islands)).cast("int")
    packed = F.sort_array(F.collect_list(F.struct(F.col("length").cast("int").alias("length"), "item")), asc=False)  # bounded: the hash deals items evenly
    state = items.groupBy(at.alias("island")).agg(packed.alias("x"))
    state = state.select("island", F.col("x.item").alias("item"), F.col("x.length").alias("length"), F.lit(None).cast("array<binary>").alias("population"), F.lit(None).cast("binary").alias("guests"))
    state = state.repartition("island")
    schema = "island int, item array<long>, length array<int>, population array<binary>, elite binary"
    for r in range(rounds):
        state = materialize(state.mapInArrow(_round(capacity, offspring), schema), "packing-islands")
        if r + 1 < rounds:
            moved = state.select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guests"))
            state = state.drop("elite").join(moved, "island", "left")
    return materialize(state.mapInArrow(_settle(capacity, slack), "item long, island int, bin int, offset long"), "packing-settled")


def _larger(island_items: int, left: int, islands: int) -> int:
    """Pieces of an island of the next level."""
    island_items = max(island_items, -(-left // max(1, islands // 4)))  # a quarter of the islands at most
    return min(island_items, 4 * ISLAND_ITEMS) if island_items > ISLAND_ITEMS else island_items


def pack(docs: DataFrame, capacity: int = CAPACITY, island_items: int = ISLAND_ITEMS, rounds: int = ROUNDS, offspring: int = OFFSPRING, slack: int = SLACK, **tokens) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    pieces = materialize(token_pieces(docs, capacity, **tokens).withColumn("item", F.monotonically_increasing_id()), "packing-pieces")
    left = pieces.where(F.col("length") < capacity).select("item", "length")
    done, base = [], 0
    while n := left.count():
        islands = -(-n // island_items)
        settled = _level(left, islands, capacity, rounds, offspring, slack if islands > 1 else capacity)
        open_ = settled.where("bin < 0").count()
        larger = _larger(island_items, open_, islands)
        if islands > 1 and 8 * -(-open_ // larger) >= 7 * islands:
            settled = _level(left, islands, capacity, rounds, offspring, capacity)
            islands = 1
        # sequences of earlier levels come first; a bin has an item at least, so numbers don't meet
        number = F.lit(base) + F.col("island").cast("long") * (2 * n) + F.col("bin")
        done.append(settled.where("bin >= 0").select("item", number.alias("sequence_id"), "offset"))
        if islands == 1:
            break
        base += islands * 2 * n
        again = settled.where("bin < 0").select("item")
        left = materialize(left.join(again, "item"), "packing-left")
        island_items = larger
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    out = full.drop("item")
    if done:
        placed = done[0]
        for x in done[1:]:
            placed = placed.unionByName(x)
        out = pieces.where(F.col("length") < capacity).join(placed, "item").drop("item").unionByName(out)
    return out
