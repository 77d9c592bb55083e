"""N-gram Jaccard join by prefix trees (operator 3).

Every document becomes the set of its distinct word n-grams (64-bit hashes). The join runs in four Spark steps:

1. One pass over the texts gives, per document, its set's size and a 128-bit key of the set, and
   pigeonhole keys: two sets that reach the threshold differ in at most d elements, so when the hash
   range is cut into d + 1 segments, one segment holds the same elements in both. Sizes are treated in
   bands, and a set near the lower edge of its band also emits the keys of the band below.
2. Equal sets are one class from here on. Classes that share a key are joined into candidate clusters
   (aggregates and joins over keys only); classes without a partner never move again.
3. Each cluster's sets go to one task, once, and are joined there with a compressed prefix tree over the n-grams in
   a global order, the most frequent of the cluster first: sets that share a prefix share its nodes, and a batch of probing sets
   walks the tree level by level, so an overlap is counted once for all sets below a node. A subtree is left as soon as the
   remaining lengths of both sides cannot reach the threshold, when all sets below are linked with the probing set
   already, or when all have probed. A cluster above ``block_sets`` sets or ``block_ngrams`` n-grams is dealt into blocks
   that each join with themselves and with some ``ANCHORS`` sets that all blocks hold; what these link is one component mostly. Only
   the sets outside of the cluster's largest component then meet the cluster's other blocks. So no task's work is
   unbounded, and copies of one text cost their own number, not its square.
4. Links (a forest, not all pairs) become components; a component's id is its smallest doc_id.

Nulls and texts without words have an empty set, which links with nothing (component: their own id).
Rows with the same doc_id are rows of their own with one id; rows without an id link with nothing. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import LOWER, U, across_tasks, connected_components, in_blocks, materialize, mix, small_side, span_hashes, text_blocks, within_tasks, word_spans

BLOCK_SETS, BLOCK_NGRAMS, ANCHORS = 4096, 1_000_000, 32
#: Ranks of a tree node at most, and cells that a batch of probes may look at in one level.
STRIDE, BATCH_CELLS = 64, 4_000_000
#: Cells of a segment of the prepass filter, cells that are broadcast at most (128 MB of bits), bytes of text whose cells a task holds.
SEGMENT, MOST_CELLS, HELD_BYTES = 1 << 20, 1 << 30, 24 << 20


# --------------------------------------------------------------------------- sets


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each row of a text block; A-Z is folded to a-z."""
    data = LOWER[data]
    starts, ends, row = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    grams = np.zeros(max(0, len(h) - n + 1), U)
    for k in range(n):
        grams += h[k : k + len(grams)] * (U(2) * mix(np.array([k + 1], U)) + U(1)) if len(grams) else U(0)
        grams = (grams << U(23)) | (grams >> U(41))
    grams = mix(grams)
    out = []
    for a, c in zip(first.tolist(), count.tolist(), strict=True):
        if c >= n:
            out.append(np.unique(grams[a : a + c - n + 1]))
        elif c:
            short = np.array([c + 1000], U)
            for k in range(c):
                short = mix(short + h[a + k])
            out.append(short)
        else:
            out.append(np.zeros(0, U))
    return out


# --------------------------------------------------------------------------- pigeonhole keys


class Bands:
    """Size bands and the number of segments of each, for Jaccard at least num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1, 2]
        self.cut: dict[int, tuple[int, int]] = {}

    def _grow(self, size: int) -> None:
        t = self.num / self.den
        while self.low[-1] <= size:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] / t**3)))

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(band, segments, spare segments) in which a set of this size takes part."""
        self._grow(size)
        b = int(np.searchsorted(self.low, size, "right")) - 1
        bands = [b]
        if b and size * self.num <= (self.low[b] - 1) * self.den:
            bands.append(b - 1)
        return [(x, *self.segments(x)) for x in bands]

    def segments(self, band: int) -> tuple[int, int]:
        """(segments, spare): with ``spare`` more segments than differences demand, a set with no more empty segments
        than that shares a segment that is not empty. Spare is chosen so that hardly any set has more."""
        if band not in self.cut:
            small = self.low[band + 1] - 1
            both = small + small * self.den // self.num
            least = both * (self.den - self.num) // (self.den + self.num) + 1
            best = (2.0, 0)
            for spare in range(60 if least > 1 else 0):
                mean = (least + spare) * math.exp(-self.low[band] / (least + spare))
                term, below = math.exp(-mean), 0.0
                for k in range(spare + 1):
                    below, term = below + term, term * mean / (k + 1)
                best = min(best, (max(1 - below, 1e-6), spare))
                if best[0] <= 1e-6:
                    break
            self.cut[band] = (least + best[1], best[1])
        return self.cut[band]


def segment_keys(sets: list[np.ndarray], bands: Bands) -> list[np.ndarray]:
    """Keys of each set; sets that reach the threshold share one at least."""
    out = []
    for s in sets:
        keys = []
        for band, m, spare in bands.of(len(s)) if len(s) else []:
            if m == 1:
                continue  # nothing but an equal set can link
            at = ((s >> U(32)) * U(m)) >> U(32)
            edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            used = at[edge]
            sums = np.add.reduceat(mix(s), edge)
            if m - len(used) > spare:  # this set's empty segments count, too
                full = np.zeros(m, U)
                full[used.astype(np.int64)] = sums
                used, sums = np.arange(m, dtype=U), full
            keys.append(mix(sums + mix(used * U(1_000_003) + U(band * 7919 + 1))))
        out.append(np.concatenate(keys) if keys else np.zeros(0, U))
    return out


def set_key(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that equal sets share."""
    return mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U), mix(s + U(0x14057B7EF767814F)).sum(dtype=U)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    lens = np.array([0, *(len(x) for x in arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, U)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(lens), pa.int32()), pa.array(flat.view(np.int64)))


def _cells(grams: np.ndarray, cells: int) -> np.ndarray:
    return (grams % U(cells)).astype(np.int64)


def repeated_cells(texts: DataFrame, n: int, cells: int) -> np.ndarray:
    """Bits of a Bloom filter's cells that n-grams of two documents or more fall into (or of two n-grams). ``cells`` is a multiple of ``SEGMENT``.

    Tasks count the cells of their documents' sets; a segment's counts are merged by one aggregate. The bits take cells / 8 bytes.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in itertools.chain(text_blocks(batches), [None]):
            if block is not None:
                held += [_cells(s, cells) for s in ngram_sets(block[1], block[2], n)]
                size = size + len(block[1])
            if held and (block is None or size >= HELD_BYTES):
                at, counts = np.unique(np.concatenate(held), return_counts=True)
                held, size = [], 0
                if not len(at):
                    continue  # no text with a word
                of = at // SEGMENT
                cut = np.flatnonzero(np.diff(of, prepend=-1))
                ends = [*cut[1:], len(at)]
                counts = np.minimum(counts, 2).astype(np.uint8)
                # places as differences: small numbers, which compress
                steps = [np.diff(at[x:y] % SEGMENT, prepend=0).astype(np.uint32).tobytes() for x, y in zip(cut, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(of[cut]), pa.array(steps, pa.binary()), pa.array([counts[x:y].tobytes() for x, y in zip(cut, ends, strict=True)], pa.binary())], names=["segment", "steps", "counts"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SEGMENT, np.uint32)
        for steps, counts in zip(rows["steps"], rows["counts"], strict=True):
            total[np.cumsum(np.frombuffer(steps, np.uint32))] += np.frombuffer(counts, np.uint8)
        return pd.DataFrame({"segment": [int(rows["segment"].iloc[0])], "bits": [np.packbits(total >= 2).tobytes()]})

    sketches = texts.select("text").mapInArrow(sketch, "segment long, steps binary, counts binary")
    merged = materialize(sketches.groupBy("segment").applyInPandas(merge, "segment long, bits binary"), "ngram-cells")
    out = np.zeros((cells // SEGMENT, SEGMENT // 8), np.uint8)
    for r in merged.toLocalIterator():
        out[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def may_link(sets: list[np.ndarray], bits: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether each set can link with a different one: a linked set lacks no more than size - num / den x size of another's n-grams, and those in cells that
    no second document touches are in no other set."""
    cells = 8 * len(bits)
    alone = np.array([int((((bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1) == 0).sum()) for c in (_cells(s, cells) for s in sets)], np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    return alone <= size - -(-num * size // den)


def _profiles(n: int, num: int, den: int, repeated=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for rows, data, offsets in text_blocks(batches):
            sets = ngram_sets(data, offsets, n)
            hi, lo = np.array([set_key(s) for s in sets], U).reshape(-1, 2).T
            asked = sets
            if repeated is not None:
                none = np.zeros(0, U)
                asked = [s if may else none for s, may in zip(sets, may_link(sets, repeated.value, num, den), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.ascontiguousarray(hi).view(np.int64)), pa.array(np.ascontiguousarray(lo).view(np.int64)), _lists(segment_keys(asked, bands))],
                names=["doc_id", "n_shingles", "hi", "lo", "keys"],
            )

    return run


# --------------------------------------------------------------------------- prefix tree


class PrefixTree:
    """Compressed trie of rank arrays, in flat arrays that a batch of probes walks level by level.

    In sorted order the sets below a node are neighbours: a node is a range of them, a slice of ranks (``STRIDE`` at most,
    so that long tails are left early), the depth behind it, and the least size and greatest length below.
    ``ranks``: ascending places in the global order; ``sizes``: the sets' sizes, which may count more than the ranks.
    """

    def __init__(self, ranks: list[np.ndarray], sizes: np.ndarray):
        keys = [r.astype(">u4").tobytes() for r in ranks]
        self.order = np.array(sorted(range(len(ranks)), key=keys.__getitem__), np.int64)
        inside = [ranks[i] for i in self.order]
        self.size, length = sizes[self.order], np.array([len(r) for r in inside], np.int64)
        common = np.zeros(len(inside), np.int64)  # ranks at the start that a set shares with the one before
        for k in range(1, len(inside)):
            m = min(length[k - 1], length[k])
            differ = np.flatnonzero(inside[k - 1][:m] != inside[k][:m])
            common[k] = differ[0] if len(differ) else m

        def cut(low: int, high: int, depth: int) -> list[tuple[int, int, int]]:
            edges = [low, *(np.flatnonzero(common[low + 1 : high] <= depth) + low + 1).tolist(), high]
            return [(a, b, depth) for a, b in zip(edges, edges[1:], strict=False)] if low < high else []

        nodes, slices, level = [], [], cut(0, len(inside), 0)
        self.roots = len(level)
        while level:  # breadth first, so that the children of a node are neighbours
            below = []
            for low, high, depth in level:
                stop = min(int(length[low]), int(common[low + 1 : high].min(initial=length[low])), depth + STRIDE)
                ended = low + int(np.searchsorted(length[low:high] > stop, True)) if length[low] == stop else low
                parts = cut(ended, high, stop)
                nodes.append((low, high, ended, stop, self.size[low:high].min(), length[low:high].max(), len(parts)))
                slices.append(inside[low][depth:stop])
                below += parts
            level = below
        self.low, self.high, self.ended, self.depth, self.least, self.longest, self.kids = np.array(nodes, np.int64).reshape(-1, 7).T
        self.kid = self.roots + np.cumsum(self.kids) - self.kids
        self.wide = np.array([len(s) for s in slices], np.int64)
        self.at = np.cumsum(self.wide) - self.wide
        self.flat = np.concatenate(slices).astype(np.int64) if slices else np.zeros(0, np.int64)

    def walk(self, probes: list[np.ndarray], sizes: np.ndarray, vocabulary: int, num: int, den: int, skip) -> tuple[np.ndarray, np.ndarray]:
        """(probe, set) numbers of the pairs of Jaccard at least num/den; ``skip(probe, low, high)`` tells which ranges needn't be visited."""
        holds = np.zeros((len(probes), vocabulary + 1), bool)
        for k, r in enumerate(probes):
            holds[k, r] = True
        passed = np.cumsum(holds, axis=1, dtype=np.int32)
        known, holds, width = passed[:, -1].astype(np.int64), holds.ravel(), vocabulary + 1
        probe, node = np.repeat(np.arange(len(probes)), self.roots), np.tile(np.arange(self.roots), len(probes))
        overlap = np.zeros(len(probe), np.int64)
        found = []
        while len(node):
            stay = ~skip(probe, self.low[node], self.high[node])
            probe, node, overlap = probe[stay], node[stay], overlap[stay]
            wide = self.wide[node]
            used = np.flatnonzero(wide)
            if len(used):
                w = wide[used]
                begin = np.cumsum(w) - w
                place = np.arange(int(w.sum())) + np.repeat(self.at[node[used]] - begin, w)
                ranks = self.flat[place]
                overlap[used] += np.add.reduceat(holds[np.repeat(probe[used] * width, w) + ranks], begin, dtype=np.int64)
                left = known[probe[used]] - passed[probe[used], ranks[begin + w - 1]]
                most = overlap[used] + np.minimum(left, (self.longest - self.depth)[node[used]])
                fits = np.ones(len(node), bool)
                fits[used] = most * (num + den) >= num * (sizes[probe[used]] + self.least[node[used]])
                probe, node, overlap = probe[fits], node[fits], overlap[fits]
            n = (self.ended - self.low)[node]
            here = np.repeat(np.arange(len(node)), n)
            which = np.arange(len(here)) + np.repeat(self.low[node] - (np.cumsum(n) - n), n)
            good = overlap[here] * (num + den) >= num * (sizes[probe[here]] + self.size[which])
            found.append((probe[here[good]], self.order[which[good]]))
            n = self.kids[node]
            here = np.repeat(np.arange(len(node)), n)
            node = np.arange(len(here)) + np.repeat(self.kid[node] - (np.cumsum(n) - n), n)
            probe, overlap = probe[here], overlap[here]
        a, b = zip(*found, strict=True) if found else ((np.zeros(0, np.int64),), (np.zeros(0, np.int64),))
        return np.concatenate(a), np.concatenate(b)


def global_order(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Each set as ascending ranks of those of its n-grams that another set holds, too (no other is ever in an overlap),
    the most frequent first, so that paths are shared; and the number of ranks."""
    size = np.array([len(s) for s in sets])
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    n = int((count > 1).sum())
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    kept, rank = count[which] > 1, rank[which]
    row = np.repeat(np.arange(len(sets)), size)[kept]
    by = np.lexsort((rank[kept], row))
    return np.split(rank[kept][by], np.cumsum(np.bincount(row, minlength=len(sets)))[:-1]), n


def join_group(sets: list[np.ndarray], stored: np.ndarray, label: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of set numbers that connect what links between ``stored`` sets and all sets connect. ``label``: numbers of
    what is connected already; pairs within one are not looked for."""
    sizes, label = np.array([len(s) for s in sets], np.int64), label.copy()
    ranks, vocabulary = global_order(sets)
    inside = np.flatnonzero(stored)
    tree = PrefixTree([ranks[i] for i in inside], sizes[inside])
    numbers = inside[tree.order]  # of the sets in the tree, in its order
    place = np.full(len(sets), -1)
    place[numbers] = np.arange(len(numbers))
    done = np.zeros(len(numbers), bool)
    # probes in the tree's order: what has probed already is a range and isn't visited again
    todo = np.concatenate([numbers, np.flatnonzero(~stored)])
    widest = max(1, vocabulary, int(len(tree.flat)))
    edges, a, batch = [], 0, 1
    while a < len(todo):
        some = todo[a : a + batch]
        own = label[numbers]
        change = np.concatenate(([0], np.cumsum(own[1:] != own[:-1])))
        probed = np.concatenate(([0], np.cumsum(done)))
        mine, inner = label[some], place[some] >= 0

        def skip(probe, low, high):
            same = (change[high - 1] == change[low]) & (own[low] == mine[probe])
            return same | (inner[probe] & (probed[high] - probed[low] == high - low))

        p, s = tree.walk([ranks[i] for i in some], sizes[some], vocabulary, num, den, skip)
        s = inside[s]
        for k in np.unique(p).tolist():
            i = int(some[k])
            other = s[p == k]
            new, at = np.unique(label[other], return_index=True)
            for j in other[at[new != label[i]]].tolist():
                edges.append((i, j))
                label[label == label[j]] = label[i]
        here = place[some]
        done[here[here >= 0]] = True
        a += batch
        batch = max(1, min(2 * batch, BATCH_CELLS // widest))
    return edges


def _tree_join(n: int, num: int, den: int):
    """Rows (cluster, task, stored, rep, lo, label, text), sorted by cluster and task -> (src, dst) that connect what its links connect."""

    def links(group: list[tuple[bool, int, int, np.ndarray]]) -> pa.RecordBatch:
        stored, reps, labels, sets = zip(*group, strict=True)
        stored = np.array(stored)
        pairs = join_group(list(sets), stored, np.unique(labels, return_inverse=True)[1], num, den) if stored.any() else []
        return pa.RecordBatch.from_arrays([pa.array([reps[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for rows, data, offsets in text_blocks(batches):
            sets = ngram_sets(data, offsets, n)
            for c, t, stored, rep, lo, label, s in zip(*(rows.column(k).to_pylist() for k in ("cluster", "task", "stored", "rep", "lo", "label")), sets, strict=True):
                if not len(s) or set_key(s)[1] != U(lo & 0xFFFFFFFFFFFFFFFF):
                    continue  # another row with the same doc_id
                if (c, t) != key:
                    if len(group) > 1:
                        yield links(group)
                    key, group = (c, t), []
                group.append((stored, rep, label, s))
        if len(group) > 1:
            yield links(group)

    return run


# --------------------------------------------------------------------------- the join


def _joined(texts: DataFrame, tasks: DataFrame, n: int, num: int, den: int, name: str) -> DataFrame:
    """Pairs (src, dst) of the tasks' rows (id, lo, label, cluster, todo: array of (task, stored))."""
    tasks = materialize(tasks.select("id", "lo", "label", "cluster", "todo"), "ngram-tasks")
    rows = texts.join(small_side(tasks, items="todo"), F.col("doc_id") == F.col("id")).withColumnRenamed("id", "rep")
    rows = rows.select("cluster", "rep", "lo", "label", "text", F.explode("todo").alias("x")).select("cluster", "x.task", "x.stored", "rep", "lo", "label", "text")
    rows = rows.repartition("cluster", "task").sortWithinPartitions("cluster", "task")
    return materialize(rows.mapInArrow(_tree_join(n, num, den), "src long, dst long"), name)


def ngram_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, block_sets: int = BLOCK_SETS, block_ngrams: int = BLOCK_NGRAMS, prepass: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    With ``prepass`` a first scan finds which n-grams may stand in two documents (``repeated_cells``). A set with too many others can't link and emits no
    keys, so that long passages that many documents share don't chain what is otherwise of its own. The filter has four cells for each n-gram as far as
    ``MOST_CELLS`` reach; beyond it more n-grams count as repeated, which only lets more sets pass. The result is the same with and without it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = None
    if prepass:
        size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        cells = min(MOST_CELLS, max(SEGMENT, 1 << int(size * 5 // 8).bit_length()))
        repeated = docs.sparkSession.sparkContext.broadcast(repeated_cells(texts, n, cells))
    profiles = materialize(texts.mapInArrow(_profiles(n, num, den, repeated), "doc_id long, n_shingles long, hi long, lo long, keys array<long>"), "ngram-profiles")
    slim = profiles.select("doc_id", "n_shingles", "hi", "lo")
    classes = materialize(slim.where("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "ngram-classes")

    keys = profiles.select("lo", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("lo").alias("dst"), F.max("lo").alias("last")).where("dst <> last").select("key", "dst")
    edges = keys.join(shared, "key").where("lo <> dst").select(F.col("lo").alias("src"), "dst").distinct()
    clusters = materialize(connected_components(edges, "ngram-clusters"), "ngram-clusters")

    members = classes.join(clusters.withColumnRenamed("node", "lo"), "lo").select(F.col("rep").alias("id"), F.col("n").alias("weight"), "lo", F.col("component").alias("cluster"))
    members = materialize(in_blocks(materialize(members, "ngram-members"), block_sets, block_ngrams), "ngram-placed")
    found = _joined(texts, within_tasks(members, ANCHORS), n, num, den, "ngram-within")
    large = members.where("k > 1")
    if not large.isEmpty():
        across = across_tasks(large, found, block_sets, block_ngrams, "ngram-parts")
        found = found.unionByName(_joined(texts, across, n, num, den, "ngram-across"))
    linked = materialize(connected_components(found, "ngram-links"), "ngram-links")

    classes = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component"))
    full = slim.join(classes, ["hi", "lo"], "left")
    return full.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_per_group(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose document is the smallest of its component; rows of a null doc_id stay."""
    found = ngram_components(docs, **options)
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "ngram-gone")
    return docs.join(small_side(gone), "doc_id", "left_anti")
