"""Language-model scores from a log-frequency Bloom filter.

Tokens are the words of a text with A-Z lower-cased, then one end token; the first token follows an end, too. Word counts are exact; counts of word
pairs are quantised to levels 1 + floor(log2 n), and a Bloom filter holds the events (pair, 1) ... (pair, level). A pair's level is found by probing
(pair, 1), (pair, 2), ... until one is absent, and stands for the mean count of its level. The probability of a word w after v is smoothed by the word's own:

    P(w) = (n(w) + 0.5) / (N + 0.5 (V + 1)),  P(w | v) = (n(v w) + MU P(w)) / (n(v) + MU)

Every text gives pairs, whatever the size of the corpus. Shards grow in number with the text, not in size: a word's shard holds its exact count
and the events of the pairs that it ends; pairs of frequent words (over a thousandth of all tokens, so under a thousand words) are dealt by the pair. As
the logarithm of P(w | v) is a sum of terms that need one shard each, a text's score is a sum over shards. Workers get the shards by broadcast, as many as
``ROUND_BYTES`` hold. One round needs one scan of the texts. If the shards need more rounds, the scan writes the tokens by round, and each
round reads its own tokens only, so the work stays in proportion to the text.

The Bloom filter finds an absent pair with a chance of 2^-PROBES; it never loses one. Null and empty texts have the end token alone. A null doc_id is in the
training rows. Repeated rows are scored and count each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import LOWER, U, discard, materialize, mix, span_hashes, text_blocks, word_spans

#: Weight of a word's own probability, in counts. Chosen on training rows (sf0.1: rows of remainder 2 scored by a model of the rows 0, 3 and 4).
MU = 300.0
#: Probes for an event (the filter is about half full), text bytes for a shard, bytes of shards that are broadcast at once.
PROBES, SHARD_BYTES, ROUND_BYTES = 8, 8 << 20, 256 << 20
#: Word hashes that a counting task holds before it hands them on.
HELD = 1 << 21
#: Tokens of a stored row and of a scored block, bytes of a row group of stored tokens: a task of a round holds some of these, however long its file is.
PIECE, SCORED, GROUP_BYTES = 1 << 13, 1 << 18, 16 << 20
#: Fixed contract value: rows whose crc32(doc_id as text) leaves this remainder modulo 5 aren't learnt from.
REMAINDER = 1
END, STEP = U(0xE2D1C3B4A5968778), U(0x9E3779B97F4A7C15)
#: What is added to a pair for the event of its level.
LEVEL = np.arange(65, dtype=U) * U(0xD6E8FEB86659FD93)


def held_out(doc_id="doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == REMAINDER, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a block of texts, each text's end included, and their rows."""
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets)
    n = len(offsets) - 1
    out = np.full(len(rows) + n, END)
    at = np.arange(len(rows)) + rows
    out[at] = span_hashes(low, starts, ends)
    of = np.empty(len(out), np.int64)
    of[at] = rows
    of[np.cumsum(np.bincount(rows, minlength=n)) + np.arange(n)] = np.arange(n)
    return out, of


def pairs(cur: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before it; texts stand one behind the other, so a first token follows an end."""
    return mix(np.concatenate([[END], cur[:-1]]).astype(U) * STEP + cur)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U(33)) % U(shards)).astype(np.int64)


def _known(keys: np.ndarray, counts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Counts of x (0: absent) by the sorted keys."""
    if not len(keys):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, counts[at], 0)


def _packed(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order]
    cut = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = [*cut[1:], len(keys)]
    binary = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(shard[cut]), binary(keys), binary(counts.astype(np.uint32))], ["shard", "keys", "counts"])


def _merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their summed counts."""
    keys = np.concatenate([np.frombuffer(x, U) for x in rows["keys"]])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["counts"]]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _counted(texts: DataFrame, gather) -> DataFrame:
    """(shard, keys, counts) of what ``gather(cur)`` gives for the tokens of a block: keys and their shards; summed within a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for block in itertools.chain(text_blocks(batches), [None]):
            if block is not None:
                held.append(gather(tokens(block[1], block[2])[0]))
                n += len(held[-1][0])
            if held and (block is None or n >= HELD):
                keys, first, counts = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_counts=True)
                shard = np.concatenate([h[1] for h in held])[first]
                held, n = [], 0
                yield _packed(shard, keys, counts)

    return texts.select("text").mapInArrow(count, "shard long, keys binary, counts binary")


@dataclass
class Model:
    """vocabulary: (shard, keys, counts, n); events: (shard, n_bits, bits); both are written tables."""

    vocabulary: DataFrame
    events: DataFrame
    shards: int
    n_tokens: int
    n_words: int
    frequent: tuple[np.ndarray, np.ndarray]
    mu: float

    @property
    def total(self) -> float:
        return self.n_tokens + 0.5 * (self.n_words + 1)

    def rounds(self, most: int) -> list[list[int]]:
        """Shards in groups of at most ``most`` bytes (one shard at least)."""
        size = {r["shard"]: r["b"] for r in self.vocabulary.select("shard", F.octet_length("keys").alias("b")).collect()}
        for r in self.events.select("shard", F.octet_length("bits").alias("b")).collect():
            size[r["shard"]] = 2 * size.get(r["shard"], 0) + r["b"]
        out, used = [[]], 0
        for s in range(self.shards):
            if out[-1] and used + size.get(s, 0) > most:
                out.append([])
                used = 0
            out[-1].append(s)
            used += size.get(s, 0)
        return out


def train(docs: DataFrame, shard_bytes: int = SHARD_BYTES, mu: float = MU) -> Model:
    """Counts all words and pairs of all texts of ``docs``."""
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = int(size // shard_bytes) + 1

    def words_of(cur):
        u, counts = np.unique(cur, return_counts=True)
        return np.repeat(u, counts), np.repeat(_shard(u, shards), counts)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(rows)
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "keys": [keys.tobytes()], "counts": [counts.tobytes()], "n": [int(counts.sum())], "v": [len(keys)]})

    vocabulary = materialize(_counted(texts, words_of).groupBy("shard").applyInPandas(add, "shard long, keys binary, counts binary, n long, v long"), "lm-words")
    row = vocabulary.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_tokens, n_words = row["n"] or 0, row["v"] or 0

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = np.frombuffer(keys, U), np.frombuffer(counts, np.int64)
                some = counts * 1000 > n_tokens
                yield pa.RecordBatch.from_arrays([pa.array(keys[some].astype(np.int64)), pa.array(counts[some])], ["key", "n"])

    top = vocabulary.select("keys", "counts").mapInArrow(often, "key long, n long").collect()
    keys = np.array([r["key"] for r in top], np.int64).astype(U)
    order = np.argsort(keys)
    frequent = keys[order], np.array([r["n"] for r in top], np.int64)[order]

    def pairs_of(cur):
        g = pairs(cur)
        return g, _shard(np.where(_known(*frequent, cur) > 0, g, cur), shards)

    def events(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(rows)
        level = np.frexp(counts.astype(np.float64))[1]
        n_bits = int(level.sum() * PROBES / np.log(2)) + 64
        bits = np.zeros(n_bits, np.uint8)
        for j in range(1, int(level.max()) + 1):
            for at in _places(keys[level >= j], j, np.full(1, n_bits, U)):
                bits[at] = 1
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "n_bits": [n_bits], "bits": [np.packbits(bits).tobytes()]})

    filled = materialize(_counted(texts, pairs_of).groupBy("shard").applyInPandas(events, "shard long, n_bits long, bits binary"), "lm-events")
    return Model(vocabulary.select("shard", "keys", "counts"), filled, shards, n_tokens, n_words, frequent, mu)


def _places(keys: np.ndarray, level: int, n_bits: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the event (key, level) in a filter of ``n_bits``, probe by probe."""
    x = mix(keys + LEVEL[level])
    a, b = x & U(0xFFFFFFFF), (x >> U(32)) | U(1)
    for i in range(PROBES):
        yield ((((a + U(i) * b) & U(0xFFFFFFFF)) * n_bits) >> U(32)).astype(np.int64)


class Shards:
    """Some of a model's shards as arrays, to be broadcast."""

    def __init__(self, model: Model, shards: list[int]):
        self.n_shards, self.frequent, self.mu, self.total = model.shards, model.frequent, model.mu, model.total
        self.here = np.zeros(model.shards, bool)
        self.here[shards] = True
        within = F.col("shard").between(shards[0], shards[-1])
        keys, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for r in model.vocabulary.where(within).toLocalIterator():
            keys.append(np.frombuffer(r["keys"], U))
            counts.append(np.frombuffer(r["counts"], np.int64))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        del keys, counts
        sizes = {r["shard"]: r["n_bits"] for r in model.events.where(within).select("shard", "n_bits").collect()}
        self.n_bits, self.offset = np.ones(model.shards, U), np.zeros(model.shards, np.int64)
        used = 1
        for shard, n in sizes.items():
            self.n_bits[shard], self.offset[shard] = n, used * 8
            used += -(-n // 8)
        self.bits = np.zeros(used, np.uint8)
        for r in model.events.where(within).toLocalIterator():
            at = self.offset[r["shard"]] // 8
            self.bits[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)

    def levels(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Level of each pair (0: absent), by repeated probes; a filter's last bits of another shard are never read."""
        level, alive, j = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        n_bits, offset = self.n_bits[shard], self.offset[shard]
        while len(alive) and j < 63:
            j += 1
            for place in range(PROBES):
                # probes of one event one after the other: most absent pairs leave at the first
                if place == 0:
                    x = mix(keys[alive] + LEVEL[j])
                    a, b = x & U(0xFFFFFFFF), (x >> U(32)) | U(1)
                at = ((((a + U(place) * b) & U(0xFFFFFFFF)) * n_bits[alive]) >> U(32)).astype(np.int64) + offset[alive]
                found = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
                alive, a, b = alive[found], a[found], b[found]
            level[alive] = j
        return level

    def parts(self, cur: np.ndarray, g: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        """For each text: known tokens, sums of log10(n + 0.5) and log10(n + mu) of known words, and of the pairs' gains; of these shards alone."""
        u, at = np.unique(cur, return_inverse=True)
        home, often = _shard(u, self.n_shards), _known(*self.frequent, u)
        n = np.where(often > 0, often, _known(self.keys, self.counts, u))
        own = (n > 0) & self.here[home]
        sums = [own.astype(float), np.where(own, np.log10(n + 0.5), 0), np.where(own, np.log10(n + self.mu), 0)]
        sums = [np.bincount(rows, weights=x[at], minlength=n_rows) for x in sums]
        shard = np.where((often > 0)[at], _shard(g, self.n_shards), home[at])
        some = np.flatnonzero((n > 0)[at] & self.here[shard])
        level = self.levels(g[some], shard[some])
        some, level = some[level > 0], level[level > 0]
        mean = (2.0 ** (level - 1) + 2.0**level - 1) / 2
        prior = self.mu * ((n + 0.5) / self.total)[at[some]]
        return np.stack([*sums, np.bincount(rows[some], weights=np.log10(1 + mean / prior), minlength=n_rows)])


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """Scores from the summed parts n_known, half, back, gain of each text."""
    n, known = F.col("n_tokens"), F.col("n_known")
    base = F.col("half") + (n - known) * float(np.log10(0.5)) - n * float(np.log10(model.total))
    return rows.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", F.round("n_known").cast("long").alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + known * float(np.log10(model.mu)) - F.col("back") + F.col("gain")).alias("score"),
    )


PARTS = ("n_known", "half", "back", "gain")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Stored pieces as blocks of about ``SCORED`` tokens: hashes of tokens and pairs, their texts' places, and the texts' lists row, doc_id, n_tokens."""
    held, n = [], 0
    for piece in itertools.chain((dict(zip(batch.schema.names, x, strict=True)) for batch in batches for x in zip(*batch.columns, strict=True)), [None]):
        if piece is not None:
            held.append(piece)
            n += len(piece["at"].as_buffer()) // 2
        if held and (piece is None or n >= SCORED):
            cur, g, at = [np.concatenate([np.frombuffer(x[c].as_buffer(), t) for x in held]) for c, t in (("cur", U), ("pair", U), ("at", np.uint16))]
            lists = [pa.concat_arrays([x[c].values for x in held]) for c in ("row", "doc_id", "n_tokens")]
            before = np.cumsum([0, *(len(x["row"].values) for x in held[:-1])])
            at = at + np.repeat(before, [len(x["at"].as_buffer()) // 2 for x in held])
            held, n = [], 0
            yield cur, g, at, lists


def score(docs: DataFrame, model: Model, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``; logarithms of base 10."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rounds = model.rounds(round_bytes)
    columns = ", ".join(f"{p} double" for p in PARTS)
    if len(rounds) == 1:
        sent = spark.sparkContext.broadcast(Shards(model, rounds[0]))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, data, offsets in text_blocks(batches):
                cur, rows = tokens(data, offsets)
                parts = sent.value.parts(cur, pairs(cur), rows, block.num_rows)
                n = np.bincount(rows, minlength=block.num_rows)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n), *map(pa.array, parts)], ["doc_id", "n_tokens", *PARTS])

        return _scored(texts.mapInArrow(whole, f"doc_id long, n_tokens long, {columns}"), model)

    of_round = np.zeros(model.shards, np.int64)
    for k, shards in enumerate(rounds):
        of_round[shards] = k
    n_shards, frequent = model.shards, model.frequent

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in text_blocks(batches):
            cur, rows = tokens(data, offsets)
            g, n = pairs(cur), np.bincount(rows, minlength=block.num_rows)
            home = of_round[_shard(cur, n_shards)]
            pair = of_round[_shard(np.where(_known(*frequent, cur) > 0, g, cur), n_shards)]
            each = [np.flatnonzero((home == k) | (pair == k)) for k in range(len(rounds))]
            pieces = [(k, some[a : a + PIECE]) for k, some in enumerate(each) for a in range(0, len(some), PIECE)]
            texts_of = [np.unique(rows[some], return_inverse=True) for _, some in pieces]
            ends, texts_in = np.cumsum([0, *(len(u) for u, _ in texts_of)]), pa.array(np.concatenate([u for u, _ in texts_of]))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x.take(texts_in)) for x in (block.column(0), block.column(2), pa.array(n))]
            binary = [pa.array([x[some].tobytes() for _, some in pieces], pa.binary()) for x in (cur, g)]
            at = pa.array([x.astype(np.uint16).tobytes() for _, x in texts_of], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces]), *lists, *binary, at], ["round", "doc_id", "row", "n_tokens", "cur", "pair", "at"])

    kind = "round long, doc_id array<long>, row array<long>, n_tokens array<long>, cur binary, pair binary, at binary"
    by_round = texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(dealt, kind)
    stored = materialize(by_round, "lm-tokens", by="round", **{"parquet.block.size": GROUP_BYTES})
    found = None
    for k, shards in enumerate(rounds):
        sent = spark.sparkContext.broadcast(Shards(model, shards))

        def some(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for cur, g, at, lists in _together(batches):
                yield pa.RecordBatch.from_arrays([*lists, *map(pa.array, sent.value.parts(cur, g, at, len(lists[0])))], ["row", "doc_id", "n_tokens", *PARTS])

        one = materialize(stored.where(F.col("round") == k).drop("round").mapInArrow(some, f"row long, doc_id long, n_tokens long, {columns}"), "lm-parts")
        found = one if found is None else found.unionByName(one)
        sent.unpersist()
    discard(stored)
    summed = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), *[F.sum(p).alias(p) for p in PARTS])
    return _scored(summed, model)


def score_documents(docs: DataFrame) -> DataFrame:
    """``score`` of all documents by a model of those that aren't held out."""
    return score(docs, train(docs.where(~held_out())))
