"""Spelling variants: words one edit apart, found by composing finite-state machines.

The vocabulary is an acceptor: a minimal acyclic automaton of sorted words, whose arcs carry the number of words before them, so a path
names its word. Composed with the one-edit transducer and with the acceptor again, it accepts the pairs of words that differ by one inserted,
deleted or replaced code point. The composition is run from many initial states at once, and each partition of initial states is a task:

* two words of at least m code points that are one edit apart share their first m // 2 code points or their last m - m // 2;
* so an initial state is what the first m // 2 code points lead to, or in the acceptor of the reversed words the last m - m // 2; pairs that share the
  first code points are left out of the second;
* before the edit both sides walk the same path. The edit stands at the first difference, so a pair has one path. After it both sides read the same code
  points, until they end, or meet in one state: then all the state's words are pairs, without walking further.

A task expands all open paths by one code point at a time in arrays. An initial state with more than ``BLOCK`` words is dealt into blocks, and each two blocks
are a task, so no task grows with a frequent beginning or ending, and no pair is lost.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import U, discard, materialize, mix, small_side

#: Words of an initial state that one task takes, open paths that it expands at once, code points of the first class of word lengths.
BLOCK, PATHS, SHORT = 100_000, 1 << 20, 64
#: Fixed contract values: code points of a word and its occurrences at least, the share of misspelt runs, and how much more frequent a form is.
LEAST_LENGTH, LEAST_N, ONE_IN, LEAD = 7, 2, 31, 10
_MIXED = U(0x9E3779B97F4A7C15)


def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of so many items each: row and number within the row of every item."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Acceptor:
    """Minimal acyclic automaton of sorted distinct words (rows of code points, padded by 0), with the states that their first ``depth`` code points lead to."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, depth: int):
        n, width = codes.shape
        differs = codes[1:] != codes[:-1]
        common = np.concatenate([[-1], np.where(differs.any(axis=1), differs.argmax(axis=1), width)])
        # trie, deepest level first: a node is the first of the words that begin with its path; equal signatures are equal states
        nodes, arcs, below = [], [], None
        for d in range(int(lengths.max()), depth - 1, -1):
            first = np.flatnonzero((common < d) & (lengths >= d))
            final = lengths[first] == d
            signature, size = final.astype(U) + U(1), final.astype(np.int64)
            if below is not None:
                child, of_child, size_of_child = below
                parent = np.searchsorted(first, child, "right") - 1
                start = np.flatnonzero(np.diff(parent, prepend=-1))
                signature[parent[start]] += np.add.reduceat(mix(of_child * _MIXED + codes[child, d].astype(U)), start)
                size[parent[start]] += np.add.reduceat(size_of_child, start)
            signature = mix(signature)
            if below is not None:
                arcs.append((signature[parent], codes[child, d], of_child))
            nodes.append((signature, final, size))
            below = first, signature, size
        signatures, finals, sizes = (np.concatenate(x) for x in zip(*nodes, strict=True))
        ids, one = np.unique(signatures, return_index=True)
        self.final, self.size = finals[one], sizes[one]
        self.initial, self.base = np.searchsorted(ids, below[1]), below[0]
        none = np.zeros(0, U), np.zeros(0, codes.dtype), np.zeros(0, U)
        source, label, target = (np.concatenate(x) for x in zip(none, *arcs, strict=True))
        source, target = np.searchsorted(ids, source), np.searchsorted(ids, target)
        self.labels, label = np.unique(label, return_inverse=True)
        self.n_labels = max(1, len(self.labels))
        self.keys, one = np.unique(source * self.n_labels + label, return_index=True)
        self.source, self.label, self.target = source[one], label[one], target[one]
        states = np.arange(len(ids))
        self.begin = np.searchsorted(self.source, states)
        self.degree = np.searchsorted(self.source, states, "right") - self.begin
        sizes = self.size[self.target]
        before = np.cumsum(sizes) - sizes
        self.skip = before - (before[self.begin[self.source]] if len(before) else 0) + self.final[self.source]
        #: labels of a state's arcs as bits, modulo 64: states without a common bit have no common label
        self.bits = np.zeros(len(ids), U)
        np.bitwise_or.at(self.bits, self.source, U(1) << (self.label % 64).astype(U))

    def step(self, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows that have such an arc, the arcs)."""
        if not len(self.keys) or not len(state):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = state * self.n_labels + label
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        rows = np.flatnonzero(self.keys[at] == key)
        return rows, at[rows]


def compose(a: Acceptor) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the words of each pair that acceptor, one-edit transducer and acceptor accept: each pair once, in any order of the two."""
    state, rank = a.initial, a.base
    while len(state):
        work = np.cumsum(np.maximum(1, a.degree[state]) ** 2)
        cut = np.unique(np.searchsorted(work, np.arange(PATHS, work[-1], PATHS), "right"))
        for q, i in zip(np.split(state, cut), np.split(rank, cut), strict=True):
            row, k = spread(a.degree[q] ** 2)
            d = a.degree[q][row]
            one, two = a.begin[q][row] + k // d, a.begin[q][row] + k % d
            # one side has one more code point: it takes the arc one, then both take two's label
            end = np.flatnonzero((one == two) & a.final[q][row])
            end = end[a.final[a.target[one[end]]]]
            yield i[row[end]], i[row[end]] + a.skip[one[end]]
            other = np.flatnonzero(one != two)
            row, one, two = row[other], one[other], two[other]
            some, arc = a.step(a.target[one], a.label[two])
            r = row[some]
            yield from _same(a, a.target[arc], i[r] + a.skip[one[some]] + a.skip[arc], a.target[two[some]], i[r] + a.skip[two[some]])
            # a replaced code point, each two arcs once
            some = np.flatnonzero(one < two)
            r, one, two = row[some], one[some], two[some]
            yield from _same(a, a.target[one], i[r] + a.skip[one], a.target[two], i[r] + a.skip[two])
        row, k = spread(a.degree[state])
        arc = a.begin[state][row] + k
        state, rank = a.target[arc], rank[row] + a.skip[arc]


def _same(a: Acceptor, p: np.ndarray, i: np.ndarray, q: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of words that both sides' states accept."""
    while len(p):
        met = p == q
        if met.any():
            row, k = spread(a.size[p[met]])
            yield i[met][row] + k, j[met][row] + k
        ends = ~met & a.final[p] & a.final[q]
        yield i[ends], j[ends]
        go = ~met & (a.bits[p] & a.bits[q] != 0)
        p, i, q, j = p[go], i[go], q[go], j[go]
        swap = a.degree[q] < a.degree[p]
        p, q, i, j = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, j, i), np.where(swap, i, j)
        row, k = spread(a.degree[p])
        arc = a.begin[p][row] + k
        rows, other = a.step(q[row], a.label[arc])
        row, arc = row[rows], arc[rows]
        p, i, q, j = a.target[arc], i[row] + a.skip[arc], a.target[other], j[row] + a.skip[other]


def one_edit_pairs(words: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the pairs of sorted distinct ``words`` (objects, ``depth`` code points at least) that share their first ``depth`` code points and
    are one edit apart; each pair once. Words are taken by classes of length, so one long word doesn't widen the others' rows."""
    lengths = np.array([len(w) for w in words], np.int64)
    low, high = 0, SHORT
    while low <= lengths.max(initial=-1):
        of = np.flatnonzero((lengths >= low) & (lengths <= high))
        if len(of) > 1:
            codes = np.array(words[of].tolist(), f"U{lengths[of].max()}").view(np.uint32).reshape(len(of), -1)
            for i, j in compose(Acceptor(codes, lengths[of], depth)):
                i, j = of[i], of[j]
                new = (lengths[i] > low) | (lengths[j] > low) if low else slice(None)
                yield i[new], j[new]
        low, high = high, 2 * high


# --------------------------------------------------------------------------- on Spark


def run_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, one_in: int = ONE_IN) -> DataFrame:
    """(word, n): runs of Latin letters of the whole texts, A-Z lower-cased; a run whose crc32 with its doc_id is divisible by ``one_in`` loses a code point."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    runs = F.regexp_extract_all(F.translate("text", upper, lower), F.lit(rf"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode_outer(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    rows = rows.select(F.when(F.col("h") % one_in == 0, short).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def near_words(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of one edit of the distinct ``vocabulary`` (word, n; a written table), and every word once with a null near.
    Words are ``least_length`` code points at least."""
    head, tail = least_length // 2, least_length - least_length // 2
    keys = [F.struct(F.lit(False).alias("back"), F.substr("word", F.lit(1), F.lit(head)).alias("key")), F.struct(F.lit(True).alias("back"), F.right("word", F.lit(tail)).alias("key"))]
    rows = vocabulary.select("word", "n", F.explode(F.array(*keys)).alias("x")).select("word", "n", "x.back", "x.key")
    hot = materialize(rows.groupBy("back", "key").count().where(F.col("count") > block), "hot-states")
    hot = small_side(hot.select("back", "key", F.ceil(F.col("count") / block).cast("int").alias("k")))
    rows = rows.join(hot, ["back", "key"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("k")).cast("int")
    two = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("i"), F.greatest(b, F.col("own")).alias("j")))
    rows = rows.withColumn("own", own).withColumn("two", F.explode(two)).select("back", "key", "two.i", "two.j", "own", "word", "n")
    rows = rows.repartition("back", "key", "i", "j").sortWithinPartitions("back", "key", "i", "j")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            # a task's rows stand together; several small tasks of one direction are one run
            at = [c.to_numpy(zero_copy_only=False) for c in (t["back"], t["key"], t["i"], t["j"])]
            cut = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in at], axis=0)) + 1), t.num_rows]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                now = tuple(c[a] for c in at)
                if held and now != last and (n >= block or now[0] != last[0] or (now[1] == last[1])):
                    yield from _near(pa.concat_tables(held), head, tail)
                    held, n = [], 0
                held.append(t.slice(a, b - a))
                n, last = n + b - a, now
        if held:
            yield from _near(pa.concat_tables(held), head, tail)

    return rows.mapInArrow(tasks, "word string, n long, near string, near_n long")


def _near(t: pa.Table, head: int, tail: int) -> Iterator[pa.RecordBatch]:
    back = t["back"][0].as_py()
    words = np.array(t["word"].to_pylist(), object)
    read = np.array([w[::-1] for w in words], object) if back else words
    order = np.argsort(read, kind="stable")
    words, read = words[order], read[order]
    i, j, own, n = (t[c].to_numpy()[order] for c in ("i", "j", "own", "n"))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    if not back:
        once = np.flatnonzero((i == own) & (j == own))
        yield pa.RecordBatch.from_arrays([pa.array(words[once], pa.string()), pa.array(n[once]), pa.nulls(len(once), pa.string()), pa.nulls(len(once), pa.int64())], schema=schema)
    text = pa.array(words, pa.string())
    starts = np.array([w[:head] for w in words], object)
    for a, b in one_edit_pairs(read, tail if back else head):
        # blocks: pairs within a block belong to the task of that block alone
        good = (own[a] != own[b]) | (i[a] == j[a])
        if back:
            good &= starts[a] != starts[b]
        a, b = a[good], b[good]
        if len(a):
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
            yield pa.RecordBatch.from_arrays([text.take(pa.array(a)), pa.array(n[a]), text.take(pa.array(b)), pa.array(n[b])], schema=schema)


def follow(rows: DataFrame) -> DataFrame:
    """``rows`` (word, form, ...) with ``root``: from the word along the forms to the last. A form is more frequent than its word, so there are no rings."""
    own = rows.where("form is null").withColumn("root", F.col("word"))
    led = materialize(rows.where("form is not null").withColumn("root", F.col("form")), "forms")
    while True:
        further = led.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not led.join(further, "root", "left_semi").limit(1).count():
            return own.unionByName(led)
        step = led.join(further, "root", "left").withColumn("root", F.coalesce("further", "root")).drop("further")
        step = materialize(step.select(led.columns), "forms")
        discard(led)
        led = step


def spelling_groups(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs``.

    n: occurrences; n_near: words one edit away; form: the most frequent of them (ties: first in code-point order) if it is at least ``LEAD`` times as
    frequent, else null; root: the last form reached from the word, the word itself without one. Null texts have no words, a null doc_id is empty text
    in the checksum, repeated rows count each, an empty table gives no rows, extra columns are ignored.
    """
    vocabulary = materialize(run_words(docs), "vocabulary")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), "near")))
    rows = near_words(vocabulary).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    led: Column = -F.col("best.m") >= LEAD * F.col("n")
    rows = rows.select("word", "n", "n_near", F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.m")).alias("form_n"))
    return follow(materialize(rows, "near-words")).select("word", "n", "n_near", "form", "form_n", "root")
