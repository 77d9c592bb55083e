"""Fuzzy line deduplication (operator 4).

A line takes part if it has at least ``least_words`` words after normalisation (A-Z folded, ASCII digits, signs
and white space become separators). One pass over the texts gives each such line a 128-bit key of its
normalised words, a 64-bit SimHash of them, its length and ``KEYS`` join keys. Lines with equal 128-bit keys are one class
from here on, whatever their number. A join key joins three weighted MinHashes of the line's words: lines that share most
of their words mostly share one of the keys (the README has the recall), other lines hardly ever; blocks of the SimHash itself
would find few lines with a changed word. Two lines are candidates if they share a key, their SimHashes are ``apart`` bits apart at most
(short lines ``SHORT_APART``, unlike lines 32), and their lengths allow the similarity. The lines of a run of equal keys that are candidates
meet in one task with their texts. There a pair is verified at the first key that it shares, and only if it isn't connected yet and the counts of its code points
and of its code points' triples don't rule it out (an edit changes at most one code point and three triples, so no similar pair is lost), nor grams of the one
that the other doesn't have near their place, nor pieces of the shorter line that are nowhere near in the longer (both exact, too), by edit similarity
(1 - Levenshtein distance / longer length, at least ``similarity``), for many pairs at once. A run above ``block_lines`` lines is dealt into blocks that
join with themselves and some lines that all blocks hold; only the lines outside of the run's largest component meet its other blocks then.
Of each connected group the occurrence with the smallest (doc_id, line number) is kept, all other lines of the group are
removed; other lines are not touched.

Null and empty texts stay as they are. Rows with the same doc_id count as one document; rows without a
doc_id are never changed. A document whose every line is removed ends with an empty text. An empty table gives an empty result.
Extra columns are handed on; columns named n_lines or n_removed are replaced by the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import LOWER, U, across_tasks, connected_components, in_blocks, materialize, mix, small_side, span_hashes, text_blocks, within_tasks, word_spans

LEAST_WORDS, BITS_APART, SIMILARITY = 5, 16, 0.8
#: Bits that lines under so many characters may be apart: with few words each word moves more bits.
SHORT_APART, SHORT_CHARS = 20, 100
BLOCK_LINES, BLOCK_CHARS, ANCHORS = 4096, 4_000_000, 16
#: Cells in which the code points and their triples of a line are counted: a shared cell only makes lines look more alike.
SINGLES, TRIPLES = 64, 512
#: Keys of a line; each joins ``JOINED`` MinHashes of its words.
KEYS, JOINED = 8, 3
#: Lines that are verified together; places of the texts of a batch of pairs; below so many pairs, and above such a length, pairs are compared one by one.
TOGETHER, BATCH_PLACES, FEW_PAIRS, LONG_LINE = 4096, 400_000, 24, 1000
#: Places of a piece of a line; least edits that a piece of an unlike line is taken to need: a smaller number looks at more pieces.
PIECE, PIECE_EDITS = 64, 12
#: Code points of the grams by which pairs are ruled out: first those of three, then all kinds; so many pairs for each table of a batch at least. Cells of a line's table as a multiple of the edits, at least and at most so many bits of a cell's number.
GRAMS, SHARED_BASE, GRAM_CELLS, CELL_BITS = ((3,), (4, 3, 2)), 4, 16, (9, 16)
#: Candidate pairs that are verified together.
GATHERED = 2048
#: Columns of a single comparison after which it is asked whether it can still succeed.
CHECKED = 256
#: Columns of two keys each.
PAIRED = [f"k{i}" for i in range(KEYS // 2)]
#: Rows of a run of equal keys that are searched for close pairs; of a longer run all rows are candidates.
LONGEST_RUN = 4096

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[128:] = False
_SEPARATOR[ord("a") : ord("z") + 1] = False
_NORMAL = bytes(np.where(_SEPARATOR[LOWER], 32, LOWER).astype(np.uint8))
_ORDERS = np.random.Generator(np.random.PCG64(44)).integers(0, 2**31, KEYS * JOINED, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_JOINS = [range(k, k + JOINED) for k in range(0, KEYS * JOINED, JOINED)]


def line_keys(h: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``KEYS`` 32-bit keys of each line, from its words' hashes and sizes: weighted MinHashes, in which longer words, which are rarer, count more."""
    h, light = (h >> U(32)).astype(np.uint32), (1 / np.maximum(size - 1, 0.5)).astype(np.float32)
    least = [np.minimum.reduceat((h * m).astype(np.float32) * light, first, dtype=np.float32).view(np.uint32).astype(U) for m in _ORDERS]
    out = np.empty((len(first), KEYS), np.uint32)
    for k, joined in enumerate(_JOINS):
        key = np.full(len(first), k, U)
        for x in joined:
            key = mix(key + least[x])
        out[:, k] = key >> U(32)
    return out


def line_profiles(data: np.ndarray, offsets: np.ndarray, least_words: int) -> tuple[np.ndarray, ...]:
    """(row, line number, 128-bit key as two words, SimHash, length, keys) of the lines that take part."""
    breaks = np.flatnonzero(data == 10)
    starts, ends, row = word_spans(LOWER[data], offsets, _SEPARATOR)
    if not len(starts):
        return *(np.zeros(0, t) for t in (np.int64, np.int64, U, U, U, np.int32)), np.zeros((0, KEYS), np.uint32)
    line = np.searchsorted(breaks, starts) + row  # ascending, one number for each line of each row
    h = span_hashes(LOWER[data], starts, ends)
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    count = np.diff(np.append(first, len(line)))
    place = (np.arange(len(h)) - np.repeat(first, count)).astype(U)
    hi = np.add.reduceat(mix(h + place * U(0x9E3779B97F4A7C15)), first)
    lo = np.add.reduceat(mix(h ^ mix(place + U(77))), first)
    sim = np.empty(len(first), U)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(first, first[a] + 100_000)))
        stop = first[b] if b < len(first) else len(h)
        bits = np.unpackbits(h[first[a] : stop].view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, first[a:b] - first[a], axis=0, dtype=np.uint8 if count[a:b].max() < 256 else np.int32)
        sim[a:b] = np.packbits(ones > count[a:b, None] // 2, axis=1).view(U).ravel()
        a = b
    keep = count >= least_words
    row = row[first]
    number = line[first] - row - np.searchsorted(breaks, offsets[row])
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    length = np.add.reduceat(chars[ends] - chars[starts] + 1, first) - 1
    return row[keep], number[keep], hi[keep], lo[keep], sim[keep], length[keep].astype(np.int32), line_keys(h, ends - starts, first)[keep]


def _profiles(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches):
            row, number, hi, lo, sim, length, keys = line_profiles(data, offsets, least_words)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (hi, lo, sim)), pa.array(length), *(pa.array(np.ascontiguousarray(k)) for k in keys.view(np.int64).T)],
                names=["doc_id", "line_no", "hi", "lo", "sim", "length", *PAIRED],
            )

    return run


def alike(a, b, similarity: float) -> np.ndarray:
    """Whether texts of these lengths can reach ``similarity``."""
    return np.abs(a - b) <= ((1 - similarity) * np.maximum(a, b) + 1e-9).astype(np.int64)


def candidates(sim, size, other_sim, other_size, apart: int, similarity: float) -> np.ndarray:
    """Whether SimHashes and lengths (two arrays, or an array and one line) leave it open that the lines are similar."""
    bits = np.where(np.maximum(size, other_size) < SHORT_CHARS, max(apart, SHORT_APART), apart)
    return (np.bitwise_count(sim ^ other_sim) <= bits) & alike(size, other_size, similarity)


def close_forest(sim: np.ndarray, apart: int, length: np.ndarray | None = None, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Edges (i, j) that connect what pairs of SimHashes at most ``apart`` bits apart, of lengths that can be similar, connect."""
    length = np.full(len(sim), SHORT_CHARS) if length is None else length.astype(np.int64)
    order = np.lexsort((length, sim))
    new = np.concatenate(([True], (sim[order][1:] != sim[order][:-1]) | (length[order][1:] != length[order][:-1])))
    edges = [(int(order[k - 1]), int(order[k])) for k in np.flatnonzero(~new)]
    at = order[new]
    value, length = sim[at], length[at]
    open_, stack = np.ones(len(value), bool), []
    left = np.arange(len(value))
    for k in range(len(value)):
        if not open_[k]:
            continue
        open_[k] = False
        stack.append(k)
        while stack:
            i = stack.pop()
            left = left[open_[left]]
            near = left[candidates(value[left], length[left], value[i], length[i], apart, similarity)]
            open_[near] = False
            stack += near.tolist()
            edges += [(int(at[i]), int(at[j])) for j in near]
    return edges


def has_close(sim: np.ndarray, first: np.ndarray, last: np.ndarray, apart: int, short: int = 16) -> np.ndarray:
    """Which runs [first, last) of more than two rows may hold a close pair: of runs up to ``short`` rows exactly those, and all longer ones."""
    length = last - first
    more, at = length > short, np.flatnonzero((length > 2) & (length <= short))
    for i in range(short - 1):
        at = at[length[at] > i + 1]
        for d in range(1, short - i):
            to = at[length[at] > i + d]
            if not len(to):
                break
            more[to[np.bitwise_count(sim[first[to] + i] ^ sim[first[to] + i + d]) <= apart]] = True
    return more


def _close_lines(apart: int, similarity: float):
    """Rows (key, id, sim, length), sorted by key -> (key, id) of the rows that have a candidate partner with their key."""

    def close(key, ids, sim, length):
        run_ends = np.flatnonzero(key[1:] != key[:-1]) + 1
        first, last = np.append(0, run_ends), np.append(run_ends, len(key))
        two = first[last - first == 2]
        two = two[candidates(sim[two], length[two], sim[two + 1], length[two + 1], apart, similarity)]
        chosen = [two, two + 1]
        more = has_close(sim, first, last, max(apart, SHORT_APART))
        for a, b in zip(first[more].tolist(), last[more].tolist(), strict=True):
            if b - a > LONGEST_RUN:
                chosen.append(np.arange(a, b))
                continue
            found = close_forest(sim[a:b], apart, length[a:b], similarity)
            if found:
                chosen.append(a + np.unique(found))
        chosen = np.concatenate(chosen)
        return pa.RecordBatch.from_arrays([pa.array(key[chosen]), pa.array(ids[chosen])], names=["key", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = [np.zeros(0, t) for t in (np.int64, np.int64, U, np.int32)], None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "sim", "length")]
            new[2] = new[2].view(U)
            if long is not None:  # the key of a run beyond the bound: its rows go on as they come
                rest = np.flatnonzero(new[0] != long)
                stop = int(rest[0]) if len(rest) else len(new[0])
                yield pa.RecordBatch.from_arrays([pa.array(new[0][:stop]), pa.array(new[1][:stop])], names=["key", "id"])
                new, long = [x[stop:] for x in new], None if len(rest) else long
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            other = np.flatnonzero(held[0] != held[0][-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield close(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
            if len(held[0]) > LONGEST_RUN:
                long = held[0][0]
                yield close(*held)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield close(*held)

    return run


def within(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether 1 - Levenshtein(a, b) / longer length reaches ``similarity``; arrays of code points."""
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    k = int(differ[0]) if len(differ) else m
    a, b = a[k:], b[k:]
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
    k = int(differ[0]) if len(differ) else m
    a, b = a[: len(a) - k], b[: len(b) - k]
    if max(len(a), len(b)) <= most:
        return True
    return _distance_at_most(a.tolist(), b.tolist(), most)


def _distance_at_most(a: list[int], b: list[int], most: int) -> bool:
    """Levenshtein distance by bit vectors: column differences of the whole table's column in one integer."""
    if not a or not b:
        return max(len(a), len(b)) <= most
    match: dict[int, int] = {}
    for i, x in enumerate(a):
        match[x] = match.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, left = full, 0, len(a), len(b)
    size, ahead = (len(a) + 7) // 8, np.arange(len(a) + 1) - len(a) + len(b)
    stop = max(CHECKED, len(b) // 16)
    for t, x in enumerate(b, 1):
        eq = match.get(x, 0)
        vertical = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        score += (1 if rise & last else 0) - (1 if fall & last else 0)
        left -= 1
        if score - left > most:
            return False
        if not t % stop:  # the best that any cell of the column can come to
            bits = [np.unpackbits(np.frombuffer(v.to_bytes(size, "little"), np.uint8), count=len(a), bitorder="little").astype(np.int32) for v in (up, down)]
            if (t - 1 + np.cumsum(np.append(0, bits[0] - bits[1])) + np.abs(ahead - t + 1)).min() > most:
                return False
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
    return score <= most


def normal_words(line: str | None) -> list[str]:
    """A line's normalised words."""
    return (line or "").encode().translate(_NORMAL).decode().split(" ") if line else []


def normalized(line: str | None) -> np.ndarray:
    """Code points of a line's normalised words, joined by single spaces."""
    return np.frombuffer(" ".join(x for x in normal_words(line) if x).encode("utf-32-le"), np.uint32)


#: Words left out on both sides, fewest first, behind which an alignment by words may go on.
_SKIPS = sorted(((x, y) for x in range(5) for y in range(5) if x or y), key=lambda s: (max(s), abs(s[0] - s[1])))


def words_apart(a: list[str], b: list[str], most: int) -> int:
    """A bound from above of the Levenshtein distance of two texts of words; more than ``most`` if none is found."""
    i = j = cost = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for x, y in _SKIPS:
            if i + x <= len(a) and j + y <= len(b) and a[i + x : i + x + 2] == b[j + y : j + y + 2]:
                cost += max(sum(map(len, a[i : i + x])) + x, sum(map(len, b[j : j + y])) + y)
                i, j = i + x, j + y
                break
        else:
            return most + 1
        if cost > most:
            return cost
    return cost + sum(map(len, a[i:])) + len(a) - i + sum(map(len, b[j:])) + len(b) - j


def _masks(pattern: np.ndarray, size: np.ndarray, words: int, n_codes: int) -> np.ndarray:
    """For each word of 64 places, pattern and code: the bits of the places that hold the code."""
    out = np.zeros((words, len(pattern) * n_codes), U)
    row = np.arange(len(pattern)) * n_codes
    for place in range(int(size.max())):
        there = size > place
        out[place // 64, row[there] + pattern[there, place]] |= U(1) << U(place % 64)
    return out


def distances(texts: list[np.ndarray], pairs: list[tuple[int, int]], most: np.ndarray) -> np.ndarray:
    """Levenshtein distances of pairs of texts (arrays of code points), exact up to ``most`` of the pair and too large beyond it.

    Bit vectors of 64 places for all pairs at once: one step takes a column of all tables on. Only the words of places take part
    to which an alignment of at most ``most`` edits can move. Pairs should be of similar lengths.
    """
    short = [i if len(texts[i]) <= len(texts[j]) else j for i, j in pairs]
    long = [j if k == i else i for k, (i, j) in zip(short, pairs, strict=True)]
    order = np.argsort([-len(texts[j]) for j in long], kind="stable")
    short, long = [texts[short[k]] for k in order], [texts[long[k]] for k in order]
    m, n = np.array([len(t) for t in short]), np.array([len(t) for t in long])
    everything = np.concatenate([*short, *long])
    there = np.zeros(int(everything.max()) + 1, bool)
    there[everything] = True
    which, n_codes = (np.cumsum(there) - 1)[everything], int(there.sum())
    words, longer = int(m.max() + 63) // 64, np.array([abs(len(texts[i]) - len(texts[j])) for i, j in pairs])
    behind, ahead = int(((most + longer) // 2).max()) + 1, int(np.maximum(most - longer, 0).max()) // 2 + 1
    row = np.repeat(np.arange(len(m)), m)
    pattern, text = np.zeros((len(m), m.max()), np.int64), np.zeros((n.max(), len(n)), np.int64)
    pattern[row, np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)] = which[: m.sum()]
    row = np.repeat(np.arange(len(n)), n)
    text[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), row] = which[m.sum() :] + row * n_codes
    masks = _masks(pattern, m, words, n_codes)
    up, down = np.full((words, len(m)), ~U(0)), np.zeros((words, len(m)), U)
    base, out, first = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64), 0
    one, top = U(1), U(63)

    def height(low: int, high: int) -> np.ndarray:
        """Distance at the pattern's end for rows [low, high) whose texts end at this column."""
        total = base[low:high].copy()
        for w in range(first, words):
            bits = np.clip(m[low:high] - 64 * w, 0, 64)
            inside = np.where(bits == 64, ~U(0), (one << bits.astype(U)) - one)
            total += np.bitwise_count(up[w, low:high] & inside).astype(np.int64) - np.bitwise_count(down[w, low:high] & inside)
        return total

    left = len(m)
    for t in range(int(n.max())):
        ended = int(np.searchsorted(-n, -t, "left"))  # rows from here on have texts of at most t places
        if ended < left:
            out[ended:left] = height(ended, left)
            left = ended
        while first < words - 1 and 64 * (first + 1) <= t - behind:
            base += np.bitwise_count(up[first]).astype(np.int64) - np.bitwise_count(down[first])
            first += 1
        last = min(words, (t + ahead) // 64 + 1)
        here = text[t, :left]
        plus, minus = np.ones(left, U), np.zeros(left, U)
        base[:left] += 1
        for w in range(first, last):
            eq, u, d = masks[w][here], up[w, :left], down[w, :left]
            vertical = eq | d
            eq = eq | minus
            diagonal = (((eq & u) + u) ^ u) | eq
            rise, fall = d | ~(diagonal | u), u & diagonal
            carry_up, carry_down = rise >> top, fall >> top
            rise, fall = (rise << one) | plus, (fall << one) | minus
            up[w, :left], down[w, :left] = fall | ~(vertical | rise), rise & vertical
            plus, minus = carry_up, carry_down
    out[:left] = height(0, left)
    back = np.empty(len(out), np.int64)
    back[order] = out
    return back


def surely_apart(short: list[np.ndarray], long: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Pairs of texts (arrays of code points, the first no longer and of ``PIECE`` places at least) whose Levenshtein distance surely is above ``most`` of the pair.

    An alignment of at most k edits of texts whose lengths differ by d places moves no place by more than (k - d) / 2 to the left and (k + d) / 2 to the right,
    so disjoint pieces of the shorter text cost at least what their best places within these windows of the longer one do, together. All pieces of all pairs are
    searched side by side by bit vectors; code points that share a cell look alike, which only makes pairs look closer.
    """
    m, n = np.array([len(t) for t in short]), np.array([len(t) for t in long])
    count = np.clip(-(-most // PIECE_EDITS), 1, m // PIECE)
    pair = np.repeat(np.arange(len(m)), count)
    at = (np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)) * (m // count)[pair]
    before = np.maximum(most - (n - m), 0) // 2
    width, cells, none = int((PIECE + before + (most + n - m) // 2).max()), 128, 127
    some = np.concatenate(short).astype(np.int64) % none
    # longer texts with ends that are like nothing, as far as a window reaches beyond them
    end, places = np.full(width, none, np.uint32), np.arange(len(pair))
    every = np.concatenate([x for t in long for x in (end, t % np.uint32(none), end)]).astype(np.int64) * len(pair)
    masks, from_ = np.zeros(cells * len(pair), U), (np.cumsum(m) - m)[pair] + at
    for place in range(PIECE):
        masks[some[from_ + place] * len(pair) + places] |= U(1) << U(place)
    text = every[(np.cumsum(n + 2 * width) - n - width)[pair] + at - before[pair] + np.arange(width)[:, None]]
    text += places
    up, down = np.full(len(pair), ~U(0)), np.zeros(len(pair), U)
    cost = np.full(len(pair), PIECE, U)
    least, one, top = cost.copy(), U(1), U(PIECE - 1)
    for t in range(width):
        eq = masks[text[t]]
        vertical = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(diagonal | up), up & diagonal
        cost += rise >> top
        cost -= fall >> top
        np.minimum(least, cost, out=least)
        rise, fall = rise << one, fall << one
        up, down = fall | ~(vertical | rise), rise & vertical
    return np.bincount(pair, least, len(m)) > most


def _disjoint_table() -> tuple[np.ndarray, np.ndarray]:
    """By free places so far (4 at most) and codes of the next four places (5 less the code points of the shortest absent gram that ends there, or 0): free places behind them,
    and how many absent grams that don't overlap end there."""
    free, count = np.zeros((5, 256), np.intp), np.zeros((5, 256), np.int64)
    for s in range(5):
        for byte in range(256):
            at = s
            for place in range(4):
                code, at = byte >> (6 - 2 * place) & 3, min(4, at + 1)
                if code and 5 - code <= at:
                    at, count[s, byte] = 0, count[s, byte] + 1
            free[s, byte] = at * 256
    return free.ravel(), count.ravel()


_FREE, _ALONE = _disjoint_table()


_ROOM: dict[str, np.ndarray] = {}


def _room(name: str, shape: tuple[int, ...], dtype) -> np.ndarray:
    """An array to be filled, in memory that calls use again: fresh memory costs more than what is done with it."""
    if name not in _ROOM or _ROOM[name].size < np.prod(shape):
        _ROOM[name] = np.empty(np.prod(shape), dtype)
    return _ROOM[name][: np.prod(shape)].reshape(shape)


def grams_apart(probes: list[np.ndarray], bases: list[np.ndarray], of: np.ndarray, most: np.ndarray, kinds: tuple[int, ...]) -> np.ndarray:
    """Pairs of texts (arrays of code points), ``probes`` with ``bases[of]``, whose Levenshtein distance surely is above ``most`` of the pair, by their grams of ``kinds`` (2 to 4) code points.

    An edit changes one at most of grams that don't overlap, and an alignment of at most k edits with a text that is longer by d places (d may be negative) moves no place by more
    than (k - d) / 2 to the left and (k + d) / 2 to the right. So the distance is no less than the number of disjoint grams of a probe that its base doesn't have near their
    place. Grams that share a cell look alike and places are known by zones, 64 of a text, which only makes pairs look closer. Few bases are fast.
    """
    m, n = np.array([len(t) for t in probes]), np.array([len(t) for t in bases])
    wide, zone, full = -(-max(int(m.max()), int(n.max())) // 64), np.arange(64), ~U(0)
    bits, at = int(np.clip(int(GRAM_CELLS * max(1, int(most.max()))).bit_length(), *CELL_BITS)), np.arange(64 * wide)
    before, behind = (-(-(np.maximum(x, 0) // 2) // wide) for x in (most - n[of] + m, most + n[of] - m))
    first, last = np.maximum(zone - before[:, None], 0), np.minimum(zone + behind[:, None], 63)
    near = ((full << first.astype(U)) & (full >> (63 - last).astype(U)))[:, :, None]

    def placed(texts: list[np.ndarray], name: str) -> np.ndarray:
        points = _room(name, (len(texts), 64 * wide), np.uint32)
        for row, t in zip(points, texts, strict=True):
            row[: len(t)], row[len(t) :] = t, 0
        return points

    def cells(points: np.ndarray, q: int, row: np.ndarray) -> np.ndarray:
        """Cells of the grams from each place on, in the table of ``row``."""
        h, out = _room("h", (len(points), len(at) - q + 1), np.uint32), _room("cells", points.shape, np.intp)
        h[:] = points[:, : h.shape[1]]
        for k in range(1, q):
            h *= np.uint32(0x9E3779B1)
            h ^= points[:, k : len(at) - q + 1 + k]
        h *= np.uint32(0x85EBCA6B)
        h >>= np.uint32(32 - bits)
        np.add(h, (row << bits)[:, None], out=out[:, : h.shape[1]], casting="unsafe")
        out[:, h.shape[1] :] = 0
        return out

    code, ours, theirs = np.zeros((len(m), 64 * wide), np.uint8), placed(probes, "ours"), placed(bases, "theirs")
    for q in kinds:
        table = np.zeros(len(n) << bits, U)
        there = cells(theirs, q, np.arange(len(n))).reshape(len(n), 64, wide)
        for z in range(64):
            table[there[:, z]] |= U(1) << U(z)
        seen = table.take(cells(ours, q, of), out=_room("seen", ours.shape, U), mode="clip").reshape(len(m), 64, wide)
        seen &= near
        absent = (seen == 0).reshape(code.shape)
        absent &= at < (m - q + 1)[:, None]
        ends = code[:, q - 1 :]
        np.maximum(ends, absent[:, : ends.shape[1]].view(np.uint8) * np.uint8(5 - q), out=ends)
    code = code.reshape(len(m), -1, 4)
    free, edits = np.zeros(len(m), np.intp), np.zeros(len(m), np.int64)
    for byte in np.ascontiguousarray((code[:, :, 0] << 6 | code[:, :, 1] << 4 | code[:, :, 2] << 2 | code[:, :, 3]).T):
        free += byte
        edits += _ALONE[free]
        free = _FREE[free]
    return edits > most


def character_bags(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of code points and of their triples by cell."""
    x = points.astype(np.int64)
    triples = (x[:-2] * 40503 + x[1:-1] * 2531 + x[2:] * 97) % 65537 % TRIPLES if len(x) > 2 else x[:0]
    return np.bincount(x % SINGLES, minlength=SINGLES), np.bincount(triples, minlength=TRIPLES)


class Lines:
    """The lines of a task. Which pairs are close enough is found for many pairs at once: an alignment by words bounds the
    distance from above, bit vectors decide the rest."""

    def __init__(self, lines: list[str | None], size: np.ndarray, similarity: float):
        self.lines, self.size, self.similarity = lines, size, similarity
        self.words = cache(lambda i: [w for w in normal_words(lines[i]) if w])
        self.bags, self.counted = [np.zeros((len(lines), n), np.uint16) for n in (SINGLES, TRIPLES)], np.zeros(len(lines), bool)
        self.points = cache(lambda i: np.frombuffer(" ".join(self.words(i)).encode("utf-32-le"), np.uint32))

    def may_reach(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether counts of code points and triples allow pairs the similarity: the edit distance is no less than the code points that one line has
        more of, nor than a third of the triples that it has more of."""
        for u in np.unique(np.concatenate([i, j])):
            if not self.counted[u]:
                self.counted[u] = True
                for bag, counts in zip(self.bags, character_bags(self.points(int(u))), strict=True):
                    bag[u] = np.minimum(counts, 65535)
        most = ((1 - self.similarity) * np.maximum(self.size[i], self.size[j]) + 1e-9).astype(np.int64)
        # counts beyond 65535 are cut: they can't rule out a pair
        out = np.arange(len(i))
        for bag, edits in zip(self.bags, (1, 3), strict=True):
            keep = np.ones(len(out), bool)
            for a in range(0, len(out), 16384):
                some = out[a : a + 16384]
                one, two = bag[i[some]], bag[j[some]]
                more = np.maximum(one, two) - np.minimum(one, two)
                apart, longer = more.sum(axis=1, dtype=np.int64), np.abs(one.sum(axis=1, dtype=np.int64) - two.sum(axis=1, dtype=np.int64))
                keep[a : a + 16384] = (apart + longer) // 2 <= edits * most[some]
            out = out[keep]
        good = np.zeros(len(i), bool)
        good[out] = True
        return good

    def close(self, i: np.ndarray, j: np.ndarray, connect=None) -> np.ndarray:
        """Which pairs reach the similarity. ``connect``, if given, gets pairs that do and
        other pairs, and tells which of the latter are connected by now: those aren't compared further."""
        longer = np.maximum(self.size[i], self.size[j])
        most = ((1 - self.similarity) * longer + 1e-9).astype(np.int64)
        out = np.zeros(len(i), bool)
        by = np.argsort(longer, kind="stable")
        a = 0
        while a < len(by):
            # pairs of up to a quarter more length together, as many as have some million places
            b = int(np.searchsorted(longer[by], longer[by[a]] * 5 // 4 + 16, "right"))
            b = min(b, a + max(1, BATCH_PLACES // int(longer[by[b - 1]] + 1)))
            some, a = by[a:b], b
            for kinds in GRAMS:
                if SHARED_BASE * len(np.unique(i[some])) <= len(some):
                    some = some[~self.unlike(i[some], j[some], most[some], kinds)] if len(some) else some
            if not len(some):
                continue
            out[some] = [words_apart(self.words(x), self.words(y), k) <= k for x, y, k in zip(i[some].tolist(), j[some].tolist(), most[some].tolist(), strict=True)]
            good, some = some[out[some]], some[~out[some]]
            some = some[~connect(i[good], j[good], i[some], j[some])] if connect else some
            some = some[~self.apart(i[some], j[some], most[some])]
            if not len(some):
                continue
            if len(some) < FEW_PAIRS or longer[some[-1]] > LONG_LINE:
                out[some] = [within(self.points(x), self.points(y), self.similarity) for x, y in zip(i[some].tolist(), j[some].tolist(), strict=True)]
            else:
                used, where = np.unique(np.concatenate([i[some], j[some]]), return_inverse=True)
                pairs = list(zip(where[: len(some)].tolist(), where[len(some) :].tolist(), strict=True))
                out[some] = distances([self.points(x) for x in used.tolist()], pairs, most[some]) <= most[some]
        return out

    def unlike(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, kinds: tuple[int, ...]) -> np.ndarray:
        """Pairs that their grams rule out; a batch has few different ``i``."""
        used, of = np.unique(i, return_inverse=True)
        return grams_apart([self.points(x) for x in j.tolist()], [self.points(x) for x in used.tolist()], of, most, kinds)

    def apart(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Pairs that their pieces rule out; those with a line under two pieces are left."""
        swap = self.size[i] > self.size[j]
        short, long = np.where(swap, j, i), np.where(swap, i, j)
        out, at = np.zeros(len(i), bool), np.flatnonzero(self.size[short] >= 2 * PIECE)
        if len(at):
            out[at] = surely_apart(*([self.points(x) for x in side[at].tolist()] for side in (short, long)), most[at])
        return out


def verified_forest(lines: list[str | None], size: np.ndarray, keys: np.ndarray, sim: np.ndarray, run: np.ndarray, key: np.ndarray, stored: np.ndarray, label: np.ndarray, apart: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places that connect what verified candidate pairs of a run connect; one of a pair is ``stored``, and the run's ``key`` is the
    first that both share. ``run`` ascends; ``label``: what is connected already.

    The runs go on side by side: in each round a line of each run meets those behind it that it isn't connected with yet. Pairs that pass the
    filters are gathered and verified many at once, as a step of the bit vectors costs the same for one pair and for hundreds.
    """
    text, label, edges, n = Lines(lines, size, similarity), label.copy(), [], len(lines)
    first = np.append(0, np.flatnonzero(run[1:] != run[:-1]) + 1)
    last = np.append(first[1:], n)
    at, last = first[last - first > 1], last[last - first > 1]
    held, n_held = [], 0

    def connect(i: np.ndarray, j: np.ndarray, others: np.ndarray, with_: np.ndarray) -> np.ndarray:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if label[a] != label[b]:
                edges.append((a, b))
                label[label == label[b]] = label[a]
        return label[others] == label[with_]

    def link(held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*held, strict=True) if held else ((), ())))
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        if len(i):
            good = text.close(i, j, connect)
            connect(i[good], j[good], i[:0], j[:0])

    while len(at):
        behind = last - at - 1
        i = np.repeat(at, behind)
        j = np.arange(int(behind.sum())) + np.repeat(at + 1 - (np.cumsum(behind) - behind), behind)
        for may in (
            lambda i, j: (label[i] != label[j]) & (stored[i] | stored[j]),
            lambda i, j: candidates(sim[i], size[i], sim[j], size[j], apart, similarity),
            lambda i, j: keys[i, (keys[i] == keys[j]).argmax(axis=1)] == key[i],
            text.may_reach,
        ):
            good = may(i, j)
            i, j = i[good], j[good]
        held.append((i, j))
        n_held += len(i)
        if n_held >= GATHERED:
            link(held)
            held, n_held = [], 0
        at = at + 1
        at, last = at[last - at > 1], last[last - at > 1]
    link(held)
    return edges


def _verify(apart: int, similarity: float):
    """Rows (cluster, task, stored, id, label, length, sim, keys, line), sorted by the first two -> forest of verified pairs. Whole runs
    are taken together until ``TOGETHER`` lines are there."""

    def forest(rows):
        run, key, stored, ids, label, length, sim, keys, lines = zip(*rows, strict=True)
        # connected are rows of one label in one run: elsewhere they may be so by pairs of another task only
        label = np.unique(np.stack([np.array(run), np.array(label)]), axis=1, return_inverse=True)[1].reshape(-1)
        pairs = verified_forest(list(lines), np.array(length, np.int64), np.array(keys), np.array(sim, np.int64).view(U), np.array(run), np.array(key), np.array(stored), label, apart, similarity)
        return pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, number = None, [], 0
        for batch in batches:
            for c, t, *row in zip(*(batch.column(x).to_pylist() for x in ("cluster", "task", "stored", "id", "label", "length", "sim", "keys", "line")), strict=True):
                if (c, t) != at:
                    if len(rows) > TOGETHER:
                        yield forest(rows)
                        rows = []
                    at, number = (c, t), number + 1
                rows.append((number, c, *row))
        if rows:
            yield forest(rows)

    return run


def _verified(texts: DataFrame, tasks: DataFrame, apart: int, similarity: float, name: str) -> DataFrame:
    """Verified pairs (src, dst) of the tasks' rows (doc_id, line_no, id, length, sim, keys, label, cluster, todo)."""
    tasks = materialize(tasks.select("doc_id", "line_no", "id", "length", "sim", "keys", "label", "cluster", "todo"), "line-tasks")
    by_doc = tasks.groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "id")).alias("at"))  # lines of one document
    rows = texts.join(small_side(materialize(by_doc, "line-wanted"), items="at"), "doc_id").select(F.split("text", "\n").alias("all"), F.explode("at").alias("x"))
    rows = rows.select("x.id", F.get("all", F.col("x.line_no")).alias("line")).join(tasks, "id").withColumn("to", F.explode("todo"))
    rows = rows.select("cluster", "to.task", "to.stored", "id", "label", "length", "sim", "keys", "line").repartition("cluster", "task").sortWithinPartitions("cluster", "task")
    return materialize(rows.mapInArrow(_verify(apart, similarity), "src long, dst long"), name)


def line_duplicates(docs: DataFrame, least_words: int = LEAST_WORDS, apart: int = BITS_APART, similarity: float = SIMILARITY, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(doc_id, removed): per document the numbers (from 0) of the lines to remove; documents without any are absent."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    lines = materialize(texts.mapInArrow(_profiles(least_words), "doc_id long, line_no int, hi long, lo long, sim long, length int, " + ", ".join(f"{k} long" for k in PAIRED)), "lines")
    # numbers only, so that the aggregates hash: a place is doc_id * 2^31 + line number
    place = F.col("doc_id").cast("decimal(38,0)") * (1 << 31) + F.col("line_no")
    classes = lines.groupBy("hi", "lo").agg(F.min(place.cast("decimal(38,0)")).alias("place"), *(F.max(c).alias(c) for c in ("sim", "length", *PAIRED)))
    keys = F.flatten(F.array(*[F.array(F.col(k).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(k, 32)) for k in PAIRED]))
    doc = F.floor(F.col("place") / (1 << 31)).cast("long")
    classes = classes.select(F.monotonically_increasing_id().alias("id"), doc.alias("doc_id"), (F.col("place") - doc.cast("decimal(38,0)") * (1 << 31)).cast("int").alias("line_no"), "place", "sim", "length", keys.alias("keys"))
    classes = materialize(classes, "line-classes")

    runs = classes.select(F.explode("keys").alias("key"), "id", "sim", "length").repartition("key").sortWithinPartitions("key")
    close = materialize(runs.mapInArrow(_close_lines(apart, similarity), "key long, id long"), "line-close")

    members = classes.withColumn("weight", F.col("length").cast("long")).drop("place").join(close.withColumnRenamed("key", "cluster"), "id")
    members = materialize(in_blocks(materialize(members, "line-members"), block_lines, BLOCK_CHARS), "line-placed")
    found = _verified(texts, within_tasks(members, ANCHORS), apart, similarity, "line-within")
    large = members.where("k > 1")
    if not large.isEmpty():
        found = found.unionByName(_verified(texts, across_tasks(large, found, block_lines, BLOCK_CHARS, "line-parts"), apart, similarity, "line-across"))
    linked = materialize(connected_components(found, "line-links"), "line-links")

    linked = small_side(linked.withColumnRenamed("node", "id"))
    kept = classes.select("id", "place").join(linked, "id", "left").groupBy(F.coalesce("component", "id").alias("g")).agg(F.min("place").alias("place"))
    kept = kept.join(classes.select("place", "doc_id", "line_no"), "place").select("doc_id", "line_no")
    return lines.select("doc_id", "line_no").join(kept, ["doc_id", "line_no"], "left_anti").groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``text`` less its duplicate lines, and columns n_lines, n_removed (long)."""
    docs = docs.drop("n_lines", "n_removed")
    gone = materialize(line_duplicates(docs, **options), "line-removed")
    rows = docs.join(small_side(gone.withColumnRenamed("removed", "tenure_removed"), items="tenure_removed"), "doc_id", "left")
    every = F.split("text", "\n")
    kept = F.array_join(F.filter(every, lambda x, i: ~F.array_contains("tenure_removed", i)), "\n")
    rows = rows.withColumn("n_lines", F.coalesce(F.size(every), F.lit(0)).cast("long")).withColumn("n_removed", F.coalesce(F.size("tenure_removed"), F.lit(0)).cast("long"))
    return rows.withColumn("text", F.when(F.col("tenure_removed").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns, "n_lines", "n_removed")
