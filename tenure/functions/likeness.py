"""Likeness of two short texts from 0 to 1 by inserted and deleted code points, alone, by words and in part, and the mixed ratio of them.

All are column expressions. A text is compared as it is; case and spaces count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenure.functions.patterns import let

# Fixed values of the mixed ratio: weight of ratios by words, lengths from this quotient on are compared in part, with this weight, and beyond the last quotient with the least.
BY_WORDS, IN_PART_FROM, IN_PART, FAR_FROM, FAR = 0.95, 1.5, 0.9, 8.0, 0.6
#: Places of a pattern that one long holds, a bit in hand for the carry.
_BITS = 62


def chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def tokens(s: Column) -> Column:
    """The words of a text in order; equal words stay."""
    return F.sort_array(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""))


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by bit vectors where the shorter text has 62 code points at most, else by a table's rows."""
    shift = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    zero = F.lit(0).cast("long")

    def bits(p: Column, t: Column) -> Column:
        full = shift(F.size(p)) - 1

        def step(s: Column, c: Column) -> Column:
            places = F.aggregate(F.transform(p, lambda x, i: F.when(x == c, shift(i)).otherwise(zero)), zero, lambda acc, x: acc + x)
            return let(s.bitwiseAND(places), lambda u: (s + u).bitwiseOR(s - u).bitwiseAND(full))

        return F.size(p) - F.bit_count(F.aggregate(t, full, step))

    def table(p: Column, t: Column) -> Column:
        first = F.array_repeat(F.lit(0), F.size(t) + 1)

        def row(above: Column, x: Column) -> Column:
            cell = lambda left, j: F.when(F.get(t, j - 1) == x, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), F.element_at(left, -1)))
            whole = F.aggregate(F.sequence(F.lit(1), F.size(t)), F.array(F.lit(0)), lambda left, j: F.concat(left, F.array(cell(left, j))))
            return F.when(F.size(t) > 0, whole).otherwise(above)

        return F.element_at(F.aggregate(p, first, row), -1)

    def lengths(p: Column, t: Column) -> Column:
        return F.when(F.size(p) <= _BITS, bits(p, t)).otherwise(table(p, t))

    return let(chars(a), lambda x: let(chars(b), lambda y: F.when(F.size(x) <= F.size(y), lengths(x, y)).otherwise(lengths(y, x))))


def ratio(a: Column, b: Column) -> Column:
    """Twice the common length by the sum of the lengths; 1 for two empty texts."""
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2.0 * common_length(a, b) / (F.length(a) + F.length(b)))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(joined(tokens(a)), joined(tokens(b)))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best of: the common words against the common and the further words of either text, and both texts' words with the common ones first. 1 if one text's words are all in the other, 0 without words."""

    def of(x: Column, y: Column) -> Column:
        return let(F.array_intersect(x, y), lambda both: let(joined(F.array_except(x, y)), lambda p: let(joined(F.array_except(y, x)), lambda q: best(F.size(both), F.length(joined(F.sort_array(both))), p, q))))

    def best(n: Column, common: Column, p: Column, q: Column) -> Column:
        gap = F.when(n > 0, 1).otherwise(0)
        one, two = common + gap + F.length(p), common + gap + F.length(q)
        apart = F.length(p) + F.length(q) - 2 * common_length(p, q)
        part = lambda whole, rest: 1.0 - (gap + F.length(rest)) / (common + whole)
        rest = 1.0 - apart / (one + two)
        return F.when((n > 0) & ((F.length(p) == 0) | (F.length(q) == 0)), 1.0).when(n > 0, F.greatest(rest, part(one, p), part(two, q))).otherwise(rest)

    words = lambda s: F.array_distinct(tokens(s))
    return let(words(a), lambda x: let(words(b), lambda y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(of(x, y))))


def partial_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the shorter text with a stretch of the longer: all of its length, and shorter ones at either end. Texts of one length are taken either way."""

    def stretches(s: Column, t: Column) -> Column:
        n, m = F.length(s), F.length(t)
        upto = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<int>"))
        one = F.lit(1)
        cuts = [F.transform(upto(one, n - 1), lambda i: F.left(t, i)), F.transform(upto(one, m - n + 1), lambda i: F.substr(t, i, n)), F.transform(upto(m - n + 2, m), lambda i: F.substr(t, i))]
        return F.array_max(F.transform(F.concat(*cuts), lambda w: ratio(s, w)))

    def of(s: Column, t: Column) -> Column:
        n, m = F.length(s), F.length(t)
        both = F.when(n < m, stretches(s, t)).when(n > m, stretches(t, s)).otherwise(F.greatest(stretches(s, t), stretches(t, s)))
        return F.when(n + m == 0, 1.0).when((n == 0) | (m == 0), 0.0).otherwise(both)

    return let(a, lambda s: let(b, lambda t: of(s, t)))


def partial_token_ratio(a: Column, b: Column) -> Column:
    """1 for a common word, else the partial ratio of the texts' sorted words, and of their different sorted words."""
    words = lambda s: F.array_distinct(tokens(s))
    apart = lambda: F.greatest(partial_ratio(joined(tokens(a)), joined(tokens(b))), partial_ratio(joined(words(a)), joined(words(b))))
    return F.when(F.arrays_overlap(tokens(a), tokens(b)), 1.0).otherwise(apart())


def mixed_ratio(a: Column, b: Column) -> Column:
    """The weighted best of the ratios: whole texts, by words for texts of similar lengths, in part for others. 0 if a text is empty."""

    def of(s: Column, t: Column) -> Column:
        n, m = F.length(s), F.length(t)
        times = F.greatest(n, m) / F.least(n, m)
        whole = F.greatest(token_sort_ratio(s, t), token_set_ratio(s, t)) * BY_WORDS
        weight = F.when(times <= FAR_FROM, IN_PART).otherwise(FAR)
        part = F.greatest(partial_ratio(s, t), partial_token_ratio(s, t) * BY_WORDS) * weight
        return F.when((n == 0) | (m == 0), 0.0).when(times < IN_PART_FROM, F.greatest(ratio(s, t), whole)).otherwise(F.greatest(ratio(s, t), part))

    return let(a, lambda s: let(b, lambda t: of(s, t)))
