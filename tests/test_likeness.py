"""The mixed ratio and its parts against plain Python, and the lossless filters of its candidates."""

import itertools
import random

from pyspark.sql import functions as F

from tenure.functions import likeness
from tenure.operators import catalog

PARTS = ("ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio", "partial_token_ratio", "mixed_ratio")


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return row[-1]


def ratio(a, b):
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_ratio(a, b):
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, p, q = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not p or not q):
        return 1.0
    gap = 1 if both else 0
    one, two = len(both) + gap + len(p), len(both) + gap + len(q)
    best = 1 - (len(p) + len(q) - 2 * common(p, q)) / (one + two)
    return max(best, 1 - (gap + len(p)) / (len(both) + one), 1 - (gap + len(q)) / (len(both) + two)) if both else best


def partial_ratio(a, b):
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    cuts = [b[:i] for i in range(1, n)] + [b[i : i + n] for i in range(m - n + 1)] + [b[i:] for i in range(m - n + 1, m)]
    best = max(ratio(a, w) for w in cuts)
    return max(best, *(ratio(b, w) for w in [a[:i] for i in range(1, n)] + [a] + [a[i:] for i in range(1, n)])) if n == m else best


def partial_token_ratio(a, b):
    x, y = a.split(), b.split()
    if set(x) & set(y):
        return 1.0
    return max(partial_ratio(" ".join(sorted(x)), " ".join(sorted(y))), partial_ratio(" ".join(sorted(set(x))), " ".join(sorted(set(y)))))


def mixed_ratio(a, b):
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    if times < 1.5:
        return max(ratio(a, b), 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    weight = 0.9 if times <= 8 else 0.6
    return max(ratio(a, b), weight * partial_ratio(a, b), 0.95 * weight * partial_token_ratio(a, b))


PAIRS = [("", ""), ("", "a"), ("abc", "abc"), ("Java", "java"), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear"), ("fuzzy was a bear", "fuzzy fuzzy was a bear"), ("this is a test", "this is a test!"), ("yankees", "new york yankees"),
         ("mets", "new york mets at atlanta braves"), ("a" * 70 + "b", "a" * 65 + "c" + "b"), ("é ü", "ü é"), ("  two  spaces ", "two spaces")]


def test_ratios(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 4)))
    pairs = PAIRS + [(text(), text()) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", *[getattr(likeness, f)(F.col("a"), F.col("b")).alias(f) for f in PARTS]).collect()
    for r in got:
        for f in PARTS:
            assert abs(r[f] - globals()[f](r.a, r.b)) < 1e-9, (f, r)
    known = {(r.a, r.b): r for r in got}
    assert known["fuzzy was a bear", "fuzzy fuzzy was a bear"].token_set_ratio == 1.0 and known["fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear"].token_sort_ratio == 1.0
    assert known["yankees", "new york yankees"].partial_ratio == 1.0 and known["yankees", "new york yankees"].mixed_ratio == 0.9


def test_mixed_candidates_lose_no_pair(spark):
    """All pairs by brute force, for skills' and roles' cutoffs: misspelt, swapped, dropped and added words, parts of longer texts."""
    rng = random.Random(9)
    names = ["data engineer", "senior java developer", "project manager", "sql", "machine learning", "go", "vice president of engineering", "apache spark streaming", "c++", "quality assurance test automation engineer"]
    asked = set(names)
    for name in names:
        w = name.split()
        asked |= {" ".join(rng.sample(w, len(w))), " ".join(w[1:]) or "x", name + " lead", "the " + name, name.upper(), name.replace(" ", ""), name[:-1], name[0] + name}
        for _ in range(6):
            k = rng.randrange(len(name))
            asked.add(name[:k] + rng.choice(["", "x", name[k] * 2]) + name[k + 1 :])
    texts, pool = spark.createDataFrame([(a,) for a in asked], "key string"), spark.createDataFrame([(n, n) for n in names], "key string, entity string")
    for least in (0.88, 0.85):
        got = {(r.key, r.entity): r.ratio for r in catalog.mixed_candidates(texts, pool, least).collect()}
        want = {(a, n): mixed_ratio(a, n) for a, n in itertools.product(asked, names) if a and mixed_ratio(a, n) >= least}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 60


def test_pools_and_cascade(spark):
    names = spark.createDataFrame([("Node.js", True), ("Java", True), ("Old Tool", False)], "entity string, active boolean")
    aliases = spark.createDataFrame([("Node.js", "Node Server"), ("Java", "java"), ("Old Tool", "old")], "entity string, alias string")
    assert {(r.key, r.entity) for r in catalog.fuzzy_pool(names, aliases).collect()} == {("nodejs", "Node.js"), ("java", "Java"), ("node server", "Node.js")}
    assert {(r.key, r.entity) for r in catalog.fuzzy_pool(names, aliases, loose_names=False).collect()} == {("node.js", "Node.js"), ("java", "Java"), ("node server", "Node.js")}
    asked = spark.createDataFrame([("server node",), ("node.js",), ("NODE.JS",), ("javas",), ("cobol",)], "text string")
    got = {r.text: (r.entity, r.method, r.confidence) for r in catalog.resolve(asked, names, aliases, pool=catalog.fuzzy_pool(names, aliases)).collect()}
    assert got == {"server node": ("Node.js", "FUZZY", 0.95), "node.js": ("Node.js", "EXACT", 1.0), "NODE.JS": ("Node.js", "EXACT", 1.0), "javas": ("Java", "FUZZY", 0.8889)}
