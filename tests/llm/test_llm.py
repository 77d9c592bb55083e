"""The training-data operators against brute force on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tenure.llm import fingerprints, html_text, labels, line_dedup, mixing, ngram_join, packing, quality_cnn, quality_rules, token_counts, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hi long"


@pytest.fixture(scope="module")
def docs(spark):
    given = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 0) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = "word " * 30_000 + "end"
    odd = [(9001, None, None, None, None, 1), (9002, "", "en", "a", 0, 1), (9003, " \n\t ", "en", None, 4, 1), (9004, long, "en", "a", 1, 1), (9005, long + " x", "en", "a", 1, 1), (9006, "two  spaces  here", "en", "a", 1, 1), (9007, "One", "en", "b", 1, 1)]
    return spark.createDataFrame(given + odd, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def linked(sets, num, den):
    """Component of each set by brute force."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def ngrams(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return set(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else {tuple(w)} if w else set()


def test_ngram_components(docs, empty):
    sets = {r.doc_id: ngrams(r.text, 3) for r in docs.collect()}
    component = linked(sets, 90, 100)
    want = {i: (len(s), component[i]) for i, s in sets.items()}
    for bound in (ngram_join.BLOCK_NGRAMS, 300):  # whole clusters, and clusters in blocks
        got = ngram_join.ngram_components(docs, block_ngrams=bound)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    assert ngram_join.ngram_components(empty).count() == 0


def test_ngram_components_in_blocks(spark, monkeypatch):
    """Copies that link, and copies of the same text that link with nothing, over many blocks."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(300)]
    given = []
    for k in range(120):
        w = list(base)
        for i in rng.choice(300, 2 if k % 3 else 12, replace=False):
            w[i] = f"x{k}y{i}"
        given.append((k, " ".join(w)))
    given += [(k, given[k - 7][1]) for k in (120, 121)] + [(None, given[0][1])]
    df = spark.createDataFrame(given, "doc_id long, text string")
    want = linked({i: ngrams(t, 3) for i, t in given if i is not None}, 90, 100)
    assert len(set(want.values())) > 20 and max(Counter(want.values()).values()) > 20
    for sets, anchors in ((10, 3), (10, 0), (30, 3), (1000, 0)):
        monkeypatch.setattr(ngram_join, "ANCHORS", anchors)
        assert {r.doc_id: r.component_id for r in ngram_join.ngram_components(df, block_sets=sets).collect() if r.doc_id is not None} == want


def test_prefix_tree_of_many_unlinked_sets():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 80, dtype=np.uint64)
    sets = []
    for _ in range(2000):
        own = rng.integers(0, 2**64, int(rng.integers(2, 16)), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base[rng.random(80) > len(own) / 80], own])))
    words, which = np.unique(np.concatenate(sets), return_inverse=True)
    holds = np.zeros((len(sets), len(words)), np.float32)
    holds[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), which] = 1
    size = holds.sum(axis=1)
    link = (holds @ holds.T) * 190 >= 90 * (size[:, None] + size)
    want = np.arange(len(sets))
    while True:
        new = np.where(link, want, len(sets)).min(axis=1)
        if (new == want).all():
            break
        want = new
    for stored in (np.ones(2000, bool), np.arange(2000) < 2000):
        got = np.arange(len(sets))
        for i, j in ngram_join.join_group(sets, stored, np.arange(len(sets)), 90, 100):
            a, b = sorted((got[i], got[j]))
            got[got == b] = a
        assert (got == want).all() and 100 < len(np.unique(got)) < 1990
    stored = np.arange(2000) < 300
    pairs = ngram_join.join_group(sets, stored, np.arange(len(sets)), 90, 100)
    assert all(link[i, j] and (stored[i] or stored[j]) for i, j in pairs)
    reached = {x for p in pairs for x in p}
    assert reached == set(np.flatnonzero((link & ~np.eye(2000, dtype=bool) & (stored | stored[:, None])).any(axis=1)).tolist())


def test_segment_keys_lose_no_pair():
    rng = np.random.Generator(np.random.PCG64(5))
    for size in [*range(9, 60), 200, 700, 1500]:
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        for _ in range(5):
            change = rng.integers(0, len(a) // 10 + 1)
            b = np.unique(np.concatenate([a[change:], rng.integers(0, 2**64, int(rng.integers(0, change + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and len(a) != both and 100 * both >= 90 * (len(a) + len(b) - both):
                x, y = ngram_join.segment_keys([a, b], ngram_join.Bands(90, 100))
                assert len(np.intersect1d(x, y))


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    docs = docs.unionByName(docs.sparkSession.createDataFrame([(9100, "a <|endoftext|> b<|endoftext|>", "en", "a", 1, 1), (9101, "<|endoftext|><|endoftext|  >", "en", "a", 1, 1)], SCHEMA))
    t = Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    found = packing.pack(docs, island_items=64).toPandas()
    assert found.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in ids.items()}
    for r in found.itertuples():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], np.uint32).tobytes()) == r.ids_crc32
    for _, g in found.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.length.sum() <= 1024 and (g.offset.values == np.cumsum(g.length.values) - g.length.values).all()
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 1024) * 1.05 + 1
    assert 50256 in ids[9100]
    assert packing.pack(empty).count() == 0


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.document_token_counts(docs).collect()} == want
    assert token_counts.document_token_counts(empty).count() == 0
    odd = docs.sparkSession.createDataFrame([(1, "<|endoftext|> x", 7), (1, "<|endoftext|> x", 8), (None, None, 9)], "doc_id long, text string, n_tokens long")
    t.encode_special_tokens = True  # the operator's own rule: text is no separator
    n = len(t.encode("<|endoftext|> x", add_special_tokens=False).ids)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.document_token_counts(odd).collect()) == [(0, 0), (1, n), (1, n)]
    folder, _ = token_counts.write_token_files(docs)
    a, b = (token_counts.scan_token_files(docs.sparkSession, folder, block_bytes=n).toPandas().sort_values(["path", "ordinal"]).values.tolist() for n in (1 << 22, 34))
    assert a == b


def test_fingerprints(docs, empty):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(text)
    got = rows(fingerprints.fingerprint_edits(docs))
    for k, i in enumerate(ids):
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + text[ids[(k + 1) % len(ids)]][:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text[i])
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    same = {}
    for i in ids:
        assert same.setdefault(text[i], got[i].fingerprint) == got[i].fingerprint
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_base_statistics(docs, empty):
    got = rows(quality_rules.judge(docs))
    for r in docs.collect():
        x = r.text or ""
        w = WORD.findall(x)
        lines = [s for s in x.split("\n") if WORD.search(s)]
        grams = list(zip(w, w[1:], w[2:], strict=False))
        often = Counter(grams)
        covered = {i + d for i, g in enumerate(grams) if often[g] > 1 for d in range(3)}
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered))
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (g.base_failed and g.kept)
    assert quality_rules.judge(empty).count() == 0


def mcd(x, share, steps):
    """Location and floored scatter of the better start, on the grids of the operator."""
    floors = np.diag(np.array(quality_rules.FLOORS) ** 2)

    def scatter(rows):
        c = rows.T @ rows / len(rows) - np.outer(rows.mean(0), rows.mean(0))
        np.fill_diagonal(c, np.maximum(np.diag(c), 0))
        return rows.mean(0), c + floors

    def median(v):
        v = np.sort(v)
        return v[(len(v) + 1) // 2 - 1]

    cells = (np.floor(x * 256) + 0.5) / 256
    med = np.array([median(c) for c in cells.T])
    mad = np.array([median(c) for c in np.abs(cells - med).T])
    best = None
    for m, c in (scatter(x), (med, np.diag((mad * 1.4826) ** 2) + floors)):
        for _ in range(steps):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            cell = np.floor(np.log1p(d) * 64)
            m, c = scatter(x[[(cell < k).sum() < len(x) * share for k in cell]])
        if best is None or np.linalg.slogdet(c)[1] < best[0] - 1e-9:
            best = np.linalg.slogdet(c)[1], m, c
    return best[1:]


def test_outlier_verdict_against_numpy(spark):
    q, source = quality_rules, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = source.withColumn("source", source.source.substr(-1, 1)).where("doc_id < 600")
    base = q._transformed(q.base_statistics(source)).toPandas()
    failed = (base.n_words < 50) | (base.n_repeat_words * 100 > 50 * base.n_words)
    x = base[list(q.FEATURES)].to_numpy()
    top = mcd(x[~failed], q.SHARE, q.STEPS)
    factor, bound = q.consistency(q.SHARE, q.CUTOFF)
    blend = lambda n, own, upper: [(n * a + q.PRIOR * b) / (n + q.PRIOR) for a, b in zip(own, upper, strict=True)]
    want, sizes = {}, []
    for lang in base.lang.unique():
        rows = (base.lang == lang) & ~failed
        coarse = blend(rows.sum(), mcd(x[rows], q.SHARE, q.STEPS), top)
        for src in base.source.unique():
            mine = (base.lang == lang) & (base.source == src)
            n = (mine & ~failed).sum()
            sizes.append(n)
            m, c = blend(n, mcd(x[mine & ~failed], q.SHARE, q.STEPS), coarse) if n else coarse
            for k in np.flatnonzero(mine):
                d = (x[k] - m) @ np.linalg.inv(c) @ (x[k] - m) / factor
                want[base.doc_id[k]] = (d, not failed[k] and d <= bound)
    got = {r.doc_id: r for r in q.judge(source).collect()}
    assert min(sizes) < 20 < max(sizes) and {i for i, w in want.items() if not w[1] and not got[i].base_failed}
    assert all(got[i].kept == kept and got[i].distance == pytest.approx(d, rel=1e-6) for i, (d, kept) in want.items())


def test_mixing(docs, empty):
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    total = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left = {}, 1.5 * sum(total.values())
    while True:
        rest = [s for s in names if s not in target]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > 2 * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in rest}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
    found = mixing.mix_sources(docs, bucket_rows=16)
    got = rows(found)
    assert all(got[i].size == size[i] and got[i].target == pytest.approx(target[source[i]]) and got[i].taken <= 2 * size[i] for i in size)
    for s in names:
        longest = max(size[i] for i in size if source[i] == s)
        assert abs(sum(got[i].taken for i in size if source[i] == s) - target[s]) <= longest
    assert rows(mixing.mix_sources(docs, bucket_rows=16)) == got
    assert mixing.mix_sources(empty).count() == 0


def test_taken_rows_are_the_mix(spark, docs, empty):
    epochs = {i: r.epochs for i, r in rows(mixing.mix_sources(docs)).items() if r.epochs}
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    assert Counter(r.doc_id for r in taken.collect()) == epochs
    assert mixing.take_mix(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b", None), (1, "x", "s"), (1, "x", "s"), (2, None, "s")], "doc_id long, text string, source string")
    assert {r.doc_id for r in mixing.take_mix(odd).collect()} <= {None, 1, 2}


def test_fingerprints_against_brute_force(spark):
    import math

    import regex
    import xxhash

    fp = fingerprints
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of_long = lambda v, seed=42: xxhash.xxh64(v.to_bytes(8, "little", signed=True), seed).intdigest()
    of_int = lambda v, seed: xxhash.xxh64(v.to_bytes(4, "little", signed=True), seed).intdigest()

    def of_longs(values):
        h = 42
        for v in values:
            h = h if v is None else of_long(v, h)
        return h

    terms = lambda t: {signed(xxhash.xxh64(w.encode(), 42).intdigest()) for w in regex.findall(r"[\p{L}\p{N}]+", t.lower())}
    df = Counter(h for t in texts.values() for h in terms(t))
    lexicon = {h for h, n in df.items() if n > 1 and fp.IDF_LOW <= math.log(len(texts) / n) <= fp.IDF_HIGH}

    def prints(text):
        every, kept = sorted(terms(text)), sorted(terms(text) & lexicon)
        drawn = [[h for h in kept if of_int(k, of_long(h)) & ((1 << bits) - 1) == 0] for k, bits in enumerate(fp.SUBSETS)]
        sigs = [signed(of_longs(d)) if d else None for d in drawn]
        main = of_longs(kept) if len(kept) >= fp.THIN else of_longs(every)
        return f"{main:016x}-{of_longs(sigs):016x}", sigs

    def likeness(a, b):
        seen = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x is not None or y is not None]
        return sum(x == y for x, y in seen) / len(seen) if seen else float(a[0] == b[0])

    got, ids = rows(fp.fingerprint_edits(spark.read.parquet(f"{SF}/documents.parquet"))), sorted(texts)
    own = {i: prints(texts[i]) for i in ids}
    for k, i in enumerate(ids):
        after = ids[(k + 1) % len(ids)]
        half = len(texts[i]) // 2
        edited = prints(texts[i][: len(texts[i]) - half] + texts[after][:half])
        want = (own[i][0], edited[0], likeness(own[i], edited), likeness(own[i], own[after]))
        assert (got[i].fingerprint, got[i].edited_fingerprint, got[i].near_edited, got[i].near_next) == want


def test_ranges_of_ids(spark):
    for n in (1, 2, 5, 17):
        bounds = [3 * i for i in range(n)]
        got = spark.range(-2, 3 * n + 2).select(F.col("id").alias("doc_id")).select("doc_id", fingerprints.range_of(bounds).alias("r")).collect()
        assert {r.doc_id: r.r for r in got} == {i: min(i // 3, n - 1) if i >= 0 else -1 for i in range(-2, 3 * n + 2)}


def test_repeated_and_missing_ids_in_fingerprints(spark):
    given = [(1, "a b c d"), (1, "a b c d"), (1, "x y"), (None, "q"), (None, "q"), (3, None), (5, "zz yy")]
    found = fingerprints.fingerprint_edits(spark.createDataFrame(given, "doc_id long, text string")).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # the smallest text of id 1 follows id 5; nothing follows the rows without an id
    want = [(1, sha("a b ")), (1, sha("a b ")), (1, sha("x ")), (None, sha("q")), (None, sha("q")), (3, sha("")), (5, sha("zz a "))]
    assert Counter((r.doc_id, r.edited_sha256) for r in found) == Counter(want)
    assert all((r.near_next is None) == (r.doc_id is None) for r in found)


def test_mixing_equals_sql(spark):
    from tenure.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES["op10_source_mixing"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in queries.op10_source_mixing(spark, SF).collect())


def test_lines(spark, empty):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3
    near = line.replace("omicron pi", "omicron pie", 1)
    other = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(40))
    df = spark.createDataFrame([(1, line + "\nshort one"), (2, "Title\n" + line.upper() + "\n" + other), (3, near + "\nshort one"), (4, None), (5, "")], "doc_id long, text string")
    got = rows(line_dedup.dedup_lines(df))
    assert got[1].text == line + "\nshort one" and got[2].text == "Title\n" + other
    assert got[3].text == "short one"
    assert got[4].text is None and got[5].text == ""
    clash = df.withColumn("n_lines", df.doc_id * 0 - 1).withColumn("extra", df.doc_id + 1)
    clash = line_dedup.dedup_lines(clash)
    assert clash.columns == ["doc_id", "text", "extra", "n_lines", "n_removed"]
    assert {r.doc_id: (r.extra, r.n_lines) for r in clash.collect()} == {i: (i + 1, r.n_lines) for i, r in got.items()}
    sims = np.array([0, 7, 0xFF, 1 << 60], np.uint64)
    assert {frozenset(e) for e in line_dedup.close_forest(sims, 3)} == {frozenset((0, 1)), frozenset((0, 3))}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_classifiers(spark, docs, empty):
    known = spark.read.parquet(f"{SF}/labels.parquet")
    for found, bound in ((toxicity.score_toxicity(docs, known), 0.5), (quality_cnn.score_quality(docs, known, sample=60), 0.3)):
        got = rows(found)
        assert len(got) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= bound) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert toxicity.score_toxicity(empty, known).count() == 0 and quality_cnn.score_quality(empty, known.limit(0)).count() == 0
    assert labels.training_sample(docs, known, "toxic", 10).where(labels.held_out()).count() == 0


def test_gradients_are_the_losses_own(spark, monkeypatch):
    found = labels.training_sample(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), "quality", 30).orderBy("doc_id").collect()
    texts, label = [r.text.encode() for r in found], np.array([r.label for r in found], np.float32)
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    rng = np.random.default_rng(1)

    monkeypatch.setattr(toxicity, "CELLS", 1 << 18)
    cell, first, of, _ = toxicity.bags(data, offsets)
    weights = rng.normal(0, 0.3, toxicity.CELLS + 1)
    weights[-1] = -3
    g = toxicity.gradient(weights, cell, first, of, label)
    for k in [*rng.choice(np.unique(cell), 12), toxicity.CELLS]:
        up, down = weights.copy(), weights.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        assert g[k] == pytest.approx((toxicity.loss(up, cell, first, of, label) - toxicity.loss(down, cell, first, of, label)) / 2e-4, rel=1e-4, abs=1e-9)

    net = {k: x.astype(np.float64) for k, x in quality_cnn.start().items()}
    net["u"], net["b"] = rng.normal(0, 0.3, net["u"].shape), rng.normal(0, 0.1, net["b"].shape)
    text, hops = quality_cnn.padded(data, offsets)
    g = quality_cnn.gradient(net, text, hops, label)
    for name in net:
        for k in rng.choice(net[name].size, min(6, net[name].size), replace=False):
            ends = []
            for step in (1e-5, -1e-5):
                moved = {n: x.copy() for n, x in net.items()}
                moved[name].reshape(-1)[k] += step
                ends.append(quality_cnn.loss(moved, text, hops, label))
            assert g[name].reshape(-1)[k] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=2e-2, abs=2e-6), (name, k)


def test_training_is_bounded(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["ab", "cdé", "f", "g" * 9]})
    assert [b.num_rows for b in labels.in_bound(iter([batch, batch]), 7)] == [3]
    assert [b.num_rows for b in labels.in_bound(iter([batch, batch]), 100)] == [4, 4]
    monkeypatch.setattr(labels, "LONGEST_BYTES", 3)
    df = spark.createDataFrame([(1, "abc", 1), (2, "abcd", 1), (2, None, 1)], "doc_id int, text string, hi int")
    known = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1)], "doc_id int, toxic int")
    assert {(r.doc_id, r.text, r.label) for r in labels.training_sample(df, known, "toxic", 9).collect()} <= {(1, "abc", 1), (2, "", 1)}


def test_cnn_blocks_and_neighbours_don_t_matter(monkeypatch):
    net = quality_cnn.start()
    net["u"][:] = 0.1
    texts = [b"", b"abc def " * 400, b"%%% !!", b"x" * 255]
    data = np.frombuffer(b"".join(texts), np.uint8)
    together = quality_cnn.predict(net, data, np.cumsum([0, *map(len, texts)]))
    monkeypatch.setattr(quality_cnn, "BLOCK", 256)
    alone = [quality_cnn.predict(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_html():
    page = "<head><title>x</title></head><p>One<p>Two <b>bold</b> &amp; more<ul><li>a<li>b<ol><li>c</ol></ul><table><tr><td>aa<td>b<tr><td>c<td>dddd</table><div style='display: none'>no</div><pre>x\n  y</pre>tail<br>line</b></x>"
    assert html_text.visible_text(page) == "One\n\nTwo bold & more\n\n- a\n- b\n  1. c\n\naa  b\nc   dddd\n\nx\n  y\n\ntail\nline"
    assert html_text.visible_text(None) == html_text.visible_text("<!-- x") == ""
    assert html_text.visible_text("<div>" * 3000 + "deep") == "deep"


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0


def test_pipeline_stages_take_awkward_rows(spark):
    """Nulls in every column, empty, blank and repeated texts, ties, an empty table and extra columns."""
    good = " ".join(f"word{i}" for i in range(60))
    given = [(None, None, None, None, None), (1, good, "en", "a", 1), (1, good, "en", "a", 1), (2, good, None, None, None), (3, "", "en", "a", 0), (4, " \n ", "en", "b", 3), (5, good + " more", "en", "b", 1), (None, good, "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(*r, "extra") for r in given], schema + ", epochs string")
    columns = [c.split(" ")[0] for c in schema.split(", ")]
    want = {
        "quality": Counter({None: 2, 1: 2, 2: 1, 5: 1}),  # without an id nothing is rejected
        "lines": Counter({None: 2, 1: 2, 3: 1, 4: 1}),  # one good line is left, and texts that were blank before
        "near_duplicates": Counter({None: 2, 1: 2, 3: 1, 4: 1}),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == columns
        got = Counter(r.doc_id for r in out.collect())
        assert got == want[name] if name in want else set(got) <= {None, 1, 2, 3, 4, 5}, (name, got)
        assert stage(spark, df.limit(0), SF).count() == 0
    pieces = corpus_pipeline.packed(spark, df, SF)
    assert pieces.count() == len(given) and corpus_pipeline.packed(spark, df.limit(0), SF).count() == 0


def test_run_filter_loses_no_close_pair():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 22, 400)
    last = np.cumsum(sizes)
    first = last - sizes
    flip = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    sim = rng.integers(0, 2**63, 60, dtype=np.uint64)[rng.integers(0, 60, last[-1])] ^ flip(last[-1]) ^ flip(last[-1])
    more = line_dedup.has_close(sim, first, last, 3)
    for a, b, m in zip(first, last, more, strict=True):
        found = bool(line_dedup.close_forest(sim[a:b], 3))
        assert not m if b - a <= 2 else m or not found
        assert found or not m or b - a > 16


def test_line_candidates_reach_edit_similarity(spark):
    """Recall against brute-force edit similarity, of lines with changed words; three bits of SimHash found 4 to 42 of a hundred."""
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").orderBy("doc_id").collect()
    lines = sorted({line_dedup.normalized(s).tobytes().decode("utf-32-le") for r in texts for s in (r.text or "").split("\n")})
    lines = [w for w in (s.split() for s in lines) if len(w) >= 5]
    pool = sorted({x for w in lines for x in w})
    rng = np.random.default_rng(11)
    points = lambda w: line_dedup.normalized(" ".join(w))

    def profile(texts):
        data = np.frombuffer("\n".join(map(" ".join, texts)).encode(), np.uint8)
        return line_dedup.line_profiles(data, np.array([0, len(data)]), 5)

    for size in (5, 10, 15, 20, 40, 100):
        longer = [w for w in lines if len(w) >= size]
        for changes, least in ((1, 0.8 if size < 10 else 0.9), (max(1, size * 15 // 100), 0.8)):
            pairs = []
            for _ in range(2000):
                a = longer[rng.integers(len(longer))][:size]
                b = list(a)
                for k in rng.choice(size, changes, replace=False):
                    b[k] = pool[rng.integers(len(pool))]
                if a != b and line_dedup.within(points(a), points(b), 0.8):
                    pairs.append((a, b))
                if len(pairs) == 200:
                    break
            left, right = profile([a for a, _ in pairs]), profile([b for _, b in pairs])
            met = (left[6] == right[6]).any(axis=1) & line_dedup.candidates(left[4], left[5], right[4], right[5], line_dedup.BITS_APART, 0.8)
            assert len(pairs) >= 50 and met.mean() >= least, (size, changes, met.mean())


def test_line_groups_against_brute_force(spark):
    """Of all pairs of lines that are similar enough, nine of ten at least are in one group; and one line of each group stays."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lines = [(i, n, line_dedup.normalized(s)) for i, t in sorted(texts.items()) for n, s in enumerate(t.split("\n"))]
    lines = [x for x in lines if (x[2] == 32).sum() >= 4]
    grams = np.array([np.bincount((x[2][:-1] * np.uint32(31) + x[2][1:]) & np.uint32(511), minlength=512) for x in lines]).astype(np.int16)
    size = np.array([len(x[2]) for x in lines])
    pairs = []
    for i in range(len(lines)):
        longer = np.maximum(size[i], size[i + 1 :])
        most = (0.2 * longer + 1e-9).astype(int)
        near = np.flatnonzero((np.abs(size[i] - size[i + 1 :]) <= most) & (np.minimum(grams[i], grams[i + 1 :]).sum(axis=1, dtype=np.int64) >= longer - 1 - 2 * most)) + i + 1
        pairs += [(i, j) for j in near.tolist() if line_dedup.within(lines[i][2], lines[j][2], 0.8)]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[max(find(i), find(j))] = min(find(i), find(j))
    keep = {lines[find(i)][:2] for i in range(len(lines))}
    gone = {(r.doc_id, n) for r in line_dedup.line_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect() for n in r.removed}
    want = {x[:2] for x in lines} - keep
    assert gone <= want and len(gone) >= 0.95 * len(want), (len(gone), len(want))
    unequal = {x for i, j in pairs if (lines[i][2].tolist() != lines[j][2].tolist()) for x in (i, j)}
    met = [(i, j) for i, j in pairs if i in unequal and lines[j][:2] in gone]
    assert len(met) >= 0.9 * sum(1 for i, j in pairs if i in unequal)


def test_lines_in_blocks(spark, monkeypatch):
    """Groups of one text's variants over many blocks: the same lines go as in one block."""
    rng = np.random.default_rng(2)
    base = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}w" for i in range(60)]
    swap = lambda n: " ".join(f"{chr(97 + rng.integers(26))}{chr(97 + rng.integers(26))}new" if k in set(rng.choice(60, n, replace=False).tolist()) else w for k, w in enumerate(base))
    df = spark.createDataFrame([(i, "\n".join(swap(1 if i % 2 else 3) for _ in range(3))) for i in range(40)], "doc_id long, text string")
    removed = lambda **o: {(r.doc_id, n) for r in line_dedup.line_duplicates(df, **o).collect() for n in r.removed}
    want = removed()
    assert len(want) > 100
    for anchors in (0, 4):
        monkeypatch.setattr(line_dedup, "ANCHORS", anchors)
        assert removed(block_lines=10) == want
    monkeypatch.setattr(line_dedup, "LONGEST_RUN", 3)
    assert removed() == want


def test_lines_with_a_changed_word_are_removed(spark):
    words = [[f"{chr(97 + i)}{chr(97 + j)}word{chr(97 + (i * j) % 26)}" for j in range(20)] for i in range(20)]
    changed = [[*w[:9], "other", *w[10:]] for w in words]
    df = spark.createDataFrame([(1, "\n".join(map(" ".join, words))), (2, "\n".join(map(" ".join, changed)))], "doc_id long, text string")
    got = rows(line_dedup.dedup_lines(df))
    assert got[1].n_removed == 0 and got[2].n_removed >= 19


def test_pieces_rule_out_unlike_long_lines_and_no_similar_ones(monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(2, 9))))
    known = [word() for _ in range(400)]
    lines = [" ".join(known[k] for k in rng.integers(0, 400, 160)) for _ in range(8)]
    changed = []
    for t in lines:  # single letters all over the line, a stretch more, a stretch less: a fifth of the places at most
        a, k = list(t), len(t) // 5
        for at in rng.integers(0, len(a), k - 2):
            a[at] = "x"
        changed += ["".join(a), t[:300] + "y" * (k - 2) + t[300:], t[:200] + t[200 + k - 2 :]]
    every = lines + changed
    i, j = np.triu_indices(len(every), 1)
    points = [line_dedup.normalized(t) for t in every]
    size = np.array([len(x) for x in points])
    near = line_dedup.alike(size[i], size[j], 0.8)
    i, j = i[near], j[near]
    want = np.array([line_dedup.within(points[a], points[b], 0.8) for a, b in zip(i, j, strict=True)])
    assert want.sum() >= 24
    text = line_dedup.Lines(every, size, 0.8)
    most = (0.2 * np.maximum(size[i], size[j]) + 1e-9).astype(np.int64)
    assert not (text.apart(i, j, most) & want).any()
    assert (text.close(i, j) == want).all()
    whole = lambda *_: pytest.fail("compared in full")
    monkeypatch.setattr(line_dedup, "distances", whole)
    monkeypatch.setattr(line_dedup, "within", whole)
    a, b = np.triu_indices(len(lines), 1)
    assert not text.close(a, b).any()


def test_distances_of_many_pairs(monkeypatch):
    monkeypatch.setattr(line_dedup, "CHECKED", 8)
    rng = np.random.default_rng(3)
    texts = []
    for k in range(120):
        a = rng.integers(97, 105, rng.integers(1, 20 if k % 3 else 420)).astype(np.uint32)
        b = list(a)
        for _ in range(rng.integers(0, 1 + len(a) // 3)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 3))] = rng.integers(97, 105, rng.integers(0, 3)).tolist()
        texts += [a, np.array(b, np.uint32)]

    def plain(a, b):
        row = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            below = np.minimum(row[1:] + 1, row[:-1] + (b != x))
            new = np.append(i, below)
            row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        return row[-1]

    pairs = [(2 * k, 2 * k + 1) for k in range(120) if len(texts[2 * k + 1])]
    want = np.array([plain(texts[i], texts[j]) for i, j in pairs])
    for most in (np.full(len(pairs), 500), np.maximum(1, [max(len(texts[i]), len(texts[j])) // 5 for i, j in pairs])):
        got = line_dedup.distances(texts, pairs, most)
        assert ((got == want) | (want > most) & (got > most)).all()
        assert all(line_dedup._distance_at_most(texts[i].tolist(), texts[j].tolist(), int(k)) == (w <= k) for (i, j), k, w in zip(pairs, most, want, strict=True))


def test_html_text_outside_body_and_cells():
    assert html_text.visible_text("<head><title>T</title><p>whole <b>page</b>") == "whole page"
    assert html_text.visible_text("<head><meta a=b>\n<script>x</script>plain text") == "plain text"
    assert html_text.visible_text("<head>\n<title>T</title>\n</head><body>y") == "y"
    assert html_text.visible_text("<table><tr>loose<td>a<td>b</tr><tbody>stray<tr><td>c</tbody></table>") == "loose\na  b\nstray\nc"


def test_html_forms_spans_and_style_rules(spark, empty):
    text = html_text.visible_text
    assert text("<select><option>one<option>two</select> <svg><title>t</title><text>drawn</text></svg> <math><mi>x</mi><mo>=</mo><mn>1</mn></math>") == "one\ntwo\ndrawn x=1"
    assert text("<table><tr><td>a<td>b<td>c<tr><td colspan=2>wide<td>d<tr><td colspan='x'>e</table>") == "a  b  c\nwide  d\ne"
    assert text("<style>.no, #gone { display:none } /* p{display:none} */ nav{visibility: hidden}</style><p class='a no'>x<p id=gone>y<nav>z</nav><p class=nope>seen") == "seen"
    page = "<table>" + "<tr><td>a<td>b" * 2000 + "<tr><td>" + "w" * 30000 + "<td>c</table>"
    assert len(text(page)) < 3 * len(page)
    rows = [(1, "<p>x"), (1, "<p>x"), (None, None), (2, "<p>" + "long " * 50000)]
    df = spark.createDataFrame([(i, h, "clash") for i, h in rows], "page_id int, html string, text string")
    assert Counter((r.page_id, len(r.text)) for r in html_text.extract_text(df).collect()) == Counter([(1, 1), (1, 1), (None, 0), (2, 249999)])
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_packing_ends_with_pieces_over_half(spark, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND_ITEMS", 2)
    df = spark.createDataFrame([(i, "word " * 600) for i in range(40)], "doc_id long, text string")
    found = packing.pack(df, island_items=4).toPandas()
    assert sorted(found.doc_id) == list(range(40)) and found.sequence_id.nunique() == 40


def test_near_duplicate_stage_against_brute_force(spark):
    base = [f"w{i}x" for i in range(60)]
    given = {1: base, 2: [*base[:30], "other", *base[31:]], 3: [*base[:20], "a", *base[21:40], "b", *base[41:]], 4: [f"v{i}" for i in range(40)], 5: [f"v{i}" for i in range(40)], 6: ["short", "one"]}
    sets = {i: set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) > 4 else {tuple(w)} for i, w in given.items()}
    close = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    assert [(i, j) for i in sets for j in sets if i < j and close(i, j)] == [(1, 2), (4, 5)]
    df = spark.createDataFrame([(i, " ".join(w), "en", "a", 1) for i, w in given.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()) == [1, 3, 4, 6]
