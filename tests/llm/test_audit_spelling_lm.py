"""Spelling variants, filter audit and language-model scores against brute force; the lossless filter of line pairs."""

import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tenure.llm import bloom_lm, filter_audit, html_text, line_dedup, spelling, toxicity
from tenure.llm.common import materialize
from tenure.llm.queries import ORACLES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, word string, mask int"


@pytest.fixture(scope="module")
def docs(spark):
    """Given rows and awkward ones: nulls, empty, blank, very long and repeated texts, repeated ids, columns with clashing names."""
    given = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = "longword " * 30_000 + "x" * 5_000 + " " + "x" * 5_001
    odd = [(None, None, None, None, None), (None, "", "en", "a", 0), (9001, None, None, None, None), (9002, "", "en", "", 0), (9003, " \n\t ", "en", None, 4), (9004, long, "en", "a", 1), (9005, long, "en", "b", 1), (9005, long, "en", "b", 1), (9006, "REPEATS", "en", "a", 1), (9006, "repeatz", "en", "a", 1)]
    return spark.createDataFrame([(*r, 1, "clash", 3) for r in given + odd], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- spelling variants


def one_edit(words):
    """Unordered pairs of distinct words one edit apart."""
    out, known, by = set(), set(words), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            by[i, short].append(w)
            if short in known:
                out.add((min(short, w), max(short, w)))
    for same in by.values():
        out |= {(min(p), max(p)) for p in itertools.combinations(same, 2)}
    return out


def test_composition_accepts_each_pair_once(monkeypatch):
    rng = np.random.default_rng(5)
    for t in range(40):
        letters = list("abc" if t % 2 else "aé")
        words = sorted({"".join(rng.choice(letters, rng.integers(3, 10))) for _ in range(300)})
        monkeypatch.setattr(spelling, "SHORT", 5 if t % 3 == 0 else 64)
        monkeypatch.setattr(spelling, "PATHS", 50 if t % 4 == 0 else 1 << 20)
        got = [(words[min(a, b)], words[max(a, b)]) for i, j in spelling.one_edit_pairs(np.array(words, object), 3) for a, b in zip(i, j, strict=True)]
        assert len(got) == len(set(got)) and set(got) == {p for p in one_edit(words) if p[0][:3] == p[1][:3]}


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("aaa", "aab", "aba") for b in ("ing", "ings", "ed"))
    codes = np.array(words).view(np.uint32).reshape(len(words), -1)
    a = spelling.Acceptor(codes, np.array([len(w) for w in words]), 3)
    assert len(set(a.initial.tolist())) == 1 and a.size[a.initial[0]] == 3
    assert len(a.final) == 6  # the start of the endings, after i, in, ing, e; all ends are one state


def spelt(docs):
    n = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def test_spelling_groups(spark, docs, empty, monkeypatch):
    common = " ".join(["mississippi"] * 1200 + ["missisippi"] * 110 + ["misisippi"] * 9 + ["mississippis", "mississippis", "Übermäßig", "Übermäßig"])
    docs = docs.unionByName(spark.createDataFrame([(i, common, None, None, None, 1, "", 0) for i in (8001, 8002)], SCHEMA))
    n, near = spelt(docs), defaultdict(set)
    for a, b in one_edit(n):
        near[a].add(b)
        near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    got = {r.word: r for r in spelling.spelling_groups(docs).collect()}
    assert {w: (r.n, r.n_near, r.form, r.form_n, r.root) for w, r in got.items()} == {w: (n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}
    assert got["misisippi"].root == "mississippi" and len(n) > 300
    vocabulary = materialize(spelling.run_words(docs), "vocabulary")
    pairs = lambda **o: sorted((r.word, r.near) for r in spelling.near_words(vocabulary, **o).collect() if r.near)
    assert pairs(block=7) == pairs() == sorted((a, b) for a in near for b in near[a])
    assert spelling.spelling_groups(empty).count() == 0


# ---------------------------------------------------------------- filter audit


def test_audit_equals_sql(spark, docs, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(None, 1, 1), (9005, 0, 1), (9005, 1, 0), (9006, None, 1)], labels.schema)
    labels = labels.unionByName(odd)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", labels.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    want = sorted(con.execute(ORACLES["op12_filter_audit"]).fetchall())
    got = filter_audit.audit_filters(docs, labels)
    assert sorted(map(tuple, got.collect())) == want and len(want) % 600 == 0
    assert filter_audit.audit_filters(empty, labels).count() == 0
    assert sorted(map(tuple, filter_audit.audit_filters(docs, labels.limit(0)).drop("good_lost", "toxic_lost").collect())) == sorted((*r[:7], r[9]) for r in want)


def test_bloom_clears_only_unique_texts(spark, docs):
    """Slices of small segments give each row once; no repeated text is cleared, and most others are."""
    texts = {f"{i}".zfill(64): 2 if i % 7 == 0 else 1 for i in range(2000)}
    rows = materialize(spark.createDataFrame([(i, bytes(np.random.default_rng(int(k)).bytes(32))) for i, k in enumerate(k for k, n in texts.items() for _ in range(n))], "doc_id long, digest binary"), "digests")
    n = Counter(bytes(r.digest) for r in rows.collect())
    slices = [s.collect() for s in filter_audit.possible_repeats(rows, slice_bytes=1 << 9, cells=1 << 10)]
    found = [r for s in slices for r in s]
    assert len(slices) > 3 and sorted(r.doc_id for r in found) == list(range(sum(n.values())))
    assert all(r.maybe for r in found if n[bytes(r.digest)] > 1)
    assert sum(r.maybe for r in found if n[bytes(r.digest)] == 1) < 0.1 * len(found)
    masks = lambda **o: Counter(map(tuple, filter_audit.failure_masks(docs, **o).collect()))
    assert masks() == masks(slice_bytes=1, cells=1 << 9)


# ---------------------------------------------------------------- language model


def test_scores_against_exact_counts(spark, docs, empty):
    rows = [(r.doc_id, [*re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)), None]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    n, pairs = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            n.update(t)
            pairs.update(zip([None, *t[:-1]], t, strict=True))
    total, mu = sum(n.values()) + 0.5 * (len(n) + 1), bloom_lm.MU
    p = lambda w: (n[w] + 0.5) / total
    mean = lambda k: (2 ** (k.bit_length() - 1) + 2 ** k.bit_length() - 1) / 2 if k else 0
    want = Counter()
    for i, t in rows:
        base = sum(math.log10(p(w)) for w in t)
        score = sum(math.log10((mean(pairs[v, w]) + mu * p(w)) / (n[v] + mu)) for v, w in zip([None, *t[:-1]], t, strict=True))
        want[i, held(i), len(t), sum(n[w] > 0 for w in t), round(base, 4), round(score, 1)] += 1
    got = bloom_lm.score_documents(docs).collect()
    assert {r.train_tokens for r in got} == {sum(n.values())}
    assert Counter(tuple(r)[:4] + (round(r.base_score, 4),) for r in got) == Counter({k[:5]: 0 for k in want}) + sum((Counter({k[:5]: c}) for k, c in want.items()), Counter())
    # absent pairs that pass all probes, 1 in 2^PROBES, only raise a score; the rest is exact
    exact = sum(k[5] * c for k, c in want.items())
    assert exact - 1 < sum(r.score for r in got) < exact + 0.002 * abs(exact)
    of = {(k[0], k[2]): k[5] for k in want}
    above = [r.score - of[r.doc_id, r.n_tokens] for r in got]
    assert min(above) > -0.06 and sum(x < 0.06 for x in above) > 0.25 * len(above)
    assert bloom_lm.score_documents(empty).count() == 0


def test_rounds_and_shards_don_t_change_scores(spark, docs):
    """A broadcast of all shards and rounds of a few give the same scores, repeated rows and missing ids included."""
    model = bloom_lm.train(docs.where(~bloom_lm.held_out()), shard_bytes=30_000)
    assert model.shards > 5 and len(model.rounds(60_000)) > 2 and len(model.frequent[0]) > 3
    scores = lambda **o: sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in bloom_lm.score(docs, model, **o).collect())
    assert scores() == scores(round_bytes=60_000)


def test_tokens_are_stored_in_small_rows(spark, monkeypatch):
    """A long text's tokens are many rows of a round, none of them large, and the scores don't change."""
    df = spark.createDataFrame([(i, " ".join(f"w{j * j % (97 + i)} v{j % 89}" for j in range(40_000 if i == 3 else 50))) for i in range(12)], "doc_id long, text string").coalesce(1)
    model, largest, write = bloom_lm.train(df, shard_bytes=20_000), [], bloom_lm.materialize

    def watched(rows, name, **options):
        out = write(rows, name, **options)
        if name == "lm-tokens":
            largest.extend(out.selectExpr("max(octet_length(cur))", "max(octet_length(at))", "count(*)").first())
        return out

    monkeypatch.setattr(bloom_lm, "materialize", watched)
    scores = lambda **o: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in bloom_lm.score(df, model, **o).collect())
    assert scores(round_bytes=10_000) == scores() and largest[0] <= 1 << 16 and largest[1] <= 1 << 16 and largest[2] > 8


def test_filter_keeps_every_pair_and_few_others(spark):
    """Levels of counted pairs are exact; of pairs that don't occur, about 1 in 2^PROBES is found."""
    text = " ".join(f"w{i % 97} v{i * i % 89}" for i in range(4000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = bloom_lm.train(df)
    shards = bloom_lm.Shards(model, list(range(model.shards)))
    raw = np.frombuffer(text.encode(), np.uint8)
    cur, _ = bloom_lm.tokens(raw, np.array([0, len(raw)]))
    keys, counts = np.unique(bloom_lm.pairs(cur), return_counts=True)
    assert (shards.levels(keys, np.zeros(len(keys), np.int64)) >= np.frexp(counts.astype(float))[1]).all()
    absent = np.random.default_rng(1).integers(0, 2**63, 100_000).astype(np.uint64)
    assert (shards.levels(absent, np.zeros(len(absent), np.int64)) > 0).mean() < 4 * 2.0**-bloom_lm.PROBES


# ---------------------------------------------------------------- lines


def _edits(a, b):
    row = list(range(len(b) + 1))
    for x, p in enumerate(a, 1):
        before, row = row, [x]
        for y, q in enumerate(b, 1):
            row.append(min(before[y] + 1, row[-1] + 1, before[y - 1] + (p != q)))
    return row[-1]


def test_grams_rule_out_unlike_pairs_only():
    """No pair within its edits is ruled out, whichever text is the base: wrong letters, blocks gone or moved, and texts of a few code points; unlike texts are."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlucmfwypvbgé"), rng.integers(2, 9))) for _ in range(300)]
    text = lambda n: np.frombuffer(" ".join(rng.choice(vocabulary, n)).encode("utf-32-le"), np.uint32)
    bases = [text(n) for n in (1, 2, 12, 20, 25, 30)] + [np.array([7], np.uint32), np.array([7, 7, 7, 7], np.uint32)]
    probes, of = [], []
    for b, base in enumerate(bases):
        for k in range(12):
            x = base.tolist()
            for _ in range(rng.integers(0, max(1, len(x) // 6) + 1)):
                at = int(rng.integers(0, len(x)))
                x[at : at + int(rng.integers(0, 2))] = [int(rng.integers(97, 123))] * int(rng.integers(0, 2)) if len(x) > 1 else x[at : at + 1]
            cut = len(x) // 8
            x = x[cut:] if k % 4 == 1 else x[: len(x) - cut] if k % 4 == 2 else x[cut:] + x[:cut] if k % 4 == 3 else x
            probes.append(np.array(x or [7], np.uint32))
            of.append(b)
    of = np.array(of)
    most = np.array([_edits(p.tolist(), bases[b].tolist()) for p, b in zip(probes, of, strict=True)])
    for kinds in ((3,), (2,), (4,), (4, 3, 2)):
        assert not line_dedup.grams_apart(probes, bases, of, most, kinds).any()
        assert not line_dedup.grams_apart([bases[b] for b in of], probes, np.arange(len(probes)), most, kinds).any()
        assert not line_dedup.grams_apart(probes, bases, of, most + 3, kinds).any()
    unlike = [text(100) for _ in range(40)]
    assert line_dedup.grams_apart(unlike[1:], unlike[:1], np.zeros(39, np.int64), np.array([max(len(unlike[0]), len(x)) // 5 for x in unlike[1:]]), (4, 3, 2)).all()


def test_unlike_lines_of_a_run_are_ruled_out_by_grams(monkeypatch):
    """Of a run of unlike lines that the filters let pass, few are compared by pieces; similar ones among them are found."""
    rng = np.random.default_rng(9)
    vocabulary, n = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(3, 8))) for _ in range(150)], 60
    lines = [" ".join(rng.choice(vocabulary, 90)) for _ in range(n)]
    lines[41] = lines[7].replace("e", "i", 9)
    size, compared, pieces = np.array([len(x) for x in lines], np.int64), [], line_dedup.surely_apart
    monkeypatch.setattr(line_dedup, "surely_apart", lambda short, long, most: compared.append(len(short)) or pieces(short, long, most))
    keys = np.full((n, 8), 5)
    edges = line_dedup.verified_forest(lines, size, keys, np.zeros(n, np.uint64), np.zeros(n, np.int64), keys[:, 0], np.ones(n, bool), np.arange(n), 16, 0.8)
    assert edges == [(7, 41)] and sum(compared) < n * (n - 1) // 2 // 10


def test_line_filter_loses_no_similar_pair():
    """Every pair that edit similarity accepts passes the counts of code points and triples: changed words, wrong letters, few different words."""
    rng = np.random.default_rng(3)
    letters, lines, pairs = list("abcdefghijklmnopqrstuvwxyzéß"), [], []
    for t in range(600):
        pool = ["".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(rng.integers(2, 40))]
        a = list(" ".join(rng.choice(pool, rng.integers(5, 30))))
        b = list(a)
        for _ in range(rng.integers(0, max(1, len(a) // 4))):
            k = int(rng.integers(len(b)))
            b[k : k + int(rng.integers(0, 2))] = list(rng.choice(letters, rng.integers(0, 2)))
        pairs.append((len(lines), len(lines) + 1))
        lines += ["".join(a), "".join(b)]
    points = [line_dedup.normalized(x) for x in lines]
    text = line_dedup.Lines(lines, np.array([len(p) for p in points]), 0.8)
    i, j = np.array(pairs).T
    close = np.array([line_dedup.within(points[a], points[b], 0.8) for a, b in pairs])
    assert close.sum() > 200 and text.may_reach(i, j)[close].all()
    other = np.roll(j, 2)
    assert text.may_reach(i, other).mean() < 0.1


# ---------------------------------------------------------------- toxicity


def test_toxicity_forward_scores_by_plain_loops(spark):
    """A document's score is the noisy-or of its sentences' logistic scores, and every sentence over the bound is located."""
    rng = np.random.default_rng(8)
    texts = ["Bad words here. good day! Bad again", "", None, "one\n\ntwo bad. BAD bad?", "..!", "fine " * 300 + ". bad"]
    weights = rng.normal(0, 0.1, toxicity.CELLS + 1).astype(np.float32)
    data = [(t or "").encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])
    cell, first, of, number = toxicity.bags(raw, offsets)
    p = []
    for s in range(len(first)):
        last = first[s + 1] if s + 1 < len(first) else len(cell)
        p.append(1 / (1 + math.exp(-(sum(float(weights[c]) for c in cell[first[s] : last]) + float(weights[-1])))))
    assert np.allclose(toxicity.sentence_scores(weights, cell, first), p, atol=1e-5)
    whole = [1 - math.prod(1 - x for x, o in zip(p, of, strict=True) if o == d) for d in range(len(texts))]
    assert np.allclose(toxicity.noisy_or(np.array(p), of, len(texts)), whole, atol=1e-6)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    batches = df.selectExpr("doc_id", "false held_out", "text").toArrow().to_batches()

    class Sent:
        value = weights.tobytes()

    got = [r for b in toxicity._score(Sent, 0.3)(iter(batches)) for r in b.to_pylist()]
    for d, r in enumerate(got):
        mine = sorted((int(n), x) for n, x, o in zip(number, p, of, strict=True) if o == d and x >= 0.3)
        assert [x["sentence"] for x in r["offending"]] == [n for n, _ in mine] and np.allclose([x["score"] for x in r["offending"]], [x for _, x in mine], atol=1e-5)
        assert abs(r["score"] - whole[d]) < 1e-5 and r["n_sentences"] == sum(o == d for o in of)


# ---------------------------------------------------------------- HTML


def test_broken_markup_takes_linear_time():
    pages = ["<a " * 350_000, '<a "' * 250_000, '<a "' * 250_001 + ">", "<a \"' " * 200_000 + ">", "<style>" + "a" * 1_000_000, "<style " * 150_000, "<style>" + "a{" * 500_000, "</script " * 110_000, "<!x " * 250_000, "<" * 1_000_000, '<a ">" "' * 125_000]
    for page in pages:
        began = time.time()
        html_text.visible_text(page)
        assert time.time() - began < 8, page[:20]
    assert html_text.visible_text("a < b and <b class='x>y'>c</b> d > e") == "a < b and c d > e"
    assert html_text.visible_text("x <b title='open>rest</b> of <i>it</i>") == "x rest of it"


def test_rowspan_and_wrapped_cells():
    text = html_text.visible_text
    assert text("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>") == "A  b\n   c\nd  e"
    assert text("<table><tr><td>a<td rowspan=3 colspan=2>B<td>c<tr><td>d<td>e<tr><td>f<td>g</table>").split("\n")[1].split() == ["d", "e"]
    lines = text("<table><tr><td>" + "word " * 30 + "<td>x<tr><td>a<td>y</table>").split("\n")
    assert all(len(x) < 66 for x in lines) and lines[0].endswith("  x") and lines[-1].index("y") == lines[0].index("x") and " ".join(lines).count("word") == 30


class Plain:
    """Visible text of a page by the standard library's parser: words only, in order."""

    def __new__(cls, page):
        from html.parser import HTMLParser

        words, hidden = [], []

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                d = dict(attrs)
                off = tag in html_text.SKIPPED or "hidden" in d or bool(html_text.UNSEEN.search(d.get("style") or ""))
                if tag not in html_text.VOID and (off or hidden):
                    hidden.append(tag)

            def handle_endtag(self, tag):
                if tag in hidden:
                    while hidden.pop() != tag:
                        pass

            def handle_data(self, data):
                if not hidden:
                    words.extend(data.split())

        r = Reader()
        r.feed(page)
        r.close()
        return words


def test_given_pages_against_another_parser(spark):
    """All words that the standard library's parser finds visible, in order; list markers aside."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    same = 0
    for page in pages:
        mine = re.sub(r"(?m)^\s*(?:- |\d+\. )", "", html_text.visible_text(page)).split()
        same += "".join(sorted("".join(mine))) == "".join(sorted("".join(re.sub(r"^- ", "", w) for w in Plain(page or ""))))
    assert len(pages) > 20 and same >= 0.9 * len(pages), (same, len(pages))


# ---------------------------------------------------------------- near duplicates


def test_prepass_changes_no_component(spark):
    """Passages that many documents share, near copies of some of them, exact copies: the same components with and without the prepass, for a filter of any size."""
    from tenure.llm import ngram_join

    rng = np.random.default_rng(12)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, texts = words(200), []
    for i in range(60):
        own = words(150)
        t = own[:75] + passage[: 50 + i * 2] + own[75:]
        texts.append(t)
        if i % 3 == 0:
            near = list(t)
            near[int(rng.integers(len(near)))] = "changed"
            texts += [near, t]
    texts += [[], ["one"], ["one", "two"], passage, [*passage, "more"], ["x"] * 500]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, " ".join(passage)), (7000, None)], "doc_id long, text string")
    found = lambda **o: sorted(map(str, map(tuple, ngram_join.ngram_components(df, n=5, num=80, den=100, **o).collect())))
    want = found()
    assert found(prepass=True) == want
    sets = ngram_join.ngram_sets(*(lambda d: (np.frombuffer(b"".join(d), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in d])])))([" ".join(t).encode() for t in texts]), 5)
    bits = ngram_join.repeated_cells(df, 5, ngram_join.SEGMENT)
    alike = lambda a, b: len(np.intersect1d(a, b)) * 100 >= 80 * len(np.union1d(a, b)) > 0
    links = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and alike(a, b)}
    may = ngram_join.may_link(sets, bits, 80, 100)
    assert all(may[i] for i in links) and len(links) > 40 and may.sum() < len(sets) - 25
