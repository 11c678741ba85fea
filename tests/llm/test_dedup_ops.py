"""Near duplicates, vectors, repeats, components and the pipeline against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import core, neardup, suffixes, vectors

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Roots(dict):
    def __missing__(self, x):
        self[x] = x
        return x

    def of(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.of(a), self.of(b)))
        self[b] = a


def corpus(seed=5):
    """Copies, near copies around the threshold, shared passages, short and empty texts, repeated rows."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    words = lambda n: r.choices(vocabulary, k=n)
    out = [None, "", "  ", "one two", "One TWO", "one two three four five", "a"]
    passage = words(70)
    for _ in range(6):
        base = words(r.randint(20, 120))
        out += [" ".join(base)] * 2
        for _ in range(12):
            near = list(base)
            for _ in range(r.randint(0, 6)):
                near[r.randrange(len(near))] = r.choice(vocabulary)
            out.append("  ".join(near).upper() if r.random() < 0.1 else " ".join(near))
    for _ in range(25):
        out.append(" ".join(words(r.randint(0, 90)) + passage + words(r.randint(0, 90))))
    out += [" ".join(words(r.randint(1, 200))) for _ in range(30)] + ["la " * 130]
    r.shuffle(out)
    return list(enumerate(out)) + [(3, out[3])]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id bigint, text string, hash string, id int, `end` int")


def true_groups(rows):
    sets, roots = {}, Roots()
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                roots.join(a, b)
    return {i: (len(sets[i]), roots.of(i)) for i in ids}


@pytest.mark.parametrize("least", [2, 5, 64])
def test_ngram_jaccard(spark, monkeypatch, least):
    """A low bound puts most tokens into the frequent class, so that combinations do the work."""
    monkeypatch.setattr(neardup, "LEAST_FREQUENT", least)
    rows = corpus(least)
    got = neardup.near_duplicates(docs(spark, rows)).collect()
    want = true_groups(rows)
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, *x) for i, x in want.items()}


def test_ngram_jaccard_chunks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_CHUNK", 4)
    monkeypatch.setattr(neardup, "TURNS", 1)
    rows = corpus(9)
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, rows)).collect()} == {(i, x[1]) for i, x in true_groups(rows).items()}


def test_ngram_jaccard_edges(spark):
    table = docs(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (None, None), (8, None), (7, "a b c d e f")])
    got = sorted(((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(table).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (8, 8)], key=str)
    kept = neardup.drop_near_duplicates(table)
    assert kept.columns == table.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([7, 8, None], key=str)
    assert neardup.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [neardup.drop_near_duplicates, suffixes.cut_repeats])
def test_texts_without_duplicates_are_not_shuffled(spark, stage):
    """Where the list of what goes is too long for a broadcast, only texts that may be in it meet it by shuffle."""
    r = random.Random(3)
    rows = [(i, " ".join(f"{r.getrandbits(60):x}" for _ in range(r.randint(60, 900)))) for i in range(600)]
    rows += [(600 + i, rows[i][1]) for i in range(0, 40, 2)]
    sent = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    size = sum(len(t) for _, t in rows) // 2  # digits in hexadecimal compress to a half
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stage(core.durable(docs(spark, rows)))
        began = sent()
        kept = {x["doc_id"]: x["text"] for x in out.collect()}
        assert sent() - began < size // 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept == dict(rows[:600])


def test_index_entries_meet():
    """Any two sets at the threshold share an entry, whatever tokens are frequent."""
    r = np.random.default_rng(0)
    for _ in range(300):
        n = int(r.integers(3, 80))
        s = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64) << np.uint64(1))
        t = np.unique(np.concatenate([r.choice(s, max(1, int(len(s) * r.uniform(0.75, 1))), replace=False), r.integers(0, 1 << 62, int(r.integers(0, 9))).astype(np.uint64)]))
        both = len(np.intersect1d(s, t))
        if 100 * both < 75 * (len(s) + len(t) - both) or len(s) == len(t) == both:
            continue
        high = np.unique((np.concatenate([s, t]) >> np.uint64(32)).astype(np.uint32))
        frequent = high[r.random(len(high)) < r.choice([0, 0.3, 0.8, 1])]
        a, b = (neardup.entries(x, frequent) for x in (s, t))
        assert len(np.intersect1d(a[0], b[0])) or len(np.intersect1d(a[1], b[1]))


def repeated(rows, width=50):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        w, covered = WORD.findall(t or ""), set()
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if g in seen and seen[g] != (i, k):
                covered |= set(range(k, k + width))
            seen.setdefault(g, (i, k))
        out[i] = covered
    return {i: c for i, c in out.items() if c}


def test_suffix_dedup(spark):
    rows = corpus(11)
    got = collections.defaultdict(set)
    for r in suffixes.repeats(docs(spark, rows)).collect():
        assert r["n_words"] == r["end"] - r["start"] >= 50 and r["first_id"] is not None
        got[r["doc_id"]] |= set(range(r["start"], r["end"]))
    assert got == repeated(rows)


@pytest.mark.parametrize("hot,parts", [(0, 3), (2, 5), (4096, 7), (10**9, 1)])
def test_suffix_runs_of_many_partners(spark, monkeypatch, hot, parts):
    """Partners that aren't next to each other in the order of what follows: passages with words changed at every distance to the left and right, in texts of few words."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    r = random.Random(hot)
    base = [r.choice("abcdefg") + str(r.randint(0, 30)) for _ in range(140)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = f"x{r.randint(0, 5)}"
        rows.append((i, " ".join(t[r.randint(0, 30) : r.randint(90, 140)])))
    rows += [(100, " ".join(["a"] * 300)), (101, " ".join(["a"] * 120 + ["b"] * 60)), (102, " ".join(["a b"] * 100)), (103, " ".join(base + base)), (107, None), (104, "")]
    got = collections.defaultdict(set)
    for x in suffixes.repeats(docs(spark, rows).repartition(parts)).collect():
        got[x["doc_id"]] |= set(range(x["start"], x["end"]))
    assert got == repeated(rows)


def test_suffix_dedup_of_very_many_copies(spark):
    """Nine in ten rows are one text, others are empty."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i, text if i % 10 else ("" if i % 20 else f"{text} tail{i}")) for i in range(2000)]
    got = {(x.doc_id, x.start, x.end) for x in suffixes.repeats(docs(spark, rows).repartition(6)).collect()}
    assert got == {(i, 0, 80) for i in range(1, 2000) if i % 10 or not i % 20}


def test_suffix_cuts(spark):
    rows = corpus(11)
    table, cover = docs(spark, rows), repeated(rows)
    out = suffixes.cut_repeats(table)
    assert out.columns == table.columns
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, t in rows:
        left = [w for k, w in enumerate(WORD.findall(t or "")) if k not in cover.get(i, ())]
        if i not in cover:
            assert kept[i] == t
        elif left:
            assert WORD.findall(kept[i]) == left
        else:
            assert i not in kept
    assert suffixes.repeats(table.limit(0)).count() == 0 and suffixes.cut_repeats(table.limit(0)).count() == 0


def test_shared_and_null_ids_lose_no_clean_text(spark):
    words = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    shared = words("s", 60)
    rows = [(1, shared), (None, words("a", 30) + " " + shared), (None, words("b", 120)), (None, None), (2, words("c", 120)), (2, words("d", 30) + " " + shared)]
    kept = sorted(((r["doc_id"], r["text"]) for r in suffixes.cut_repeats(docs(spark, rows)).collect()), key=str)
    assert kept == sorted([(1, shared), (None, words("a", 30)), (None, words("b", 120)), (None, None), (2, words("c", 120)), (2, words("d", 30))], key=str)

    p, q, r = words("p", 40), words("q", 40), words("r", 40)
    rows = [(5, p), (6, p + " x"), (5, q), (7, q + " x"), (None, r), (None, r + " x"), (None, "t"), (None, None), (None, None), (9, None)]
    kept = [(x["doc_id"], x["text"]) for x in neardup.drop_near_duplicates(docs(spark, rows)).collect()]
    one = [x for x in kept if x[0] is None and x[1] in (r, r + " x")]
    assert len(one) == 1
    assert sorted(set(kept) - set(one), key=str) == sorted([(5, p), (5, q), (None, "t"), (None, None), (9, None)], key=str) and kept.count((None, None)) == 2


def cloud(seed=2):
    r, rows = np.random.default_rng(seed), []
    for label in (0, 1):
        for _ in range(12):
            c = r.standard_normal(16)
            for _ in range(int(r.integers(1, 14))):
                rows.append((label, (c + r.standard_normal(16) * np.linalg.norm(c) * r.uniform(0, 0.06)).tolist()))
    hot = r.standard_normal(16)
    rows += [(1, hot.tolist())] * 5 + [(1, (3 * hot).tolist())] + [(0, hot.tolist())]
    rows += [(None, hot.tolist()), (1, None), (1, []), (1, [0.0] * 16), (1, [float("nan")] * 16), (1, [None] + [1.0] * 15), (1, [float("inf")] + [1.0] * 15), (1, hot.tolist()[:8])]
    return [(i, x, v) for i, (x, v) in enumerate(rows)]


def true_links(rows):
    """Links and components of (id, label, vector) by all pairs."""
    good = {i: (x, np.array(v)) for i, x, v in rows if x is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links, roots = collections.Counter(), Roots()
    for of in {(x, len(v)) for x, v in good.values()}:
        ids = sorted(i for i, (x, v) in good.items() if (x, len(v)) == of)
        m = np.stack([good[i][1] / np.linalg.norm(good[i][1]) for i in ids])
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.98, 1)), strict=True):
            links[ids[a]] += 1
            links[ids[b]] += 1
            roots.join(ids[a], ids[b])
    return links, roots


@pytest.mark.parametrize("chunk,cell", [(2048, 256), (8, 2)])
def test_vectors(spark, monkeypatch, chunk, cell):
    monkeypatch.setattr(vectors, "_CHUNK", chunk)
    monkeypatch.setattr(vectors, "_CELL", cell)
    rows = cloud()
    table = spark.createDataFrame([(i, v, x, 1) for i, x, v in rows], "vec_id bigint, embedding array<double>, label int, node int")
    got = {r["vec_id"]: r for r in vectors.near_vectors(table).collect()}
    links, roots = true_links(rows)
    assert sum(links.values()) > 100
    assert {i: r["n_links"] for i, r in got.items()} == {i: links[i] for i, _, _ in rows}
    assert all(r["component_id"] == roots.of(i) and r["kept"] == (roots.of(i) == i) for i, r in got.items())
    assert vectors.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("most", [10_000, 1_000_000])
def test_vector_recall(most):
    """Pairs exactly at the threshold share a cell and pass the count, and unrelated ones seldom meet, at the depth of a large label."""
    p = vectors.Lines()
    depth = p.depth(most)
    r = np.random.default_rng(8)
    a = r.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = r.standard_normal(a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
    met = (p.codes(a, depth) == p.codes(b, depth)).any(axis=1)
    near = (np.abs(p.sketch(a).astype(int) - p.sketch(b)) <= p.steps).sum(axis=1) >= p.least
    assert (met & near).mean() > 0.995
    met = (p.codes(a[:2000], depth) == p.codes(a[2000:], depth)).sum() / 2000 / p.tables(depth)
    assert met * most < 4 * vectors._CELL


def test_collisions_in_chunks():
    r = np.random.default_rng(5)
    p = vectors.Lines()
    x = r.standard_normal((60, 64))
    x = np.concatenate([x, x + 0.1 * r.standard_normal(x.shape) * np.linalg.norm(x, axis=1, keepdims=True) / 8])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s, own = p.sketch(x), r.integers(0, 2, len(x))
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if (np.abs(s[i].astype(int) - s[j]) <= p.steps).sum() >= p.least}
    pairs = lambda own, whole: [tuple(sorted(q)) for a, b in vectors._collisions(s, own, whole, p) for q in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(want) >= 60 and sorted(pairs(own * 0, True)) == sorted(want)
    assert sorted(pairs(own, False)) == sorted(q for q in want if own[q[0]] != own[q[1]])


def test_vector_query(spark):
    """Every vector of the small table against brute force, and a table with planted pairs on both sides of the threshold."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    r = np.random.default_rng(3)
    more = []
    for i, label, v in rows[:150]:
        v = np.array(v) / np.linalg.norm(v)
        for k in range(3):
            side = r.standard_normal(len(v))
            side -= side @ v * v
            c = r.uniform(0.975, 0.99)
            more.append((10_000 + 3 * i + k, label, [float(x) for x in c * v + np.sqrt(1 - c * c) * side / np.linalg.norm(side)]))
    for table in (rows, rows + more):
        links, roots = true_links(table)
        got = vectors.near_vectors(spark.createDataFrame(table, "vec_id bigint, label int, embedding array<double>")).collect()
        assert len(got) == len(table)
        assert all(g["n_links"] == links[g["vec_id"]] and g["component_id"] == roots.of(g["vec_id"]) for g in got)
    assert sum(links.values()) > 200


@pytest.mark.parametrize("in_task", [0, 1 << 20])
def test_components(spark, in_task):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    roots = Roots()
    for a, b in edges:
        if a != b:
            roots.join(a, b)
    got = core.components(spark.createDataFrame([*edges, (None, 1), (5, 5)], "a bigint, b bigint"), in_task=in_task).collect()
    assert len(got) == len({x["node"] for x in got})
    assert {(x["node"], x["comp"]) for x in got if x["node"] != x["comp"]} == {(n, roots.of(n)) for e in edges for n in e if roots.of(n) != n}


def test_lookup_with_hot_keys(spark):
    big = spark.range(5000).select("id", F.when(F.col("id") < 4000, "hot").when(F.col("id") < 4500, F.concat(F.lit("k"), F.col("id") % 700)).otherwise(None).alias("k"))
    small = spark.createDataFrame([("hot", 1, 4000), ("k5", 2, 1), ("k100", 3, 1)], "k string, v int, n bigint")
    got = {r["id"]: r["v"] for r in core.lookup(big, small, "k", "n", 5000).collect()}
    assert len(got) == 5000 and all(got[i] == 1 for i in range(4000)) and all(got[i] == {5: 2, 100: 3}.get(i % 700) for i in range(4000, 4500)) and got[4700] is None


def test_pipeline(spark):
    import corpus_pipeline

    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs_]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(core.durable(stage(spark, tables[-1], SF)))
    assert all(t.columns == docs_.columns for t in tables[:-1])
    text = [[(r["doc_id"], r["text"]) for r in t.collect()] for t in tables[:-1]]
    assert {i for i, _ in text[1]} <= {i for i, t in text[0] if len(WORD.findall(t or "")) >= 50}
    assert {i for i, _ in text[2]} == {i for i, x in true_groups(text[1]).items() if x[1] == i}
    cover = repeated(text[2])
    assert {i: WORD.findall(t) for i, t in text[3]} == {i: left for i, t in text[2] if (left := [w for k, w in enumerate(WORD.findall(t)) if k not in cover.get(i, ())])}
    assert max(collections.Counter(i for i, _ in text[4]).values()) <= 2 and {i for i, _ in text[4]} <= {i for i, _ in text[3]}
    assert tables[-1].count() == len(text[4])


def test_suffix_ids_and_long_texts(spark):
    words = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    with pytest.raises(ValueError):
        suffixes.repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
    # a passage that many documents share, each with words of its own around it; a very long text that repeats itself, and one of white space
    shared = words("s", 70)
    rows = [(i, f"{words(f'l{i}x', 60)} {shared} {words(f'r{i}x', 60)}") for i in range(300)] + [(1000, words("v", 30_000) + " " + words("v", 500)), (1001, " " * 200_000), (1002, words("z", 49))]
    got = {(r["doc_id"], r["start"], r["end"]) for r in suffixes.repeats(docs(spark, rows)).collect()}
    assert got == {(i, 60, 130) for i in range(1, 300)} | {(1000, 30_000, 30_500)}
