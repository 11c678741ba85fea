"""Fingerprints, source divergence and fill-in-middle against plain loops and SQL."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import audit, fim, fingerprints

SF = "/root/testdata/sf0.001"
TRICKY = [(1, "", "a"), (2, None, None), (3, "x", "a"), (4, "ab", "b"), (5, "one\ntwo\n\nthree", "b"), (6, "\n\n\n", "a"), (7, "a <P> b", "a"), (7, "other", "a"), (8, "é́𝒳ß" * 50, "c"), (8, "é́𝒳ß" * 50, "c"), (None, "no id", "a"), (None, None, "a")]
COLUMNS = "doc_id bigint, text string, k string, fim string, `a.b` int"


def tricky(spark):
    return spark.createDataFrame([(i, t, k, "x", 1) for i, t, k in TRICKY], COLUMNS)


def check_sql(name, got, sql, docs):
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.execute(sql).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(want) == len(got), name
    got, want = (d[cols].sort_values(cols, ignore_index=True) for d in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


# ---------------------------------------------------------------------------------------------------------------------
# prefix hashes


@settings(max_examples=60, deadline=None)
@given(st.text("ab\U0001f600", max_size=60), st.data())
def test_spans_and_extensions(text, data):
    points, _ = fingerprints.codes([text])
    held = fingerprints.Prefixes(points)
    a, b = (data.draw(st.integers(0, len(text))) for _ in range(2))
    most = len(text) - max(a, b)
    want = next((i for i in range(most) if text[a + i] != text[b + i]), most)
    assert held.extension(np.array([a]), np.array([b]), np.array([most]))[0] == want
    n = data.draw(st.integers(0, most))
    assert held.equal(np.array([a]), np.array([b]), np.array([n]))[0] == (text[a : a + n] == text[b : b + n])


def test_hashes_are_polynomials_over_run_borders():
    points = np.arange(3 * fingerprints._RUN + 17, dtype=np.uint32) % 1009
    held = fingerprints.Prefixes(points)
    for m, (prime, base) in enumerate(fingerprints.MODULI):
        h, want = 0, [0]
        for c in points.tolist():
            h = (h * base + c + 1) % prime
            want.append(h)
        assert held.at[m].tolist() == want
        a, b = 5, 2 * fingerprints._RUN + 3
        assert int(held.span(np.array([a]), np.array([b]))[m][0]) == (want[b] - want[a] * pow(base, b - a, prime)) % prime


def spans(text):
    return {text[max(0, e - fingerprints.WINDOW) : e] for e in range(1, len(text) + 1)}


def dice(a, b):
    a, b = spans(a), spans(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def neighbours_of(rows):
    """Brute force: (id, text) and the next text, descending."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return list(zip(order, order[1:] + order[:1], strict=True))


def test_fingerprints_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in fingerprints.op11_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    prints, off = {}, []
    for (i, text), (_, after) in neighbours_of(rows):
        cut = len(text) - len(text) // 3
        edited = text[:cut] + after[: len(text) // 3]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [abs(r.near_edited - dice(text, edited)), abs(r.near_next - dice(text, after))]
        prints.setdefault(text, set()).add(r.fingerprint)
        prints.setdefault(edited, set()).add(r.edited_fingerprint)
        assert r.near_edited == pytest.approx(fingerprints.likeness(r.fingerprint, r.edited_fingerprint))
        same = next((k for k, (x, y) in enumerate(zip(text, edited, strict=False)) if x != y), min(len(text), len(edited)))
        assert r.common_prefix == same
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len(prints)
    assert max(off) < 0.25 and sum(off) / len(off) < 0.03
    # a text's fingerprint doesn't depend on where it is worked out
    for text, p in list(prints.items())[:20]:
        assert fingerprints.compared([text, ""])[0][2] == next(iter(p))


def test_fingerprints_of_odd_rows(spark):
    docs = tricky(spark)
    got = [tuple(r) for r in docs.transform(fingerprints.neighbours).select("doc_id", "n_chars", "edited_sha256").collect()]
    assert len(got) == len(TRICKY)
    assert Counter((i, n) for i, n, _ in got) == Counter((i, len(t or "")) for i, t, _ in TRICKY)
    # ids that are alone at their place have one next text
    texts = {i: t or "" for i, t, _ in TRICKY}
    for i, after in ((6, 5), (5, 4), (4, 3), (3, 2)):
        cut = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - cut] + texts[after][:cut]
        assert (i, len(texts[i]), hashlib.sha256(edited.encode()).hexdigest()) in got
    assert fingerprints.neighbours(docs.filter("doc_id = 3")).first().near_next == 1.0
    assert fingerprints.neighbours(docs.filter("false")).count() == 0
    # many partitions, of which some are empty, give the same rows as one
    one = sorted(map(str, fingerprints.neighbours(docs.filter("doc_id <> 7 and doc_id is not null").coalesce(1)).collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(str, fingerprints.neighbours(docs.filter("doc_id <> 7 and doc_id is not null").repartition(7)).collect())) == one
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fingerprint_of_a_very_long_text(spark):
    text = "".join(chr(97 + (i * i) % 26) for i in range(3_000_000))
    docs = spark.createDataFrame([(1, text), (2, text[:-1]), (3, text)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in fingerprints.neighbours(docs).collect()}
    assert got[3].next_prefix == len(text) - 1 and got[1].fingerprint == got[3].fingerprint != got[2].fingerprint


# ---------------------------------------------------------------------------------------------------------------------
# source divergence


def brute_divergence(rows, min_docs, top=50, prior=5, scale=10**9):
    docs = [(x or "", s or "", Counter(re.findall(audit.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for x, s, t in rows]
    df, out = defaultdict(Counter), []
    for x, _, c in docs:
        df[x].update(c.keys())
    for x in df:
        kept = sorted(t for t, n in df[x].items() if n >= min_docs)
        groups, whole = defaultdict(Counter), Counter()
        for y, s, c in docs:
            if y == x:
                groups[s].update({t: c[t] for t in kept})
                whole.update({t: c[t] for t in kept})

        def share(c, t):
            return 1 + scale * (c[t] + prior) // (sum(c[k] for k in kept) + prior * len(kept))  # noqa: B023

        for s in groups:
            pairs = [(-sum(abs(share(groups[s], t) - share(groups[o], t)) for t in kept), o) for o in groups if o != s]
            terms = [(share(whole, t) - share(groups[s], t), t) for t in kept if groups[s][t] and share(groups[s], t) > share(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(x, s, part, item, -v, k) for k, (v, item) in enumerate(sorted(found, key=lambda p: (p[0], p[1].encode()))[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs,top", [(2, 50), (3, 2), (1000, 50)])
def test_divergence_against_brute_force(spark, min_docs, top):
    words = ["alpha", "Beta", "BETA", "gamma", "é", "É", "x", "delta", "𝒳y", "a1b"]
    rows = [(["en", "de", None, ""][i % 4], [None, "s1", "s2", "s3", "é", ""][i * 7 % 6], " ".join(words[(i * j + i) % len(words)] for j in range(i % 9))) for i in range(120)]
    rows += [("fr", "only", "1 2 3"), ("xx", "a", None), ("xx", "b", "")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, source string, text string, term string, n int")
    got = sorted(tuple(r) for r in audit.divergence(docs, min_docs=min_docs, top=top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_divergence(rows, min_docs, top)


def test_divergence_of_whole_tables_and_of_none(spark):
    check_sql("op12", audit.op12_source_divergence(spark, SF).toPandas(), audit.OP12_SQL, duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").df())
    assert audit.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    big = 10**15
    df = spark.range(1).select(audit.share(*[F.lit(v).cast("bigint") for v in (big, 3 * big + 7, 11)], 5, 10**9).alias("p"))
    assert df.first().p == 1 + 10**9 * (big + 5) // (3 * big + 7 + 55)


# ---------------------------------------------------------------------------------------------------------------------
# fill-in-middle


def brute_fim(i, text, plan=fim.Plan()):
    text, units = text or "", re.findall(plan.units, text or "")
    h = hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in (plan.prefix, plan.suffix, plan.middle)) or h[2] % 100 >= plan.rate:
        return len(units), "plain", None, None, None, text
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < plan.spm:
        return len(units), "spm", p, m, s, plan.suffix + s + plan.prefix + p + plan.middle + m
    return len(units), "psm", p, m, s, plan.prefix + p + plan.suffix + s + plan.middle + m


@pytest.mark.parametrize("plan", [fim.Plan(), fim.Plan(seed=3, rate=60, spm=20), fim.Plan(units=r"\s*\S+|\s+")])
def test_fill_in_middle_against_brute_force(spark, plan):
    docs = tricky(spark).withColumnRenamed("fim", "prefix")
    done = fim.transformed(docs, plan=plan)
    rows = done.withColumn("back", fim.restored(done["fim.output"], done["fim.form"], plan)).collect()
    assert Counter((r.doc_id, r.text, tuple(r.fim)) for r in rows) == Counter((i, t, brute_fim(i, t, plan)) for i, t, _ in TRICKY)
    assert all(r.back == (r.text or "") and r["a.b"] == 1 and r.prefix == "x" for r in rows)


def test_fill_in_middle_of_the_whole_table_and_of_none(spark):
    check_sql("op13", fim.op13_fill_in_middle(spark, SF).toPandas(), fim.OP13_SQL, duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").df())
    assert fim.transformed(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_fill_in_middle_of_a_million_lines(spark):
    text = "".join(f"{i}\n" for i in range(1_000_000))
    r = fim.transformed(spark.createDataFrame([(5, text)], "doc_id bigint, text string")).first().fim
    assert (r.n, r.form, r.prefix, r.middle, r.suffix, r.output) == brute_fim(5, text)


def test_markers_at_borders_read_back(spark):
    rows = [(i, t) for i, t in enumerate(["<\n<P\n<S\n", "<\nP>\nS>\n<M\n", "M>\n<<\n<", "<P\n>"] * 8)]
    done = fim.transformed(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert all(r.back == r.text for r in done.withColumn("back", fim.restored(done["fim.output"], done["fim.form"])).collect())


def test_markers_that_cannot_be_told_apart_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("<<P>", "<S>", "<M>"), ("P", "S", "M"), ("<P>", "[S]", "<M>")):
        with pytest.raises(ValueError):
            fim.Plan(prefix=marks[0], suffix=marks[1], middle=marks[2])
