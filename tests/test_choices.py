"""Exact choices, numbers of rows, permutations, merging by turns, noise, results, and the choice of spans, against plain loops."""

import hashlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.operators import choice, generate, grouped, merging, spans


def ticket(seed, *keys):
    return int(hashlib.md5(":".join([str(seed), *["" if k is None else str(k) for k in keys]]).encode()).hexdigest()[:15], 16)


def test_tickets_and_numbers(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"é{i % 7}") for i in range(200)], "id bigint, k string").repartition(6)
    got = rows.select("id", "k", choice.ticket(3, "id", "k").alias("t"), choice.die(7, "x", "k").alias("d")).collect()
    assert all(r.t == ticket(3, r.id, r.k) and r.d == ticket("x", r.k) % 7 for r in got)
    assert sorted((r.number, r.id) for r in choice.numbered(rows, F.col("id").desc()).collect()) == [(i, 199 - i) for i in range(200)]
    assert choice.numbered(rows.filter("false"), "id").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 100, 4097])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(choice.permuted(F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n > 50:
        assert sum(i == p for i, p in enumerate(got)) < n / 5 and got != [r.p for r in spark.range(n).select(choice.permuted(F.col("id"), n, 6).alias("p")).collect()]


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_smallest_tickets(spark, bits):
    data = [(i, [None, "a", "b", "c"][min(3, i % 9)]) for i in range(300)]
    rows = spark.createDataFrame(data, "id bigint, k string").repartition(5)
    quotas = {None: 4, "a": 1000, "b": 0}
    asked = spark.createDataFrame(list(quotas.items()), "k string, quota bigint")
    got = choice.smallest(rows, asked, ["k"], choice.ticket(8, "id"), "id", bits=bits)
    want = [x for k, q in quotas.items() for x in sorted((d for d in data if d[1] == k), key=lambda d: ticket(8, d[0]))[:q]]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    for n in (0, 7, 300, 999):
        assert {r.id for r in choice.exactly(rows, n, choice.ticket(8, "id"), "id").collect()} == {d[0] for d in sorted(data, key=lambda d: ticket(8, d[0]))[:n]}


@pytest.mark.parametrize("n,weights", [(40, {"a": 9}), (3, {}), (500, {"b": 1000})])
def test_weighted_sample(spark, n, weights):
    data = [(i, "abcdefg"[min(6, i % 20)]) for i in range(150)] + [(3, "d"), (4, "z")]  # ids 3 and 4 twice
    rows = spark.createDataFrame(data, "id bigint, k string")
    weight = F.coalesce(*[F.when(F.col("k") == k, w) for k, w in weights.items()], F.lit(30))
    got = sorted(map(tuple, choice.weighted_sample(rows, "k", "id", n, 2, weight).collect()))
    once = {}
    for i, k in sorted(data, reverse=True):
        once[i] = k
    strata = sorted(set(once.values()))
    total, first = sum(weights.get(k, 30) for k in strata), []
    for k in strata:
        first += sorted((i for i in once if once[i] == k), key=lambda i: ticket(2, i))[: max(1, n * weights.get(k, 30) // total)]
    if len(first) > n:
        first = sorted(first, key=lambda i: ticket(4, i))[:n]
    first += sorted(set(once) - set(first), key=lambda i: ticket(3, i))[: max(0, n - len(first))]
    assert got == sorted((i, once[i]) for i in first)


# ---------------------------------------------------------------------------------------------------------------------


def brute_mixed(blocks, prose, seed, share, least, most):
    good = lambda t, s: all(t[a:b] == x for x, _, a, b in s)
    apart = lambda s: all(x[3] <= y[2] for x, y in zip(sorted(s, key=lambda q: q[2:]), sorted(s, key=lambda q: q[2:])[1:], strict=False))
    lot = set(sorted((b[0] for b in blocks), key=lambda i: ticket(seed, i))[: int(len(blocks) * share)])
    cursor, out, pool = 0, {}, sorted(prose)
    for i, text, s in sorted(blocks):
        if not good(text, s):
            continue
        out[i] = (i in lot, None, text, sorted((a, b) for _, _, a, b in s))
        if i in lot and pool:
            j, lead, t = pool[cursor % len(pool)]
            both = lead + "\n\n" + text
            if good(lead, t) and apart(t) and apart(s) and least <= len(both) <= most:
                by = len(lead) + 2
                out[i] = (True, j, both, sorted([(a, b) for _, _, a, b in t] + [(a + by, b + by) for _, _, a, b in s]))
                cursor += 1
    return out


KIND = "id bigint, text string, spans array<struct<text:string,type:string,start:int,end:int>>"


@pytest.mark.parametrize("case,run", [("all fit", 4), ("doubt", 7), ("doubt", 1 << 20), ("bad prose", 5), ("no prose", 5), ("none fits", 5), ("one prose", 3)])
def test_mixed_by_turns(spark, case, run):
    r = random.Random(case)
    blocks = []
    for i in range(60):
        text = f"item{i} " + "x" * r.randint(0, 60)
        s = [(f"item{i}", "A", 0, 4 + len(str(i)))]
        if i % 10 == 3:
            s = [("other", "A", 0, 5)]
        if i % 10 == 7:
            s = [*s, ("em", "B", 2, 4)]
        blocks.append((i, text, s if i % 10 != 9 else []))
    prose = [(100 + j, "é" * r.randint(5, 40), [("é", "C", 1, 2)]) for j in range(1 if case == "one prose" else 6)]
    least, most = (40, 80) if case in ("doubt", "bad prose", "one prose") else ((0, 9000) if case != "none fits" else (9000, 9999))
    if case == "bad prose":
        prose[3] = (103, "abc", [("zz", "C", 0, 2)])
    if case == "no prose":
        prose = []
    got = merging.mixed(spark.createDataFrame(blocks, KIND).repartition(4), spark.createDataFrame(prose, KIND), 9, 0.6, least, most, run).collect()
    want = brute_mixed(blocks, prose, 9, 0.6, least, most)
    assert {x.id: (x.tried, x.prose_id, x.text, [(s.start, s.end) for s in x.spans]) for x in got} == want and len(got) == len(want)
    assert all(x.text[s.start : s.end] == s.text for x in got for s in x.spans)
    merged = sum(x.prose_id is not None for x in got)
    assert (merged > 0) == (case not in ("no prose", "none fits"))


def test_noise_is_counted_and_behind_the_last_span(spark):
    r = random.Random(4)
    data = [(i, " ".join("".join(r.choices("abcdéxyzà1.", k=r.randint(1, 9))) for _ in range(r.randint(0, 60))), r.randint(0, 40), r.randint(0, 4), r.randint(0, 3)) for i in range(150)]
    data += [(1000, "", 0, 2, 2), (1001, "lonely", 99, 1, 1)]
    rows = spark.createDataFrame(data, "id bigint, text string, last int, g int, m int")
    key, last = F.col("id"), F.col("last")
    got = rows.select("*", generate.glued(F.col("text"), last, F.col("g"), 1, key).alias("glued"), generate.with_noise(F.col("text"), last, 1, key, F.col("g"), F.col("m")).alias("noisy"), generate.with_noise(F.col("text"), last, 1, key).alias("free")).collect()
    for x in got:
        spots = [i for i in range(x.last + 6, len(x.text) - 1) if x.text[i] == " " and x.text[i - 1].isalpha() and x.text[i + 1].isalpha()]
        gone = sorted(spots, key=lambda i, s=spots, k=x.id: ticket(1, "glue", k, s.index(i) + 1))[: x.g]
        assert x.glued == "".join(c for i, c in enumerate(x.text) if i not in gone)
        assert x.noisy[: x.last] == x.text[: x.last] and len(x.glued) == len(x.text) - min(x.g, len(spots))
        assert x.noisy.count("***") <= x.m and x.free[: x.last] == x.text[: x.last] and x.free.count("***") <= 2
        import re

        words = [w for w in re.findall("[A-Za-zÀ-ỹ]+", x.glued[x.last :]) if len(w) >= 5]
        assert x.noisy.count("***") == min(x.m, len(words))


@pytest.mark.parametrize("n", [0, 3, 9, 57, 230])
def test_results_have_exact_shares(spark, n):
    got = generate.lab_results(spark.range(n), ["g/l", "%"], 3, "id").collect()
    assert len(got) == n == len({r.id for r in got})
    counts = Counter(r.format for r in got)
    each = max(1, n // 10)
    for f in generate.FORMATS[: -(-n // each)]:
        assert counts[f] == each or f in ("number", "quality", "trend") and counts[f] >= each or n < 8
    rx = {"number": r"\d+([.,]\d{1,2})? (g/l|%)", "comma": r"\d{1,2},\d\d (g/l|%)", "pressure": r"1\d\d/(\d\d|100) mmHg", "threshold": r"[<>≤≥] \d+([.,]\d{1,2})?( \((bình thường|tăng cao)\))?", "pairs": r"\S+: \d+([.,]\d{1,2})? (g/l|%)(  \S+: \d+([.,]\d{1,2})? (g/l|%)){1,3}"}
    import re

    for r in got:
        assert re.fullmatch(rx[r.format], r.result) if r.format in rx else r.result in {"quality": generate.QUALITIES, "trend": generate.TRENDS, "words": generate.IN_WORDS}[r.format]


# ---------------------------------------------------------------------------------------------------------------------


def test_chains_against_all_subsets():
    r = random.Random(2)
    for _ in range(300):
        rows = sorted((lambda s: (s + r.randint(0, 6), s, r.randint(-3, 9)))(r.randint(0, 14)) for _ in range(r.randint(0, 9)))
        ends, starts, scores = ([x[i] for x in rows] for i in (0, 1, 2))
        some = grouped.best_chain(starts, ends, scores)
        assert all(ends[a] <= starts[b] for a, b in zip(some, some[1:], strict=False))
        best = max(sum(scores[i] for i in range(len(rows)) if k >> i & 1) for k in range(1 << len(rows)) if all(ends[a] <= starts[b] for a in range(len(rows)) if k >> a & 1 for b in range(a + 1, len(rows)) if k >> b & 1))
        assert sum(scores[i] for i in some) == best


def test_greedy_against_a_scan_of_all_taken():
    r = random.Random(6)
    for _ in range(400):
        rows = [(lambda s: (s, s + r.choice([0, 0, 1, 2, 5])))(r.randint(0, 12)) for _ in range(r.randint(0, 12))]
        taken, want = [], []
        for i, (s, e) in enumerate(rows):
            if not any(a < e and s < b for a, b in taken):
                taken.append((s, e))
                want.append(i)
        assert grouped.greedy([x[0] for x in rows], [x[1] for x in rows]) == want


def test_a_hundred_thousand_spans_of_one_document(spark):
    r = random.Random(1)
    rows = [(1, s, s + r.randint(1, 50), r.randint(1, 100), i) for i, s in enumerate(r.randint(0, 10**6) for _ in range(100_000))]
    df = spark.createDataFrame(rows, "doc_id bigint, start bigint, end bigint, score bigint, k bigint").cache()
    df.count()
    begun = time.time()
    got = spans.best_disjoint(df, "start", "k").collect()
    some = spans.longest_first(df, "start", "k").collect()
    assert time.time() - begun < 30
    for found in (got, some):
        found = sorted((x.start, x.end) for x in found)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    ordered = sorted((e, s, k, w) for _, s, e, w, k in rows)
    ends, best = [x[0] for x in ordered], [0]
    from bisect import bisect_right

    for i, (_, s, _, w) in enumerate(ordered):
        best.append(max(best[i], w + best[bisect_right(ends, s, 0, i)]))
    assert sum(x.score for x in got) == best[-1]
    df.unpersist()


def test_groups_that_go_over_batches(spark):
    r = random.Random(7)
    rows = [(r.choice([None, "a", "b", "ç"]), r.choice([None, 1, 2]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, m int, v int").repartition(3)
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = grouped.pick_in_groups(df, ["k", "m"], ["v"], ["v"], lambda v: [0, len(v) - 1] if len(v) > 1 else [0]).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        want = {}
        for k, m, v in rows:
            want.setdefault((k, m), []).append(v)
        assert Counter(map(tuple, got)) == Counter((k, m, v) for (k, m), vs in want.items() for v in {min(vs), max(vs)})
    assert grouped.pick_in_groups(df.filter("false"), ["k"], ["v"], ["v"], lambda v: [0]).count() == 0


# ---------------------------------------------------------------------------------------------------------------------
# blocks and inputs by content


def draw(seed, *keys):
    return ticket(seed, *keys) / float(1 << 60)


def pick(options, u):
    return options[int(u * len(options))]


def brute_block(key, items, heads, negative_heads, negatives, seed, sections=3):
    from spanloom.operators import compose as c

    u = lambda i, *k: draw(seed + i, key, *k)
    x = [items[i] for i in sorted(range(len(items)), key=lambda i: (draw(seed, key, i), i))]
    layout, case, bullet, indent, colon, blank, numbering = (pick(o, u(i)) for i, o in enumerate((c.LAYOUTS, c.CASES, c.BULLETS, c.INDENTS, c.COLONS, c.BLANKS, c.NUMBERING), 1))
    cased = {"upper": str.upper, "title": str.title, "lower": str}[case]
    line = lambda head, number: (number + " " if number else "") + cased(head) + colon + "\n"
    lead = indent + (bullet + " " if bullet else "")
    size = max(1, len(x) // sections)
    text, spans = "", []
    for i, (said, kind) in enumerate(x):
        mine = min(i // size, sections - 1)
        first, last = i == 0 or min((i - 1) // size, sections - 1) != mine, i == len(x) - 1 or min((i + 1) // size, sections - 1) != mine
        if first:
            text += line(pick(heads, draw(seed + 8, key, mine)), numbering if i == 0 else None)
        text += lead if layout == "bullet" else f"{indent}{i - mine * size + 1}. " if layout == "numbered" else ""
        spans.append((said, kind, len(text), len(text) + len(said)))
        text += said + (", " if layout == "inline" and not last else "\n") + ("\n" * blank if last else "")
    if u(12) < c.NEGATIVE_SHARE:
        some = sorted(range(len(negatives)), key=lambda i: (draw(seed + 10, key, i), negatives[i]))[: int(u(9) * 4) + 2]
        text += line(pick(negative_heads, u(11)), None) + "".join(lead + negatives[i] + "\n" for i in some) + "\n"
    return text, spans


def test_blocks_by_content(spark):
    from spanloom.operators import compose

    heads, negative_heads, negatives = ["Kham lam sang", "hoi dap", "tien su"], ["phu nhan", "khong co"], ["khong sot", "khong ho", "khong phu", "khong non", "khong dau"]
    data = [(i, [(f"item {i}-{j}", "AB"[j % 2]) for j in range(i % 8)]) for i in range(120)]
    rows = spark.createDataFrame(data, "id bigint, items array<struct<text:string,type:string>>")
    got = {r.id: (r.text, [(s.text, s.type, s.start, s.end) for s in r.spans]) for r in compose.blocks(rows, heads, negative_heads, negatives, 11).collect()}
    assert got == {i: brute_block(i, items, heads, negative_heads, negatives, 11) for i, items in data}


def test_article_inputs_by_content(spark):
    from spanloom.operators import compose

    tests, drugs_said, tests_said, denials, families, histories = ["ALT", "AST", "CRP", "WBC", "HbA1c", "Ure"], ["a1", "a2"], ["x1", "x2", "x3"], ["không {tc}", "chưa {tc}"], ["gia đình"], ["tiền sử"]
    titles, seed = ["{d} là gì", "vì sao {d}", "khi nào", "điều trị {d}", "phòng {d}"], 6
    data = [(i, f"bệnh {i}", [f"ho{j}" for j in range(i % 8)], [f"thuốc{j}" for j in range(i % 9)]) for i in range(150)]
    rows = spark.createDataFrame(data, "id bigint, diagnosis string, symptoms array<string>, drugs array<string>")
    got = compose.article_inputs(rows, tests, drugs_said, tests_said, denials, families, histories, titles, seed).collect()
    assert len(got) == 150
    for r in got:
        k, diagnosis, symptoms, given = data[r.id]
        u = lambda i, *j: draw(seed + i, k, *j)  # noqa: E731, B023
        shuffled = lambda xs, i: [xs[j] for j in sorted(range(len(xs)), key=lambda j: (u(i, j), j))]  # noqa: E731, B023
        some = lambda xs, i, n: shuffled(xs, i)[:n]  # noqa: E731, B023
        own = [(diagnosis, "CHAN_DOAN"), *((s, "TRIEU_CHUNG") for s in symptoms), *((d, "THUOC") for d in given), *((t, "TEN_XET_NGHIEM") for t in some(tests, 1, int(u(2) * 6)))]
        assert [tuple(x) for x in r.required] == shuffled(own, 11)[:14]
        assert r.mentioned == some(drugs_said, 12, int(u(13) * 2) + 1) + some(tests_said, 14, int(u(15) * 2) + 1)
        said = [pick(denials, u(5)).replace("{tc}", pick(symptoms, u(3)))] if u(4) < 0.6 and symptoms else []
        said += [pick(families, u(7))] if u(6) < 0.5 else []
        said += [pick(histories, u(9))] if u(8) < 0.5 else []
        assert r.context == said and r.titles == [t.replace("{d}", diagnosis) for t in some(titles, 10, 4)]
        assert (r.n_glue, r.n_mask) == (int(u(16) * 4) + 1, int(u(17) * 3))
