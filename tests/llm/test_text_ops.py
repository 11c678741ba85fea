"""Chat, WARC, mixing, HTML, quality, URLs, BPE against SQL, brute force or exact round trips."""

import collections
import datetime
import hashlib
import io
import math
import random
import re
from html.parser import HTMLParser

import duckdb
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, chat, html, mixing, neardup, quality, queries, suffixes, urls, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, key string, size int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(i, t, None, s, None, "x", "y", 7) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    cols = sorted(want.columns)
    got, want = (d[cols].sort_values(cols, ignore_index=True).astype(object).where(lambda x: x.notna(), None) for d in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|> <\\|x|> <\\\\| <| end"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 0, "assistant", "first"), (2, 1, "odd\\n\nrole<|", "x\n<|im_start|>"), (3, 0, None, None), (None, None, "user", "n"), (None, None, "user", "n"),
]


def test_chat_round_trip_and_machine(spark):
    rows = spark.createDataFrame(CHATS, "conv_id bigint, turn bigint, role string, text string").withColumn("segments", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_conversations(rows).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    for c in (1, 2, 3, None):
        mine = sorted((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in CHATS if x[0] == c)
        assert [(t["role"], t["text"]) for t in got[c]["back"]] == [x[1:] for x in mine]
        assert got[c]["loss"] == "".join(x[2] for x in mine if x[1] == "assistant")
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
    assert [got[c]["valid"] for c in (1, 2, 3, None)] == [True, False, False, False]
    assert chat.format_conversations(rows.limit(0)).count() == 0


BRACKETS = {"open": "[TURN]", "close": "[/TURN]", "between": "\n"}


def test_chat_other_templates(spark):
    texts = ["a [/TURN]\n[TURN]user\nb", "[", "[/", "[\\/TURN]", "[[TURN]", "[\\\\T", "x[T]\\", "TURN][/TURN]", "<|im_end|>"]
    rows = spark.createDataFrame([(i, k, "user" if k else t, t) for i, t in enumerate(texts) for k in (0, 1)], "conv_id bigint, turn bigint, role string, text string")
    t = chat.Template(**BRACKETS, loss_roles=("user",))
    got = chat.format_conversations(rows, t).withColumn("back", chat.read_back(F.col("formatted"), t)).withColumn("loss", chat.loss_text(F.col("segments"), t)).collect()
    for r in got:
        x = texts[r["conv_id"]]
        assert [(b["role"], b["text"]) for b in r["back"]] == [(x, x), ("user", x)] and r["loss"] == x
    for bad in ({"open": "<"}, {"open": "<<s>"}, {"close": "\\n|"}, {"close": "<|a<|"}, {"between": "<"}, {"open": "|<"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_chat_is_native(spark):
    plan = chat.op1_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_warc_records():
    payloads = [b"", b"x" * 5, "é\r\n\r\n".encode() * 1000, b"y" * 3_000_000]
    data = b"".join(warc.member(warc.record(i, "http://a/\n b", p, None)) for i, p in enumerate(payloads)) + warc.member(warc.record(None, None, payloads[2], 2))
    got = list(warc.read_records(io.BytesIO(data), payloads=True))
    assert [g["payload"] for g in got] == [*payloads, None] and got[4]["refers_to"] == 2 and got[4]["page_id"] is None and got[4]["payload_bytes"] == len(payloads[2])
    with pytest.raises((ValueError, EOFError)):
        list(warc.read_records(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc.member(warc.record(1, None, b"abc", None).replace(b"abc", b"abd")))))


def test_warc_revisits(spark):
    big, other = "a" * 1000, "b" * 999
    rows = spark.createDataFrame([(1, "u", big), (5, "u", big), (3, None, big), (5, "w", big), (2, "u", other), (4, "u", other), (6, "u", None), (None, "u", big)], "page_id bigint, url string, html string").withColumn("payload", F.lit("clash"))
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(warc.write_archives(warc.with_references(rows))).collect()}
    assert got == {(1, "revisit", 5, 1000), (5, "response", None, 1000), (3, "revisit", 5, 1000), (2, "response", None, 999), (4, "response", None, 999), (6, "response", None, 0), (None, "revisit", 5, 1000)}
    assert warc.read_archives(warc.write_archives(warc.with_references(rows.limit(0)))).count() == 0


def knapsack(counts, budget):
    """The largest sum of some of the counted lengths up to budget."""
    sums = {0}
    for length, n in counts:
        sums = {x + length * k for x in sums for k in range(n + 1) if x + length * k <= budget}
    return max(sums)


def test_subset():
    r = random.Random(3)
    for _ in range(300):
        counts, budget = [(a, r.randint(1, 6)) for a in r.sample(range(1, 60), r.randint(1, 6))], r.randint(0, 200)
        got = mixing.subset(counts, budget)
        assert sum(a * k for a, k in got.items()) == knapsack(counts, budget) and all(k <= dict(counts)[a] for a, k in got.items())
    big = mixing.subset([(a, 3) for a in range(100_003, 100_503)], 999_999)  # one budget, not one per length
    assert 0.9 * 999_999 < sum(a * k for a, k in big.items()) <= 999_999


def true_targets(total, share=1.5, cap=2.0):
    order = sorted(total, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        left = share * sum(total.values()) - sum(fixed.values())
        goal = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: cap * total[s] for s in free if goal[s] > cap * total[s]}
        if not over:
            return goal | fixed
        fixed |= over


def check_mix(got, rows):
    """Rows of the query against documents (id, text, source): sizes, targets and what is taken of each source and document."""
    size = lambda t: len(WORD.findall(t or ""))
    total, longest = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        total[s] += size(t)
        longest[s] = max(longest[s], size(t))
    goal = true_targets(dict(total))
    assert collections.Counter((r.doc_id, r.size, r.source_size) for r in got) == collections.Counter((i, size(t), total[s]) for i, t, s in rows)
    taken, of = collections.Counter(), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        near = [s for s in goal if abs(goal[s] - r.target) < 1e-6 * max(1, goal[s]) and total[s] == r.source_size]
        assert near
        of.setdefault((r.target, r.source_size), near)
        taken[r.target, r.source_size] += r.taken
    for k, sources in of.items():
        assert abs(taken[k] - k[0] * len(sources)) <= len(sources) * max(longest[s] for s in sources), (k, taken[k])


def test_mixing(spark):
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 200.0, "b": pytest.approx(250 * 2 / 3), None: pytest.approx(250 / 3)}
    rows = [(i, " ".join(["w"] * (i % 17)), ["a", "b", "c", None][i % 4]) for i in range(400)] + [(1000 + i, "same text of five words here", "hot") for i in range(300)] + [(5, None, "a"), (6, "", "b"), (1000, "same text of five words here", "hot"), (7, "x " * 5000, "b")]
    table = docs(spark, rows)
    got = mixing.mix(table).toPandas()
    check_mix(list(got.itertuples()), rows)
    again = mixing.mix(table).toPandas()
    assert sorted(map(tuple, got[["doc_id", "taken"]].to_numpy())) == sorted(map(tuple, again[["doc_id", "taken"]].to_numpy()))
    kept = mixing.keep_mix(table)
    assert kept.columns == table.columns and kept.count() == (got["taken"] / got["size"].clip(lower=1)).sum()
    assert mixing.mix(table.limit(0)).count() == 0 and mixing.keep_mix(table.limit(0)).count() == 0


def test_mix_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    check_mix(list(mixing.op3_mix_sources(spark, SF).toPandas().itertuples()), rows)


def test_html_blocks_and_labels():
    page = "<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body>a &lt;b&gt; < c<p>one\n two<br>three<p>four &amp; <b>five</b><!-- no --><ul><li>x<li>y</ul><script>z"
    assert [b[1] for b in html.blocks(page)] == ["a <b> < c", "one two three", "four & five", "x", "y"]
    assert html.blocks(None) == [] and html.blocks("") == []
    assert len(html.blocks("<p>" + "x" * 200_000 + '<a href="' + "y" * 1000)) == 1
    model = html.trained()
    held = html.sample_pages(200, 4242)
    got = model.label([html.vectors(html.blocks(p)) for p, _ in held])
    right = sum(int(a == b) for g, (_, y) in zip(got, held, strict=True) for a, b in zip(g, y, strict=True))
    assert right / sum(len(y) for _, y in held) > 0.98


@pytest.mark.parametrize("odd", ["<svg viewBox='0 0 1 1'/>", "<svg-icon></svg-icon>", "<button-group>", "<select-x>", "<button>", "<script src=x />", "<style/>", "<title>", "<title-bar>", "<object>", "<script-x>"])
def test_html_odd_elements_lose_no_text(odd):
    assert [b[1] for b in html.blocks(f"<article><p>one</p>{odd}<p>two</p><p>three</article>")] == ["one", "two", "three"]


def test_html_inner_text_is_kept():
    assert [b[1] for b in html.blocks("<p>a <math><mi>x</mi></math> b<p><object>c</object> <noscript>d</noscript><p>e<script>f</script ><style>g</style>")] == ["a x b", "c d", "e"]


FIRST, LAST = "The river rose again overnight, and the old bridge was closed.", "Repairs will take until spring, the council said on Monday."


@pytest.mark.parametrize("odd", ["<!-->", "<!--->", "<!-- x --!>", "<!-- a > b -->", "<!---->", "<!-- <p>no</p> -->", "<script/>var x=1;</script>", '<style media="a"/>p{}</style>', "<template><p>No.</p></template>", "<iframe src=x>No.</iframe>", "<textarea><p>No.</p></textarea>", "<select><option>One<option>Two</select>", "<select><option>One</option><option>Two</option></select>", "<button>Send</button>", "<button class=share><div>Send</div></button>", "<label>Your name</label><input>", "<p><label>Your name</p>"])
def test_html_comments_and_controls(spark, odd):
    pages = [f"<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>River</h1><p>{FIRST}</p>{odd}<p>{LAST}</p></article><footer>&copy; x</footer></body></html>"]
    got = html.extract(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")).collect()
    assert [r.text for r in got] == [f"River\n\n{FIRST}\n\n{LAST}"]


def test_html_controls_within_prose_and_lists():
    def shown(page):
        b = html.blocks(page)
        return [t for p, t, _ in b if html.CONTROLS.isdisjoint(p)], [t for p, t, _ in b if not html.CONTROLS.isdisjoint(p)]

    assert shown("<p>Hello <button>Share now</button> more<p>next") == (["Hello more", "next"], ["Share now"])
    assert shown("a<select><option>x<option>y</select>b<textarea>c<p>d</textarea> e") == (["a b e"], ["x", "y", "c<p>d"])
    assert shown("<ul><li>one <label>two<li>three</ul><p>four") == (["one", "three", "four"], ["two"])
    assert shown("<p>one <label>two<p>three") == (["one", "three"], ["two"])
    assert shown("<div>a <button>b</div>c</button>d") == (["a", "cd"], ["b"])
    assert shown("<div>a <select>b") == (["a"], ["b"])
    assert shown("</button></label>x<label/>y</label>z") == (["x z"], ["y"])
    # the prose keeps its place before the control's text
    assert [t for _, t, _ in html.blocks("<p>one <button>two</button> three</p><p>four")] == ["one three", "two", "four"]


def test_html_held_out_controls():
    model, held = html.trained(), html.sample_pages(150, 977)
    pages = [html.blocks(p) for p, _ in held]
    got = model.label([html.vectors(b) for b in pages])
    with_controls = [i for i, b in enumerate(pages) if any(not html.CONTROLS.isdisjoint(p) for p, _, _ in b)]
    wrong = sum(int(a != b) for i in with_controls for a, b in zip(got[i].tolist(), held[i][1], strict=True))
    assert len(with_controls) > 50 and wrong <= 0.005 * sum(len(pages[i]) for i in with_controls)


def test_html_gradients():
    import numpy as np

    r = np.random.default_rng(1)
    m = html.Labeller(3)
    x, mask = r.standard_normal((5, 3, html.WIDTH)).astype(np.float32), np.ones((5, 3), np.float32)
    mask[3:, 1] = 0
    y = (r.random((5, 3)) > 0.5).astype(np.float32)

    def loss():
        p = np.clip(m.run(x, mask)[0].astype(np.float64), 1e-7, 1 - 1e-7)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    g = m.gradients(x, mask, y)
    for k in m.p:
        at = tuple(0 for _ in m.p[k].shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-2
        up = loss()
        m.p[k][at] = old - 1e-2
        down = loss()
        m.p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3


class Reader(HTMLParser):
    """The blocks of a page by the standard library's parser, each with whether it lies in the element that ``inside`` accepts."""

    BLOCK = set("address article aside blockquote body div dl dt dd fieldset figure footer form h1 h2 h3 h4 header hr html li main nav ol p pre section table tbody td th tr ul title".split())

    def __init__(self, page, inside):
        super().__init__(convert_charrefs=True)
        self.inside, self.depth, self.open, self.skip, self.parts, self.out = inside, 0, [], 0, [], []
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append((text, any(good for _, good in self.open)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.skip += 1
        if tag in self.BLOCK:
            self.cut()
            self.open.append((tag, self.inside(tag, dict(attrs))))
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.skip -= 1
        if tag in self.BLOCK:
            self.cut()
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    del self.open[i:]
                    break

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


A = "The river rose again on Tuesday, and the bridge at Lower Ashton was closed to traffic for the third time &mdash; this spring."
B = "Engineers said the piers are <b>sound</b>. They expect to open one lane by Friday,\n if the water falls as forecast."
C = "For the farmers downstream, the flood has been a mixed blessing: the silt is rich, but the seed is gone."
#: Layouts that no page of the tables has; the article is the element with data-x.
LAYOUTS = [
    f"<html><body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><article data-x><h1>River floods bridge</h1><p>{A}</p><p>{B}</p><p>{C}</p></article><footer>&copy; 2024 Ashton Gazette</footer></body></html>",
    f"<html><body><header><a href=/>Gazette</a></header><main data-x><h1>River floods bridge</h1><p>{A}</p><ul><li>{B}</li></ul><p>{C}</p></main><aside><h3>Related</h3><ul><li><a href=/a>Snow in May</a></ul></aside><footer><p>All rights reserved.</p></footer></body></html>",
    f"<html><body><div class=menu><a href=/>Home</a> <a href=/n>News</a></div><div data-x class='content'><h2>River floods bridge</h2><p>{A}</p><p>{B}</p><p>{C}</p></div><div class=sidebar><p>Weather today: rain.</p></div><div id=footer>Contact us</div></body></html>",
    f"<html><body><div id=nav><ul><li><a href=/>Home</a></ul></div><div data-x id=post><h1>River floods bridge</h1><p>{A}</p><blockquote>{B}</blockquote><p>{C}</p></div><section class=comments><h3>Comments</h3><div class=comment><p>I saw it, it was awful.</p></div><div class=comment><p>Same here, stay safe all.</p></div></section><footer>&copy; x</footer></body></html>",
    f"<html><body><div class=cookie-notice><p>We use cookies.</p><button>OK</button></div><article data-x class=post><h1>River floods bridge</h1><p>{A}</p><table><tr><td>Level</td><td>4.2 m</td></tr></table><p>{B}</p><p>{C}</p></article><form><label>Search</label><input><button>Go</button></form><footer>Imprint</footer></body></html>",
]


def test_html_layouts(spark):
    """Other layouts, held against the standard library's parser; an advert within the article goes too."""
    extra = LAYOUTS[2].replace(f"<p>{C}", f"<div class=ad><p>Buy boots now!</p></div><p>{C}")
    long = LAYOUTS[0].replace(f"<p>{C}</p>", f"<p>{C}</p>" * 3000 + "<p>" + "long " * 100_000 + "</p>")
    rows = [(i, None, p) for i, p in enumerate([*LAYOUTS, extra, long])]
    table = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars string, k int")
    got = {r["page_id"]: r["text"] for r in html.extract(table).collect()}
    want = [[t for t, good in Reader(p, lambda tag, attrs: "data-x" in attrs).out if good] for p in (*LAYOUTS, LAYOUTS[2], long)]
    assert all(len(w) >= 4 for w in want)
    assert {i: t.split("\n\n") for i, t in got.items()} == dict(enumerate(want))
    assert html.extract(table.limit(0)).count() == 0


def test_html_query(spark):
    """Every page of the table: the article's blocks as the standard library's parser finds them."""
    got = html.op4_html_extract(spark, SF).toPandas()
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")
    assert len(got) == len(pages)
    for r in got.itertuples():
        inner = [t for t, good in Reader(pages.html[r.page_id], lambda tag, attrs: tag == "article").out if good]
        assert r.text == "\n\n".join(inner) and r.n_chars == len(r.text) and r.url == pages.url[r.page_id]
    rows = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "")], "page_id bigint, url string, html string")
    assert sorted(tuple(r) for r in html.extract(rows).collect()) == [(1, None, "", 0), (2, "u", "", 0), (2, "u", "", 0)]


def measured(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


TEXTS = [None, "", " \n\t", "a", "a a a a a", "x\n\nx\nx ", "é ü z\r\nq #*$", "\n", "a b c\na b c\n a b c", "ab " * 30_000, "漢字 <b>|&%", "x" * 2_100_000 + " y", "line\n" * 500]


def test_quality_measures():
    got = quality.measure(pa.array(TEXTS, pa.string()))
    for i, t in enumerate(TEXTS):
        assert tuple(int(got[m][i]) for m in quality.MEASURES) == measured(t)


def true_verdicts(rows, rules=quality.Rules()):
    """id to (measures, base_failed, kept), by a plain loop over documents and hosts."""
    out, hosts = {}, collections.defaultdict(list)
    for i, t, host in rows:
        m = measured(t)
        fails = (m[0] < rules.least_words, 100 * m[4] > rules.repeat_percent * m[0])
        out[i] = (m, any(fails), host)
        if host is not None:
            hosts[host].append(fails)
    bad = set()
    for k in (0, 1):
        rate = {h: sum(f[k] for f in fs) / len(fs) for h, fs in hosts.items()}
        mean = sum(rate.values()) / max(1, len(rate))
        var = sum((x - mean) ** 2 for x in rate.values()) / max(1, len(rate))
        noise = mean * (1 - mean) * sum(1 / len(fs) for fs in hosts.values()) / max(1, len(rate))
        weight = min(1000, max(1, mean * (1 - mean) / (var - noise) - 1)) if var > noise else 1000
        limit = min(0.7, max(0.2, mean + 3 * math.sqrt(mean * (1 - mean) / (weight + 1))))
        bad |= {h for h, fs in hosts.items() if (sum(f[k] for f in fs) + mean * weight) / (len(fs) + weight) > limit}
    return {i: (m, failed, not failed and host not in bad) for i, (m, failed, host) in out.items()}, bad


def check_quality(got, rows):
    want, bad = true_verdicts(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (tuple(r[m] for m in quality.MEASURES), r["base_failed"], r["kept"]) == want[r["doc_id"]]
    return bad


GOOD = " ".join(f"w{i}" for i in range(60))


def test_quality_hosts(spark):
    """Two hosts: one that fails nearly always goes, as the limit is never over ``high``."""
    rows = [(i, f"{GOOD} g{i}", "fine") for i in range(50)] + [(100 + i, "too short", "bad") for i in range(49)] + [(149, GOOD, "bad"), (150, GOOD, None), (151, None, None)]
    table = docs(spark, rows)
    got = quality.verdicts(table).collect()
    assert check_quality(got, rows) == {"bad"}
    kept = quality.keep_good(table)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}
    assert quality.verdicts(table.limit(0)).count() == 0 and quality.keep_good(table.limit(0)).count() == 0


def test_quality_hosts_that_stand_out(spark):
    """Of 40 hosts that fail at 3 to 12 % and two that fail at 45 and 60 %, the two go: far under ``high``, but far over the prior. One
    with a single bad document stays, as its rate is shrunk."""
    rows = []
    for h in range(40):
        rows += [(h * 100 + k, "short" if k < 3 + h % 10 else f"{GOOD} {h} {k}", f"h{h}") for k in range(100)]
    for h, share in ((40, 45), (41, 60)):
        rows += [(h * 100 + k, "la " * 60 if k < share else f"{GOOD} {h} {k}", f"h{h}") for k in range(100)]
    rows += [(9000, "short", "tiny"), (9001, GOOD, None)]
    assert check_quality(quality.verdicts(docs(spark, rows)).collect(), rows) == {"h40", "h41"}


def test_quality_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    check_quality(quality.op5_quality_rules(spark, SF).collect(), rows)


LOG = [
    ("Bad.org", "domain", "add", "2024-01-10 20:00:00"), ("bad.org", "domain", "remove", "2024-02-01 06:00:00"), ("ads", "path", "add", "2024-01-01"), ("ads", "path", "add", "2024-01-05"), (None, "domain", "add", "2024-01-01"),
    ("org", "domain", "add", "2024-03-01 00:00:01"), ("once.net", "domain", "add", "2024-01-01"), ("once.net", "domain", "remove", "2024-01-01"),
]


@pytest.mark.parametrize("bound", [100_000, 0])
def test_url_lists(spark, monkeypatch, bound):
    """The same verdicts whether the list is broadcast or joined by shuffle."""
    monkeypatch.setattr(urls, "BROADCAST_INTERVALS", bound)
    log = spark.createDataFrame(LOG, "pattern string, kind string, action string, time string")
    rows = [
        (1, "http://x.bad.org/a", "2024-01-10 20:00:00"), (2, "http://x.bad.org/a", "2024-02-01 06:00:00"), (3, "http://notbad.org/ads/x?y", "2023-12-31"), (4, "http://notbad.org/ads/x?y", "2024-03-01"), (5, None, "2024-01-11"), (6, "http://bad.org", None),
        (7, "", "2024-01-11"), (1, "http://x.bad.org/a", "2024-01-10 20:00:00"), (8, "http://x.bad.org/a", "2024-01-10 08:00:00"), (9, "http://x.bad.org/a", "2024-02-01 05:59:59"), (10, "http://z.org", "2024-03-01 00:00:00"), (11, "http://z.org", "2024-03-01 00:00:01"), (12, "http://once.net/", "2024-01-01"),
    ]
    rows += [(1000 + i, f"http://h{i}.org/{'ads' if i % 3 else ''}", "2024-03-02") for i in range(3000)]
    caps = spark.createDataFrame([(i, u, datetime.datetime.fromisoformat(d) if d else None, 1, 2) for i, u, d in rows], "page_id bigint, url string, fetched timestamp_ntz, k string, __key int")
    got = urls.judge_captures(caps, log).collect()
    assert len(got) == len(rows) and {r["page_id"] for r in got if r["blocked"] and r["page_id"] < 1000} == {1, 4, 9, 11}
    assert all(r["n_entries"] == 1 + ((r["page_id"] - 1000) % 3 > 0) for r in got if r["page_id"] >= 1000)
    kept = urls.drop_blocked(caps, log)
    assert kept.columns == caps.columns and kept.count() == 8 and urls.judge_captures(caps.limit(0), log).count() == 0
    assert urls.judge_captures(caps, log.limit(0)).filter("blocked").count() == 0


@pytest.mark.parametrize("make", ["fetched timestamp", "fetched date", "fetched string"])
def test_url_time_types(spark, make):
    log = spark.createDataFrame(LOG, "pattern string, kind string, action string, time string")
    caps = spark.createDataFrame([(1, "http://bad.org", "2024-01-10 23:00:00"), (2, "http://bad.org", "2024-01-11 00:00:00")], "page_id bigint, url string, t string").select("page_id", "url", F.col("t").cast(make.split()[1]).alias("fetched"))
    assert [r["blocked"] for r in urls.judge_captures(caps, log).orderBy("page_id").collect()] == [make != "fetched date", True]


NAMES = ["__id", "__h", "__k", "__r", "__n", "__t", "__rank", "__c", "__i", "__p", "__host", "__rate", "__kept", "__q_n_words", "__hk", "__jk", "__ck", "__hv", "__cuts", "__base_failed", "___", "a.b", "A b`c", "id", "key", "n", "size", "host", "bad", "component_id"]


@pytest.mark.parametrize("stage", [quality.keep_good, neardup.drop_near_duplicates, suffixes.cut_repeats, mixing.keep_mix])
def test_any_extra_column_comes_through(spark, stage):
    long = " ".join(f"v{i}" for i in range(80))
    rows = [(1, f"{GOOD} a", "s"), (2, f"{GOOD} a", "s"), (3, long, "t"), (4, "short", None), (None, f"{long} {GOOD}", "s"), (1, f"{GOOD} a", "s")]
    table = spark.createDataFrame([(i, t, s, *range(len(NAMES))) for i, t, s in rows], ["doc_id", "text", "source", *NAMES])
    got = stage(table)
    assert got.columns == table.columns
    out = got.collect()
    assert out and all(tuple(r)[3:] == tuple(range(len(NAMES))) for r in out)
    assert all(t.columns == table.columns and t.count() == 0 for t in [stage(table.limit(0))])


def test_bpe(spark):
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = bpe.encoding(ranks, pattern)[0]
    long = "don't  stop\n\n  x " * 20_000
    for t in (None, "", "a  b", "<|endoftext|>", " \n\n ", "é漢🙂", long, "x" * 150_000, "  " * 90_000):
        ids = bpe.encode_text(t, ranks, pattern)
        assert ids == enc.encode_ordinary(t or "") and bpe.decode_ids(ids, ranks, pattern) == (t or "").encode()
    assert "".join(bpe.pieces(long, 1000)) == long and len(list(bpe.pieces(long, 1000))) > 100
    table = docs(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, None, None)]).withColumn("ids", F.lit(1))
    got = bpe.decode(bpe.encode(table, ranks, pattern), ranks, pattern).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["bytes"])) for r in got) == [(0, b""), (1, b"a b"), (1, b"a b")]
    assert bpe.round_trip(table.limit(0), ranks, pattern).count() == 0


def test_bpe_splits_agree():
    """Short bounds, so that every run of white space and every boundary is cut: still the library's own answer."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc, r = bpe.encoding(ranks, pattern)[0], random.Random(1)
    signs = [" ", " ", " ", "\n", "\t", "\xa0", "\x1c", "\u3000", "\x85", "a", "B", "1", "!", "'s", "é", "漢"]
    for _ in range(2000):
        t = "".join(r.choices(signs, k=r.randint(0, 60)))
        want = enc.encode_ordinary(t)
        assert bpe.encode_text(t, ranks, pattern, run=r.randint(1, 5)) == want and [x for p in bpe.pieces(t, 3) for x in enc.encode_ordinary(p)] == want
    for t in (" " * 200_000 + "a", "a" + "\n" * 200_000):
        assert bpe.encode_text(t, ranks, pattern) == enc.encode_ordinary(t)
    assert bpe.splits(pattern) and not bpe.splits(r"\s?\p{L}+|\s+(?!\S)|\s+") and not bpe.splits(r"\w+|\s+")


@pytest.mark.parametrize("t", [" " * 1_000_000 + "a", "\n" * 1_000_000 + "a", "a" + " \t" * 600_000, " " * 2_000_000])
def test_bpe_very_long_runs(t):
    """The library's own regular expression ends the process on these. What it would match: the run without its last character, then that
    with what follows; a run at the end as a whole."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = bpe.encoding(ranks, pattern)[0]
    run = re.search(r"\s+", t)
    cut = run.end() - (run.end() < len(t))
    ids = bpe.encode_text(t, ranks, pattern)
    assert ids == enc.encode_ordinary(t[: run.start()]) + enc._encode_single_piece(t[run.start() : cut]) + enc.encode_ordinary(t[cut:])
    assert bpe.decode_ids(ids, ranks, pattern) == t.encode()


def test_bpe_query(spark):
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)[0]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op10_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r["doc_id"]].encode()))
