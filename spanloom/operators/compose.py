"""Labelled documents by construction: sources of terms, blocks of headings and items, prompts and their inputs, retries of failed ones.

Every choice is a hash of a seed and the row's key, and every span's offsets follow from what stands before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import choice, rules
from spanloom.sources.work import spread, work_path

# Fixed values.
NUMBERING = (None, "1.", "1)", "I.", "A.", "Muc 1:", "1 -", "(1)")
BULLETS = ("-", "•", "*", "+", "‣", "·", None, "1.", "a)", "–")
INDENTS = ("", "  ", "    ", "      ", "\t")
COLONS = (":", "", " :", " -", "...")
BLANKS = (0, 1, 2)
CASES = ("lower", "upper", "title")
LAYOUTS = ("bullet", "inline", "numbered")
SKIPPED_CHAPTERS = ("V", "W", "X", "Y", "U", "R")
CHAPTER_QUOTA = {"I": 120, "J": 100, "K": 100, "M": 80, "E": 80, "N": 70, "C": 60, "G": 60, "O": 60, "L": 50, "A": 50, "B": 40, "F": 40, "D": 30, "H": 30, "P": 30, "Q": 30, "S": 30, "T": 30, "Z": 20}
LEAST_QUOTA = 30
MOST_ENTITIES, MOST_TESTS = 14, 5
NEGATIVE_SHARE = 0.6
SPANS = "array<struct<text:string,type:string,start:bigint,end:bigint>>"


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def units() -> list[str]:
    """The units of laboratory values as literals of 1 to 12 characters."""
    return [u for u in rules.UNITS.split("|") if 1 <= len(u) <= 12]


def chapter(code: Column) -> Column:
    return F.when(code == "", "Z").otherwise(F.upper(F.substring(code, 1, 1)))


def diagnoses(terms: DataFrame, seed: int, most_words: int = 6) -> DataFrame:
    """(term, code, chapter, linkable) of a table of codes: terms of ``most_words`` words at most, without the skipped chapters; of each chapter its quota,
    all where it has fewer."""
    rows = terms.select(F.trim("term").alias("term"), F.trim("code").alias("code")).filter("term <> '' and code <> ''")
    rows = rows.filter(n_words(F.col("term")) <= most_words).withColumn("chapter", chapter(F.col("code"))).filter(~F.col("chapter").isin(*SKIPPED_CHAPTERS))
    quotas = F.create_map(*[F.lit(x) for kv in CHAPTER_QUOTA.items() for x in kv])
    quota = F.greatest(F.coalesce(F.try_element_at(quotas, F.col("chapter")), F.lit(LEAST_QUOTA)), F.lit(LEAST_QUOTA))
    asked = rows.select("chapter").distinct().withColumn("quota", quota.cast("bigint"))
    drawn = choice.smallest(rows, asked, ["chapter"], choice.ticket(seed, "code", "term"), "code", "term")
    return drawn.select("term", "code", "chapter", F.lit(True).alias("linkable"))


def chapters(terms: DataFrame) -> DataFrame:
    """One row: distinct chapters and distinct terms."""
    return terms.agg(F.count_distinct("chapter").alias("chapters"), F.count_distinct("term").alias("terms"))


def symptoms(terms: DataFrame, units_: DataFrame) -> DataFrame:
    """(text): symptom terms of chapter R (7 words at most; repeated ones stay) and, once each, bullets of 2 to 8 words with a letter."""
    known = terms.filter(F.startswith("code", F.lit("R"))).select(F.trim("term").alias("text")).filter((F.col("text") != "") & (n_words(F.col("text")) <= 7))
    said = units_.filter("is_bullet").select(T.trimmed(F.struct("text", F.lit(0).alias("start")))["text"].alias("text"))
    said = said.filter(n_words(F.col("text")).between(2, 8) & F.col("text").rlike(r"[A-Za-zÀ-ỹ]")).distinct()
    return known.unionByName(said)


def linked(names: DataFrame, generic: DataFrame) -> DataFrame:
    """(term, linkable): drug names, and generic groups that can't be linked with a code; one spelling (the smallest) of each, a name before a group."""
    rows = names.select("term", F.lit(True).alias("linkable")).unionByName(generic.select("term", F.lit(False).alias("linkable")))
    rows = rows.withColumn("term", F.trim("term")).filter(F.length("term") >= 3)
    best = F.min(F.struct((~F.col("linkable")).alias("late"), "term")).alias("b")
    return rows.groupBy(F.lower("term").alias("__k")).agg(best).select("b.term", (~F.col("b.late")).alias("linkable"))


# ---------------------------------------------------------------------------------------------------------------------
# blocks


def cased(text: Column, case: Column) -> Column:
    return F.when(case == "upper", F.upper(text)).when(case == "title", F.initcap(text)).otherwise(text)


def heading_line(heading: Column, numbering: Column, colon: Column, case: Column) -> Column:
    return F.concat(F.when(numbering.isNotNull(), F.concat(numbering, F.lit(" "))).otherwise(""), cased(heading, case), colon, F.lit("\n"))


def bullet_prefix(bullet: Column, indent: Column) -> Column:
    return F.concat(indent, F.when(bullet.isNotNull(), F.concat(bullet, F.lit(" "))).otherwise(""))


def inline_line(heading: Column, items: Column, separator: str = ", ") -> Column:
    """struct<text, spans>: ``heading: item, item`` on a line, with the items' places."""
    last = F.size(items) - 1
    parts = F.flatten(F.transform(items, lambda x, i: F.array(x, F.when(i < last, separator).otherwise(""))))
    parts = F.concat(F.array(F.concat(heading, F.lit(": "))), parts, F.array(F.lit("\n")))
    places = F.filter(T.placed(parts), lambda p, i: (i % 2 == 1) & (i <= 2 * last + 1))
    spans = F.zip_with(items, places, lambda x, p: F.struct(x.alias("text"), p["start"].alias("start"), p["end"].alias("end")))
    return F.struct(F.array_join(parts, "").alias("text"), spans.alias("spans"))


def blocks(rows: DataFrame, headings: list[str], negative_headings: list[str], negatives: list[str], seed: int, key: str = "id", items: str = "items", sections: int = 3) -> DataFrame:
    """(key, text, spans) of rows with items array<struct<text, type>>: sections of a heading and items in one of three layouts, with bullets, indents,
    numbering, colons, case and blank lines chosen by block. Items are shuffled and dealt over the sections, the last of which takes the rest; most
    blocks end in a section of negative statements, which are no spans. A row without items has at most that."""
    headings_of = _cased_lists(rows.sparkSession, headings, negative_headings)
    src = spread(rows, key).select(F.col(key).alias("k"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("s"), F.col(items).alias("x"))
    types = dict(src.dtypes)
    seeds = [f"{seed + i}:".encode() for i in range(13)]
    choices = [(o, len(o)) for o in (LAYOUTS, CASES, BULLETS, INDENTS, COLONS, BLANKS, NUMBERING)]

    def one(k: str, said: list, places: tuple[list, list]) -> tuple[str, list[int]]:
        """The text of a block with these items, and their order in it; their places are added."""
        raw = k.encode()
        u = lambda i: int.from_bytes(md5(seeds[i] + raw).digest()[:8], "big") >> 4
        more = lambda i, j: int.from_bytes(md5(b"%b%b:%d" % (seeds[i], raw, j)).digest()[:8], "big") >> 4
        layout, case, bullet, indent, colon, blank, numbering = [o[int(u(i) / _SIDES * n)] for i, (o, n) in enumerate(choices, 1)]
        lead = indent + (f"{bullet} " if bullet is not None else "")
        n = len(said)
        order = sorted(range(n), key=[more(0, i) / _SIDES for i in range(n)].__getitem__)
        size = max(1, n // sections)
        parts, at, s = [], 0, -1
        begun, ended = places
        for i, j in enumerate(order):
            before = ""
            if (now := min(i // size, sections - 1)) != s:
                s = now
                before = (f"{numbering} " if i == 0 and numbering is not None else "") + _pick(headings_of[case][0], more(8, s) / _SIDES) + colon + "\n"
            last = i == n - 1 or min((i + 1) // size, sections - 1) != s
            before += lead if layout == "bullet" else f"{indent}{i - s * size + 1}. " if layout == "numbered" else ""
            after = (", " if layout == "inline" and not last else "\n") + ("\n" * blank if last else "")
            word = said[j] or ""
            start = at + len(before)
            at = start + len(word)
            begun.append(start)
            ended.append(at)
            parts += (before, word, after)
            at += len(after)
        if u(12) / _SIDES < NEGATIVE_SHARE:
            denied = sorted(range(len(negatives)), key=lambda i: (more(10, i) / _SIDES, negatives[i]))[: int(u(9) / _SIDES * 4) + 2]
            parts += [_pick(headings_of[case][1], u(11) / _SIDES), colon, "\n", *[f"{lead}{negatives[i]}\n" for i in denied], "\n"]
        return "".join(parts), order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2)
            held = x.flatten()  # the items of all rows, one after another
            said, ends = held.field("text").to_pylist(), pc.fill_null(pc.list_value_length(x), 0).to_numpy().cumsum().tolist()
            texts, begun, ended, taken, a = [], [], [], [], 0
            for k, none, b in zip(batch.column(1).to_pylist(), x.is_null().to_pylist(), ends, strict=True):
                text, order = (None, ()) if none else one(k, said[a:b], (begun, ended))
                texts.append(text)
                taken += [a + j for j in order]
                a = b
            at = pa.array(taken, pa.int64())
            spans = pa.StructArray.from_arrays([held.field("text").take(at), held.field("type").take(at), pa.array(begun, pa.int64()), pa.array(ended, pa.int64())], fields=list(part))
            offsets = pa.array([0, *ends], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.ListArray.from_arrays(offsets, spans, mask=x.is_null())], names=["k", "text", "spans"])

    part = pa.struct([("text", pa.string()), ("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return src.mapInArrow(run, f"k {types['k']}, text string, spans {SPANS}").withColumnRenamed("k", key)


_SIDES = float(1 << 60)


def _share(*parts) -> float:
    """A row's draw as ``generate.draw`` gives it."""
    return int(md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16) / float(1 << 60)


def _pick(options: Sequence, u: float):
    return options[int(u * len(options))]


def _cased_lists(spark: SparkSession, *lists: list[str]) -> dict[str, list[list[str]]]:
    """Lists of headings in each case, by case."""
    one = spark.range(1).select(*[F.array(*[cased(F.lit(h), F.lit(c)) for h in hs]).alias(f"{c}{i}") for c in CASES for i, hs in enumerate(lists)]).first()
    return {c: [one[f"{c}{i}"] for i in range(len(lists))] for c in CASES}


def drawn_blocks(n: DataFrame, pools: DataFrame, seed: int, **words: list[str]) -> DataFrame:
    """Blocks for rows (id), each from one of the pools (items), chosen by hash: pools are dealt into as many buckets as there are, and an empty bucket
    gives a block without items."""
    many = F.broadcast(pools.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("__n")))  # one row
    bucket = lambda k: F.pmod(F.xxhash64(F.lit(seed), k), F.col("__n"))
    dealt = pools.withColumn("__h", F.xxhash64("items")).crossJoin(many).groupBy(bucket("__h").alias("__b")).agg(F.min(F.struct("__h", "items"))["items"].alias("items"))
    rows = n.crossJoin(many).withColumn("__b", bucket("id")).join(dealt, "__b", "left")
    none = F.array().cast(dict(pools.dtypes)["items"])
    return blocks(rows.select("id", F.coalesce("items", none).alias("items")), seed=seed + 1, **words)


def verbatim_only(rows: DataFrame) -> DataFrame:
    """Rows (text, spans) all of whose spans are the text's at their places."""
    right = F.forall("spans", lambda s: F.substr(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")) == s["text"])
    return rows.filter(right)


# ---------------------------------------------------------------------------------------------------------------------
# prompts


def filled(template: str, **values: Column) -> Column:
    """A template with {names} replaced by columns; what a column holds is not looked into. Unknown names fail at once."""
    import string

    out = []
    for literal, name, _, _ in string.Formatter().parse(template):
        out.append(F.lit(literal))
        if name is not None:
            out.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*out)


def as_turn(prompt: Column, before: str = "<|im_start|>user\n", after: str = "<|im_end|>\n<|im_start|>assistant\n", hint: str = "/no_think") -> Column:
    """A prompt as a user's turn of a chat template that the assistant's follows, with a hint at its end that asks for no thinking, unless the prompt has it."""
    turn = F.concat(F.lit(before), prompt, F.lit(after))
    return F.when(F.contains(turn, F.lit(hint)), turn).otherwise(F.concat(turn, F.lit(hint + "\n")))


def article_inputs(rows: DataFrame, tests: list[str], drugs_said: list[str], tests_said: list[str], denials: list[str], families: list[str], histories: list[str], titles: list[str], seed: int, key: str = "id") -> DataFrame:
    """What an article must hold, for scenarios (key, diagnosis, symptoms, drugs): (key, required array<struct<text, type>>, mentioned, context, titles, n_glue, n_mask).

    Required are the diagnosis, the symptoms, the drugs and up to MOST_TESTS tests, shuffled and cut to MOST_ENTITIES; one or two drugs and tests more are
    only mentioned; the context has a denied symptom ({tc}) in 60 % of cases, family and history in 50 % each; titles are four of the list ({d}: the diagnosis).
    """
    src = spread(rows, key).select(F.col(key).alias("k"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("s"), F.col("diagnosis"), F.col("symptoms"), F.col("drugs"))
    item, many = pa.struct([("text", pa.string()), ("type", pa.string())]), pa.list_(pa.string())
    kinds = {"required": pa.list_(item), "mentioned": many, "context": many, "titles": many, "n_glue": pa.int64(), "n_mask": pa.int64()}

    def one(k: str, diagnosis: str | None, symptoms: list | None, drugs: list | None) -> tuple:
        u = lambda i, *more: _share(seed + i, k, *more)
        some = lambda xs, i, n: [xs[j] for j in sorted(range(len(xs)), key=lambda j: (u(i, j), j))[:n]]
        typed = lambda xs, kind: [{"text": x, "type": kind} for x in xs]
        required = None
        if symptoms is not None and drugs is not None:
            own = typed([diagnosis], "CHAN_DOAN") + typed(symptoms, "TRIEU_CHUNG") + typed(drugs, "THUOC") + typed(some(tests, 1, int(u(2) * (MOST_TESTS + 1))), "TEN_XET_NGHIEM")
            required = some(own, 11, MOST_ENTITIES)
        mentioned = some(drugs_said, 12, int(u(13) * 2) + 1) + some(tests_said, 14, int(u(15) * 2) + 1)
        context = []
        if symptoms and u(4) < 0.6 and (symptom := _pick(symptoms, u(3))) is not None:
            context.append(_pick(denials, u(5)).replace("{tc}", symptom))
        context += [_pick(xs, u(i + 1)) for xs, i in ((families, 6), (histories, 8)) if u(i) < 0.5]
        named = [None if diagnosis is None else t.replace("{d}", diagnosis) for t in some(titles, 10, 4)]
        return required, mentioned, context, named, int(u(16) * 4) + 1, int(u(17) * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = zip(*map(one, *[c.to_pylist() for c in batch.columns[1:]]), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(made, kinds.values(), strict=True)]], names=["k", *kinds])

    schema = f"k {src.schema['k'].dataType.simpleString()}, required array<struct<text:string,type:string>>, mentioned array<string>, context array<string>, titles array<string>, n_glue bigint, n_mask bigint"
    return src.mapInArrow(run, schema).withColumnRenamed("k", key)


def with_retries(inputs: DataFrame, generate_: Callable[[DataFrame, float], DataFrame], judge: Callable[[DataFrame], DataFrame], key: str = "id", rounds: int = 3, heat: float = 0.8, step: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejections): what ``generate_(inputs, temperature)`` gives, row for row, is judged (``reason``, null: accepted); only what failed is asked for again, a bit
    hotter each time, for ``rounds`` rounds in all. Rejections are (round, reason, n). Each round is written before the next, so nothing is asked for twice."""
    spark, accepted, rejected, left = inputs.sparkSession, None, None, inputs
    for k in range(rounds):
        path = work_path(spark)
        judge(generate_(left, heat + step * max(0, k - 1))).write.parquet(path)
        done = spark.read.parquet(path)
        good = done.filter("reason is null").withColumn("round", F.lit(k))
        bad = done.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("round"), "reason", "n")
        accepted, rejected = (good, bad) if accepted is None else (accepted.unionByName(good), rejected.unionByName(bad))
        failed = done.filter("reason is not null").select(key)
        if not failed.limit(1).count():
            break
        left = inputs.join(failed, key, "left_semi")
    return accepted.drop("reason"), rejected
