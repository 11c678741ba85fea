"""Names found in one pass over the texts against the equi-join of all n-grams."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom.functions import names as N
from spanloom.functions import text as T
from spanloom.operators import drugs, rules

WORDS = ["Amoxicillin", "amoxicillin", "ACID", "clavulanic", "Äspirin", "́́", "glucose", "Glucose", "insulin", "500", "500mg", "mg", "%", "10%", "40", "mg/", "/ml", "uống", "(Furosemid)", "Đường", "x", "5,5", "g", "١٢", "mcg.", "và", "K", "ﬁbrin", "ẞ", "[Zinc],", "-", "ống"]
SPACES = [" ", " ", " ", "  ", "\t", "\n", " ", " "]
NAMES = ["amoxicillin", "amoxicillin clavulanic acid", "Äspirin", "glucose", "insulin", "đường", "acid", "furosemid", "zinc", "clavulanic   acid 500", "ABCDe", None, "", "x", "water"]


def texts(seed, n):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice(WORDS) + r.choice(SPACES) for _ in range(r.randint(0, 25)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "glucose"), (n + 4, " glucose 5%"), (n + 5, "Lạ 500 mg")]


def both(monkeypatch, ask):
    got = sorted(map(tuple, ask().collect()))
    with monkeypatch.context() as m:
        m.setattr(N, "MOST_NAMES", 0)
        want = sorted(map(tuple, ask().collect()))
    assert got == want
    return got


def test_longest_names_by_either_way(spark, monkeypatch):
    docs = spark.createDataFrame(texts(1, 300), "doc_id bigint, text string").repartition(3)
    names = spark.createDataFrame([(n,) for n in [*NAMES, "Glucose insulin", "uống và"]], "name string")
    got = both(monkeypatch, lambda: rules.names_longest(docs, names))
    said = dict(texts(1, 300))
    assert len(got) > 500 and all(said[d][a:b] == t for d, t, a, b, _ in got)
    assert rules.names_longest(docs, names.filter("false")).count() == 0 and rules.names_longest(docs.filter("false"), names).count() == 0


@pytest.mark.parametrize("seed", [2, 3])
def test_drugs_by_either_way(spark, monkeypatch, seed):
    docs = spark.createDataFrame(texts(seed, 400), "doc_id bigint, text string").repartition(3)
    names = drugs.dictionary(spark.createDataFrame([(n,) for n in NAMES], "name string"))
    got = both(monkeypatch, lambda: drugs.find(docs, names))
    said = dict(texts(seed, 400))
    assert {r[5] for r in got} == {"dict", "rule_strength"} and all(said[d][a:b] == t for d, t, a, b, _, _ in got)


def test_forms_of_words_are_those_of_columns(spark):
    r = random.Random(5)
    some = ["".join(r.choices("aÄéḗđĐİıſßẞΣσς́̂ͅﬁǅ𝔄k1.-", k=r.randint(1, 6))) for _ in range(500)]
    rows = spark.createDataFrame([(s,) for s in some], "t string").select("t", T.plain_form(F.col("t")).alias("p"), T.key_form(F.col("t")).alias("k")).collect()
    assert [(N.plain_word(x.t), N.key_word(x.t)) for x in rows] == [(x.p, x.k) for x in rows]


def test_names_whose_first_hashes_agree():
    held = N.Lexicon(["a b", "c"])
    held.a = held.a[[0, 0, 0]]
    held.b = held.b[[0, 1, 1]] + [0, 0, 1]
    import numpy as np

    a = np.array([held.a[0]] * 4, np.uint64)
    assert held.holds(a, np.array([held.b[0], held.b[1], held.b[2], 7], np.uint64)).tolist() == [True, True, True, False]
    assert N.Lexicon([]).holds(a, a).tolist() == [False] * 4


def test_one_long_text_with_many_names(spark):
    text = " ".join(["amoxicillin acid 500 mg glucose"] * 100_000)
    begun = time.time()
    got = drugs.find(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([("amoxicillin acid",), ("acid",), ("glucose",)], "name string")).count()
    assert got == 100_000 and time.time() - begun < 60


def test_conll_by_splits(spark, tmp_path):
    from spanloom.sources import tables

    r, want = random.Random(3), []
    for f in range(3):
        lines, sentence, mine = [], [], []
        for _ in range(400):
            kind = r.random()
            if kind < 0.2:
                lines.append(r.choice(["", "  "]))
                mine, sentence = ([*mine, sentence] if sentence else mine), []
            elif kind < 0.25:
                lines.append("alone")
            else:
                token, label = r.choice(["đau", "ho", "x"]), r.choice(["O", "B-A"])
                lines.append(token + r.choice([" ", "\t", " mid "]) + label + r.choice(["", "\r", " "]))
                sentence.append((token, label))
        mine = [*mine, sentence] if sentence else mine
        (tmp_path / f"{f}.conll").write_bytes("\n".join(lines).encode() + (b"\n" if f else b""))
        want += [(f"{f}.conll", i, tuple(s)) for i, s in enumerate(mine, 1)]
    for size in ("64", "700", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = tables.read_conll(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted((x.file, x.sentence, tuple(zip(x.tokens, x.labels, strict=True))) for x in got) == sorted(want)


def test_segments_against_all_paths():
    from spanloom.operators import segmenter

    r = random.Random(8)
    for _ in range(400):
        said = r.choices("abc", k=r.randint(0, 8))
        weight = {" ".join(r.choices("abc", k=r.randint(1, 3))): r.randint(-5, 9) for _ in range(6)}
        paths = [[]]
        for _ in said:
            paths = [p for p in paths if sum(p) == len(said)] + [[*p, k] for p in paths if sum(p) < len(said) for k in (1, 2, 3) if sum(p) + k <= len(said) and (k == 1 or " ".join(said[sum(p) : sum(p) + k]) in weight)]
        value = lambda p, said=said, weight=weight: sum(weight.get(" ".join(said[sum(p[:j]) : sum(p[: j + 1])]), -3) for j in range(len(p)))
        assert segmenter.best_words(said, weight, 3, -3) == max(paths, key=lambda p: (value(p), p))


def test_segmented_texts(spark):
    from spanloom.operators import segmenter

    rows = [(1, "Bệnh  nhân đau-đầu, ĐAU bụng"), (2, None), (3, ""), (4, "xa_y"), (5, "bệnh nhân")]
    words = spark.createDataFrame([("bệnh nhân", 50), ("đau bụng", 40), ("Bệnh", 1), ("bụng", 3), (None, 1), ("đau", None)], "word string, weight int")
    got = {x.doc_id: ([(w.word, w.start, w.end) for w in x.words], x.whole) for x in segmenter.segmented(spark.createDataFrame(rows, "doc_id bigint, text string"), words).collect()}
    assert got[1] == ([("Bệnh_nhân", 0, 10), ("đau", 11, 14), ("-", 14, 15), ("đầu", 15, 18), (",", 18, 19), ("ĐAU_bụng", 20, 28)], True)
    assert got[2] == got[3] == ([], True) and got[4][1] is False and len(got) == 5
    with pytest.MonkeyPatch.context() as m:
        m.setattr(segmenter, "MOST_WORDS", 2)
        with pytest.raises(ValueError):
            segmenter.segmented(spark.createDataFrame(rows, "doc_id bigint, text string"), words)


def test_models_are_asked_in_batches(spark):
    import numpy as np

    from spanloom.operators import models

    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"p{i}") for i in range(50)], "id bigint, prompt string").repartition(3)

    def factory():
        def model(some):
            assert 0 < len(some) <= 4
            return [x + "!" for x in some]

        return model

    got = {r.id: r.reply for r in models.replied(rows, factory, batch=4).collect()}
    assert got == {i: None if i % 7 == 0 else f"p{i}!" for i in range(50)}
    done = models.replied(rows.filter("id < 20"), factory, batch=4)
    assert {r.id for r in models.unasked(rows, done, "id").collect()} == {0, 7, 14, *range(20, 50)}
    with pytest.raises(Exception, match="answers"):
        models.replied(rows, lambda: lambda some: some[1:]).collect()
    texts = spark.createDataFrame([(1, "a bb"), (2, ""), (3, None), (4, "zero")], "id bigint, text string")
    vectors = {r.id: r.vector for r in models.embedded(texts, lambda: lambda some: [np.zeros((1, 2)) if t == "zero" else np.array([[len(w), 4.0] for w in t.split()]).reshape(-1, 2) for t in some]).collect()}
    assert vectors[2] is vectors[3] is vectors[4] is None and vectors[1] == pytest.approx([1.5 / 18.25**0.5, 4 / 18.25**0.5])
