import numpy as np
from fixtures import edge_documents, edge_rows, empty_documents, pairs
from pyspark.sql import functions as F

from spendlens.llm.language_id import Profiles, _Letters, identify, learn, rows_of_each
from spendlens.llm.queries import op4_language_id
from spendlens.llm.storage import prepared


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = op4_language_id(spark, sf).join(lang, "doc_id").where("held_out")
    right, total = held.agg(F.sum(F.expr("int(lang = lang_pred)")), F.count("*")).first()
    assert total > 250 and right >= 0.98 * total


def test_edge_cases(spark):
    prepared(spark)
    profiles = learn(spark.createDataFrame(
        [("the and of the word and", "en"), ("la langue et les mots", "fr"), (None, "de"), ("x", None)], "text string, lang string"))
    assert profiles.languages == ["en", "fr"]
    found = identify(edge_documents(spark), profiles)
    assert found.count() == len(edge_rows())
    for row in found.collect():
        assert 0 <= row.score <= 1
        assert (row.lang_pred == "und") == (not any(c.isalpha() for c in row.text or ""))
    assert dict(pairs(found, "doc_id", "lang_pred"))[18] == "fr"


def plain_predictions(labelled, texts, dimensions, n):
    """Languages and scores by loops: trigram vectors summed by language, mean of the unit sums taken off, cosines."""
    letters = _Letters(dimensions, n)

    def vector(code):
        return letters._letter(code).astype(float)

    def bundle(text):
        out = np.zeros(dimensions)
        codes = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()]
        codes = [c for i, c in enumerate([0, *codes, 0]) if c or not i or [0, *codes, 0][i - 1]]
        for at in range(len(codes) - n + 1):
            if any(codes[at : at + n]):
                gram = np.ones(dimensions)
                for place in range(n):
                    gram *= np.roll(vector(codes[at + place]), n - 1 - place)
                out += gram
        return out

    def unit(v):
        norm = sum(x * x for x in v) ** 0.5
        return v / norm if norm else v

    names = sorted({lang for _, lang in labelled})
    sums = [unit(sum(bundle(text) for text, lang in labelled if lang == name)) for name in names]
    mean = sum(sums) / len(sums)
    prototypes = [unit(s - mean) for s in sums]
    out = []
    for text in texts:
        rest = unit(unit(bundle(text)) - mean)
        cosines = [float(rest @ p) for p in prototypes]
        best = cosines.index(max(cosines))
        out.append((names[best], min(1.0, max(0.0, cosines[best]))) if any(c.isalpha() for c in text or "") else ("und", 0.0))
    return out


def test_prototypes_and_cosines_equal_a_plain_version(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null and lang is not null").select(
        "text", "lang").orderBy("doc_id").limit(40).collect()
    labelled = [(r.text[:300], r.lang) for r in rows] + [("Straße über Öl", "de"), ("l'été, déjà vu", "fr")]
    texts = [r.text[300:600] for r in rows] + ["über l'été", "", "12 34", None, "a", "x--y  z"]
    profiles = learn(prepared(spark).createDataFrame(labelled, "text string, lang string").repartition(3), dimensions=256)
    langs, scores = profiles.predict(texts)
    for (lang, score), got, value in zip(plain_predictions(labelled, texts, 256, 3), langs, scores):
        assert abs(score - value) < 1e-4 and (got == lang or score < 1e-4)


def test_the_sample_does_not_depend_on_files_and_copies(spark):
    rows = [(f"the and of the word and {n}", "en") for n in range(2000)] + [(f"la langue et les mots {n}", "fr") for n in range(2000)]
    table = prepared(spark).createDataFrame(rows, "text string, lang string")
    copies = table.where("text like '%7'").selectExpr("text", "lang", "explode(sequence(1, 20))").select("text", "lang")
    found = [learn(t, sample_rows=100) for t in (table.repartition(2), table.repartition(7), table.union(copies))]
    assert all((f.prototypes == found[0].prototypes).all() for f in found)


def test_rare_languages_are_learned_from_a_bounded_sample(spark):
    rows = [(f"the and of the word and {n}", "en") for n in range(3000)] + [("la langue et les mots", "fr"), ("der und die das", "de")]
    profiles = learn(prepared(spark).createDataFrame(rows, "text string, lang string"), sample_rows=30)
    assert profiles.languages == ["de", "en", "fr"]
    assert profiles.predict(["les mots et la langue", "und das die der"])[0] == ["fr", "de"]
    assert [rows_of_each(c, 30) for c in ([3000, 1, 1], [5, 5], [3000, 3000, 3000], [9] * 100, [])] == [28, 5, 10, 1, 1]


def test_nothing_learned_and_no_documents(spark):
    profiles = learn(spark.createDataFrame([], "text string, lang string"))
    assert profiles.languages == []
    assert {r.lang_pred for r in identify(edge_documents(spark), profiles).collect()} == {"und"}
    assert identify(empty_documents(spark), profiles).count() == 0


def test_ngrams_are_bound_and_bundled():
    letters = _Letters(64, 3)
    a, b, c = (letters._letter(ord(x)).astype(int) for x in "abc")
    bundle, has = letters.bundles(["abc", "  ABC!", "", "7"])
    space = letters._letter(0).astype(int)
    grams = [(space, a, b), (a, b, c), (b, c, space)]
    expected = sum(np.roll(x, 2) * np.roll(y, 1) * z for x, y, z in grams)
    assert (bundle[0] == expected).all() and (bundle[1] == expected).all()
    assert has.tolist() == [True, True, False, False]


def test_equal_prototypes_give_a_language_and_a_score():
    langs, scores = Profiles(["a", "b"], np.ones((2, 64)), 64, 3).predict(["text", None])
    assert langs[1] == "und" and scores == [0.0, 0.0]
