import random
import zlib

import numpy as np
from fixtures import edge_documents, edge_rows, empty_documents

from pyspark.sql import functions as F
from spendlens.llm import toxicity
from spendlens.llm.storage import prepared
from spendlens.llm.toxicity import FIXED, LabelModel, Marks, learn, pattern_of, scored, votes_of

SYLLABLES = ["ba", "ko", "re", "mi", "tu", "san", "vel", "dor", "ip", "ne"]


def corpus(seed, number, bad):
    """(doc_id, text, toxic): texts of random words; toxic ones hold some of the bad words."""
    random.seed(seed)
    out = []
    for i in range(number):
        words = ["".join(random.choices(SYLLABLES, k=random.randrange(1, 4))) for _ in range(random.randrange(5, 120))]
        toxic = random.random() < 0.12
        if toxic:
            for _ in range(random.randrange(2, 6)):
                words.insert(random.randrange(len(words) + 1), random.choice(bad))
        out.append((i, " ".join(words), int(toxic)))
    return out


def tables(spark, rows):
    spark = prepared(spark)
    documents = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i % 3], "doc_id long, toxic int")
    return documents, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def quality(spark, rows):
    documents, labels = tables(spark, rows)
    keep = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    model = learn(documents.where(keep), labels.where(keep))
    got = {r.doc_id: r.score for r in scored(documents, model).collect()}
    assert set(got) == {i for i, _, _ in rows} and all(0 <= s <= 1 for s in got.values())
    mine = [(got[i] >= 0.3, bool(x)) for i, _, x in rows if held_out(i)]
    hits = sum(a and b for a, b in mine)
    return hits / max(1, sum(b for _, b in mine)), hits / max(1, sum(a for a, _ in mine)), model


def test_words_that_no_lexicon_has_are_learned_from_labels(spark):
    recall, precision, model = quality(spark, corpus(1, 1200, ["grobulus", "schnarfel", "grobuline", "schnarfing", "zzuq"]))
    assert recall > 0.95 and precision > 0.95
    names = [model.features[i] for i, _ in model.voters]
    assert "zzuq" in names and any(n.startswith("grob") for n in names)


def test_lexicons_do_without_labels(spark):
    rows = corpus(2, 600, ["idiot", "scum", "worthless"])
    documents, labels = tables(spark, rows)
    model = learn(documents, labels.limit(0))
    got = {r.doc_id: r.score for r in scored(documents, model).collect()}
    hits = [(got[i] >= 0.3) == bool(x) for i, _, x in rows]
    assert sum(hits) > 0.97 * len(hits)


def test_scores_read_texts_alone_and_repeat(spark):
    rows = corpus(3, 400, ["grobulus", "schnarfel"])
    documents, labels = tables(spark, rows)
    first, second = learn(documents, labels), learn(documents.repartition(7), labels.repartition(3))
    assert first.features == second.features and np.array_equal(first.weights, second.weights)
    text = "ba grobulus ko"
    table = spark.createDataFrame([(1, text, "a"), (None, text, "b"), (2, "", "c"), (3, None, "d")], "doc_id long, text string, score string")
    got = [r.score for r in scored(table, first).collect()]
    assert got[0] == got[1] > got[2] == got[3]


def test_edge_cases(spark):
    documents = edge_documents(spark)
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 1), (4, 0), (11, 0), (12, 0), (99, 1), (5, 7)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        model = learn(documents, own)
        found = scored(documents, model)
        assert found.count() == len(edge_rows()) and set(found.columns) == set(documents.columns)
        assert all(0 <= r.score <= 1 for r in found.collect())
    assert scored(empty_documents(spark), learn(documents, labels)).count() == 0
    model = learn(empty_documents(spark), labels)
    assert all(0 <= r.score <= 1 for r in scored(documents, model).collect())


def test_label_model_equals_a_plain_posterior():
    toxic, clean, share = [0.6, 0.3, 0.2], [0.1, 0.2, 0.9], [1.0, 0.5, 1.0]
    model = LabelModel(0.2, *map(np.array, (toxic, clean, share)))
    for pattern in range(4):
        fired = [j for j in range(2) if pattern >> j & 1] or [2]
        odds = 0.2 / 0.8 * np.prod([(toxic[j] / clean[j]) ** share[j] for j in fired])
        assert abs(model.posterior(votes_of(np.array([pattern]), 2))[0] - odds / (1 + odds)) < 1e-12


def test_voters_that_repeat_each_other_share_their_weight():
    rng = np.random.default_rng(5)
    y = rng.random(20_000) < 0.2
    one = np.where(y, rng.random(len(y)) < 0.7, rng.random(len(y)) < 0.05)
    two = np.where(y, rng.random(len(y)) < 0.5, rng.random(len(y)) < 0.1)
    votes = np.stack([one, one, one, two], axis=1).astype(float)
    model = LabelModel.fitted(votes[y].T @ votes[y], votes[~y].T @ votes[~y], y.sum(), (~y).sum())
    assert np.allclose(model.share[:3], 1 / 3, atol=0.02) and model.share[3] > 0.95
    assert abs(model.toxic[0] - 0.7) < 0.03 and abs(model.clean[3] - 0.1) < 0.01 and abs(model.prior - 0.2) < 0.01


def test_expected_counts_equal_a_plain_sum(spark):
    rng = np.random.default_rng(6)
    several = 5
    keys = rng.integers(0, 1 << several, 40)
    table = spark.createDataFrame([(int(k), int(n), 1) for k, n in zip(keys, rng.integers(1, 9, 40))], "pattern long, n long, rows long")
    model = LabelModel(0.3, rng.random(several + 1), rng.random(several + 1), np.ones(several + 1))
    toxic, every, n_toxic, n, rows = toxicity._expected(table, model, several)
    votes = votes_of(np.array([r.pattern for r in table.collect()]), several)
    weight, p = np.array([r.n for r in table.collect()], float), model.posterior(votes)
    assert np.allclose(toxic, (votes * (weight * p)[:, None]).T @ votes, atol=0.01) and np.allclose(every, (votes * weight[:, None]).T @ votes)
    assert abs(n_toxic - (weight * p).sum()) < 0.01 and n == weight.sum() and rows.sum() == 40


def test_linear_weights_are_at_the_optimum():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.random((200, 3)) < 0.5, np.ones((200, 1))], axis=1).astype(float)
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ [3, -2, 0, 0.5])))).astype(float)
    w = toxicity._newton(*np.nonzero(x), y, np.ones(200), 4, 0.3)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - y) + np.array([0.3, 0.3, 0.3, 0]) * w).max() < 1e-4


def test_marks():
    marks = Marks(["zzuq", "gro*"])
    levels, bits = marks.of("Zzuq grobulus GROB gro " + "grobo " * 8 + "re " * 1012)
    assert levels == {0: 1, 1: 3} and bits == 0
    levels, bits = marks.of("You IDIOT!!! sh**t nooooo")
    assert levels == {} and bits == 0b1111011  # English, German and French have the word
    assert pattern_of({0: 2}, 1, [(0, 2), (0, 3), (1, 1)]) == 1 | 1 << FIXED
