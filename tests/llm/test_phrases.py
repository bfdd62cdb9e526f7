import random
import re
from collections import Counter

import numpy as np
from fixtures import FOLD, edge_documents, edge_rows, empty_documents, pairs

from spendlens.llm.phrases import Summary, combined, mined_phrases


def plain(rows, min_count=30, most=4, covered=80, first=2000):
    """The same by counting every phrase."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = (text or "").encode().translate(FOLD).decode()
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", folded):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for n in range(1, most + 1):
                own.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        kept, inside = [], {}
        for phrase, a in own.items():
            words = phrase.split(" ")
            if a < min_count or len(words) < 2:
                continue
            for n in range(2, len(words)):
                for s in range(len(words) - n + 1):
                    part = " ".join(words[s : s + n])
                    inside[part] = max(inside.get(part, 0), a)
            score, _, left, right = min(
                (2_000_000 * a // (own[" ".join(words[:k])] + own[" ".join(words[k:])]), k, own[" ".join(words[:k])], own[" ".join(words[k:])])
                for k in range(1, len(words)))
            kept.append((-score, -a, phrase.encode(), left, right))
        kept = sorted(x for x in kept if 100 * inside.get(x[2].decode(), 0) < -covered * x[1])[:first]
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s) for rank, (s, a, p, left, right) in enumerate(kept, 1)]
    return sorted(out, key=repr)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def check(spark, rows, **options):
    table = spark.createDataFrame([(t, x, 0, "z") for x, t in rows], "text string, lang string, n long, phrase string").repartition(4)
    got = pairs(mined_phrases(table, **options), *COLUMNS)
    assert got == plain(rows, **{{"most_words": "most"}.get(k, k): v for k, v in options.items() if k != "filter_bits"})
    return got


def texts(seed, number, vocabulary, longest):
    random.seed(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["New York", "état civil", "Ünder\xa0way", "the"]
    return [
        (random.choice(["en", "fr", None]), "".join(random.choice(words) + random.choice([" ", " ", " ", "\t", ". ", "\n", ",", "  "])
                                                     for _ in range(random.randrange(longest))))
        for _ in range(number)
    ]


def test_equals_counting_every_phrase(spark):
    found = check(spark, texts(1, 60, 12, 400), min_count=5)
    assert len(found) > 100 and {x[0] for x in found} == {"en", "fr", "und"}
    check(spark, texts(2, 40, 6, 300), min_count=3, most_words=3, covered=50, first=7)
    check(spark, texts(3, 40, 200, 300), min_count=2)


def test_small_bit_maps_change_nothing(spark):
    check(spark, texts(4, 40, 60, 300), min_count=3, filter_bits=10)


def test_edge_cases(spark):
    rows = [(r[2], r[1]) for r in edge_rows()]
    table = edge_documents(spark)
    assert pairs(mined_phrases(table, min_count=2), *COLUMNS) == plain(rows, min_count=2)
    assert mined_phrases(empty_documents(spark)).count() == 0
    assert mined_phrases(table, min_count=10**6).columns == list(COLUMNS)
    assert mined_phrases(table, min_count=10**6).count() == 0


def test_ties_of_cuts_and_ranks(spark):
    check(spark, [("en", "a b a b a b a b a b")] * 3 + [("en", "x y. x y. y x. y x")] * 2, min_count=2)


def test_what_is_frequent_survives_any_order_of_merging():
    rng = np.random.default_rng(3)
    for _ in range(30):
        stream = np.minimum(rng.zipf(1.3, 3000), 2000).astype(np.uint32)
        least = int(rng.integers(5, 40))
        summary = Summary(len(stream) // least + 1)
        for part in np.array_split(stream, int(rng.integers(1, 40))):
            summary.merge(*combined(part, np.ones(len(part), np.int64)))
        values, counts = np.unique(stream, return_counts=True)
        assert set(values[counts >= least]) <= set(summary.possible(least)) and summary.lost < least
        assert len(summary.hashes) <= summary.capacity
        kept = dict(zip(summary.hashes.tolist(), summary.counts.tolist()))
        assert all(c - summary.lost <= kept.get(v, 0) <= c for v, c in zip(values.tolist(), counts.tolist()))
