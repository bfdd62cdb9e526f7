import random

import pytest
from fixtures import edge_documents, edge_rows, empty_documents, near_components, pairs

from spendlens.llm.components import components
from spendlens.llm.near_dedup import least_matches, near_duplicates
from spendlens.llm.storage import prepared


def compared(spark, documents, rows, threshold, words):
    prepared(spark)
    found = near_duplicates(documents, threshold=threshold, words=words)
    expected = sorted(
        ((doc, n, component, doc == component) for (doc, _), (n, component) in zip(rows, near_components(rows, words, threshold))), key=repr)
    assert pairs(found, "doc_id", "n_shingles", "component_id", "kept") == expected


@pytest.mark.parametrize("threshold,words", [(0.85, 3), (0.8, 5)])
def test_edge_cases(spark, threshold, words):
    compared(spark, edge_documents(spark), [r[:2] for r in edge_rows()], threshold, words)


def test_groups_of_near_copies(spark):
    """A base, copies with many edits, chains of copies of copies, and a passage that all share."""
    rnd = random.Random(9)
    words = [f"w{n}" for n in range(400)]
    rows = []
    for group in range(4):
        base = [rnd.choice(words) for _ in range(120)]
        for copy in range(40):
            text = list(base)
            for _ in range(rnd.randint(0, 9)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            if copy % 10 == 9:
                base = text
            rows.append((len(rows), " ".join(text)))
    passage = " ".join(words[:60])
    rows += [(1000 + n, f"{passage} " + " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 80)))) for n in range(40)]
    rows += [(2000 + n, "exactly the same short text here") for n in range(50)]
    compared(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, 0.85, 3)


def test_no_documents(spark):
    assert near_duplicates(empty_documents(spark)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(n, n + 1) for n in range(40)] + [(1000, 1000 + n) for n in range(1, 60)] + [(5000, 4000), (4000, 5000)]
    found = dict(pairs(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert found == {**{n: 0 for n in range(41)}, **{1000 + n: 1000 for n in range(60)}, 4000: 4000, 5000: 4000}


def test_matches_leave_next_to_no_chance_to_miss():
    assert least_matches(0.85, 32) == 12
    assert least_matches(0.8, 32) == 10
    assert least_matches(1.0, 32) == 32


def test_components_of_random_graphs(spark):
    rnd = random.Random(12)
    edges = [(g * 1000 + rnd.randrange(30), g * 1000 + rnd.randrange(30)) for g in range(20) for _ in range(rnd.randint(1, 40))]
    least = {}
    parent = {n: n for e in edges for n in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert dict(pairs(components(spark.createDataFrame(edges, "a long, b long")), "node", "component")) == least
