import random
from collections import Counter

from fixtures import edge_documents, edge_rows, empty_documents, pairs
from tokenizers import Tokenizer

from spendlens.llm.encoding import public_path
from spendlens.llm.token_counts import _reduced, frequent_pieces, token_counts

PATH = public_path("byte_bpe_50k.json")


def test_edge_cases(spark):
    tokenizer = Tokenizer.from_file(PATH)
    found = token_counts(edge_documents(spark), PATH, limit=20)
    expected = []
    for doc, text, *_ in edge_rows():
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc, len((text or "").encode()), n, n > 20))
    assert pairs(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(expected, key=repr)
    assert set(edge_documents(spark).columns) < set(found.columns)


def test_frequent_pieces_are_few_and_right(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = spark.createDataFrame([("a b b b longword c c",)] * 5, "text string")
    found = frequent_pieces(texts, PATH, size=2)
    assert set(found) == {"b", "c"}
    assert all(n == len(tokenizer.encode(" " + p, add_special_tokens=False).ids) for p, n in found.items())


def test_reduced_counts_lose_a_bounded_share():
    rnd = random.Random(3)
    pieces = [str(int(rnd.paretovariate(0.7))) for _ in range(20_000)]
    found, size = Counter(), 50
    for start in range(0, len(pieces), 100):
        found.update(pieces[start : start + 100])
        if len(found) > 2 * size:
            found = _reduced(found, size)
            assert len(found) <= size
    for piece, n in Counter(pieces).items():
        assert n - len(pieces) / (size + 1) <= found[piece] <= n


def test_frequent_pieces_come_from_all_texts(spark):
    """A piece that only one of many partitions has often is in the table, one that is too long is not."""
    rows = [(f"x p{n % 7}",) for n in range(2000)] + [("x late late late " + "y" * 40,)] * 50
    found = frequent_pieces(spark.createDataFrame(rows, "text string").repartition(8), PATH)
    assert set(found) == {"late", *(f"p{n}" for n in range(7))}


def test_no_documents(spark):
    assert token_counts(empty_documents(spark), PATH).count() == 0
