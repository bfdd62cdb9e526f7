import re

from fixtures import FOLD, edge_documents, edge_rows, empty_documents, pairs

from spendlens.llm.decontamination import decontaminate
from spendlens.llm.storage import prepared

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, "The same words again and again in one text. The same words again"), (2, "is shared BY many documents"), (3, "word " * 12),
    (4, None), (5, "..."), (6, "one"), (7, "日本語のテキスト"), (7, "one"), (8, "of the text and and and it was not found at all anywhere"), (None, "Erreur de"),
]


def words(text):
    return WORD.findall((text or "").encode().translate(FOLD).decode())


def plain(rows, items, size=10):
    windows = {}
    for item, text in items:
        found = words(text)
        for n in range(max(1, len(found) - size + 1) if found else 0):
            windows.setdefault(tuple(found[n : n + size]), set()).add("null" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        found, hit, names = words(text), set(), set()
        for length in lengths:
            for n in range(len(found) - length + 1):
                if (w := tuple(found[n : n + length])) in windows:
                    hit |= set(range(n, n + length))
                    names |= windows[w]
        out.append((doc, len(found), len(hit), sorted(names)))
    return sorted(out, key=repr)


def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_edge_cases_in_one_block_and_in_several(spark):
    prepared(spark)
    for size in (1 << 20, 100):
        found = decontaminate(edge_documents(spark), benchmark(spark), block_bytes=size)
        assert set(found.columns) == set(edge_documents(spark).columns)
        got = found.selectExpr("doc_id", "contamination.*")
        assert pairs(got, "doc_id", "n_words", "n_hit", "items") == plain([r[:2] for r in edge_rows()], ITEMS)


def test_spans_are_places_in_the_original(spark):
    text = "ÄÖ — Is SHARED,  by 'many' documents! Then ONE."
    found = decontaminate(spark.createDataFrame([(text,)], "text string"), benchmark(spark)).first().contamination
    assert [text[s.start : s.end] for s in found.spans] == ["Is SHARED,  by 'many' documents", "ONE"]


def test_nothing_to_look_for_or_in(spark):
    assert decontaminate(empty_documents(spark), benchmark(spark)).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contamination.n_hit for r in decontaminate(edge_documents(spark), none).collect()} == {0}
