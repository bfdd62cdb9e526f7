import re
from collections import defaultdict

from fixtures import FOLD, edge_documents, edge_rows, empty_documents, pairs

from spendlens.llm.line_dedup import line_dedup
from spendlens.llm.queries import op8_line_dedup


def plain(rows, min_documents=5, min_length=40):
    """(id, text, lines, dropped) of each row."""
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).encode().translate(FOLD).decode()

    held = defaultdict(list)
    for doc, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            held[k].append(doc)
    out = []
    for doc, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            k = key(line)
            ids = [i for i in held[k] if i is not None]
            if len(k) < min_length or len(held[k]) < min_documents or doc == (max(ids) if ids else None):
                kept.append(line)
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_edge_cases(spark):
    rows = [r[:2] for r in edge_rows()]
    found = line_dedup(edge_documents(spark))
    assert pairs(found, "doc_id", "text", "n_lines", "n_dropped") == plain(rows)
    assert sum(r[3] for r in plain(rows)) > 4
    assert set(found.columns) == {*edge_documents(spark).columns, "n_dropped"}


def test_lower_bounds_than_the_usual(spark):
    rows = [(n, f"Line {n % 3}\n\nend") for n in range(12)]
    found = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_documents=3, min_length=1)
    assert pairs(found, "doc_id", "text", "n_lines", "n_dropped") == plain(rows, 3, 1)


def test_no_documents(spark):
    assert line_dedup(empty_documents(spark)).count() == 0


def test_plan_has_no_python(spark):
    plan = op8_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "MapIn"))
