import os
import subprocess
import sys

import corpus_pipeline
from fixtures import edge_documents, edge_rows, empty_documents, near_components
from test_decontamination import plain as plain_contamination
from test_line_dedup import plain as plain_lines
from test_packing import one_by_one
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from spendlens.llm import queries
from spendlens.llm.storage import written

ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in names if name.startswith("op")}
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def brute(spark):
    """The rows of each stage by plain Python."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [r for r in docs if any(c.isalpha() for c in r[1] or "")]
    docs = [r[:2] for r in plain_lines(docs)]
    docs = [r for r, (n, least) in zip(docs, near_components(docs, 5, 0.8)) if least == r[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {doc for doc, _, hit, _ in plain_contamination(docs, items) if not hit}
    return [r for r in docs if r[0] in clean]


def test_rows_equal_plain_python(spark):
    docs, tokenizer = brute(spark), Tokenizer.from_file(queries.public_path(queries.TOKENIZER))
    lengths = {doc: len(tokenizer.encode(text, add_special_tokens=False).ids) + 1 for doc, text in docs}
    found = corpus_pipeline.run(spark, SF).collect()
    got = {}
    for r in found:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == lengths
    assert len({r.sequence_id for r in found}) == one_by_one([r.length for r in found], 2048)


def test_stages_take_edge_cases_and_nothing(spark):
    for docs in (edge_documents(spark), empty_documents(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), name)
            if name != "best_fit_packing":
                assert docs.columns == columns
    docs = written(edge_documents(spark), "edge")
    kept = corpus_pipeline.distinct_documents(spark, docs, SF)
    assert kept.where("doc_id in (10, 11)").count() == 1 and kept.count() < len(edge_rows())


def test_the_rest_works_without_these_modules(tmp_path):
    """The entry module imports, with the other queries, where the folder of these operators and the pipeline are gone."""
    os.symlink(f"{ROOT}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    os.mkdir(tmp_path / "spendlens")
    for name in os.listdir(f"{ROOT}/spendlens"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/spendlens/{name}", tmp_path / "spendlens" / name)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; print(sorted(e.queries())[:1], 'pipeline' in e.queries())"
    code = code.replace("import __spark_entry__ as e", "import importlib.util as u; s = u.spec_from_file_location('entry', "
                        f"{str(tmp_path / 'entry.py')!r}); e = u.module_from_spec(s); s.loader.exec_module(e)")
    (tmp_path / "entry.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": "/opt/py313/lib/python3.13/site-packages"})
    assert said.returncode == 0, said.stderr
    assert said.stdout.strip().endswith("False")


def test_documents_stay_where_no_language_is_labelled(spark):
    docs = edge_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.known_language(spark, docs, "").count() == docs.count()


def test_documents_like_no_language_go(spark):
    rows = [(n, "the cat and the dog", "en") for n in range(5)] + [(10, "9 8 7", "en"), (11, "ж 12 34", None), (12, "a dog and a cat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    profiles = corpus_pipeline.learn(docs)
    scores = dict(zip((10, 11, 12), profiles.predict(["9 8 7", "ж 12 34", "a dog and a cat"])[1]))
    assert kept == {0, 1, 2, 3, 4} | {doc for doc, score in scores.items() if score > 0} and 12 in kept and 10 not in kept


def test_documents_stay_where_languages_have_the_same_texts(spark):
    docs = spark.createDataFrame([(n, "the same text", lang) for n, lang in enumerate(["en", "fr"])], "doc_id long, text string, lang string")
    assert corpus_pipeline.known_language(spark, docs, "").count() == 2
