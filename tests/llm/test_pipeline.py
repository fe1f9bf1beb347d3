"""The registered queries on small tables, and the pipeline's stages, each on its own input."""

import os
import re
from collections import Counter

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from siteferry.llm import queries
from tests.checking import compare, connect
from tests.llm import brute

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")

needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_queries_are_registered():
    names = entry_points.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLES) <= set(entry_points.oracle_sql())


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLES[name]) is None


@needs_tables
def test_near_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = queries.QUERIES["op5_near_dedup"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_classes(rows, 4)


@needs_tables
def test_scoring_queries_return_every_document(spark):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    for name in ("op3_quality", "op6_toxicity"):
        got = queries.QUERIES[name](spark, SF_DIR)
        assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
        assert sorted(r.doc_id for r in got.collect()) == ids
    pages = sorted(r.page_id for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect())
    got = queries.QUERIES["op7_html_text"](spark, SF_DIR).collect()
    assert sorted(r.page_id for r in got) == pages and all(r.n_chars == len(r.text) > 0 for r in got)


@needs_tables
def test_stages(spark, tmp_path):
    """Each stage keeps what it should of all that the one before it kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    held = {"input": docs}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, SF_DIR)
        out.write.parquet(str(tmp_path / name))
        docs = held[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "pack" or docs.columns == columns
    texts = {name: {r.doc_id: r.text for r in df.collect()} for name, df in held.items() if name != "pack"}

    scores = queries.QUERIES["op6_toxicity"](spark, SF_DIR).filter("predicted = 0").collect()
    assert texts["toxicity"].keys() == {r.doc_id for r in scores}
    assert all(texts["input"][i] == t for i, t in texts["toxicity"].items())

    wanted = brute.line_classes(sorted(texts["toxicity"].items()))
    for i, text in texts["toxicity"].items():
        lines = (text or "").split("\n")
        rest = [x for n, x in enumerate(lines) if not x.strip() or wanted[i, n] == (i, n)]
        if "".join(rest).strip() or len(rest) == len(lines):
            assert texts["line_dedup"][i] == "\n".join(rest)
        else:
            assert i not in texts["line_dedup"]

    near = brute.near_classes(sorted(texts["line_dedup"].items()), 5)
    assert texts["near_dedup"].keys() == {i for i, (_, c) in near.items() if i == c}
    assert texts["mix"] == texts["near_dedup"]
    packed = Counter(r.doc_id for r in held["pack"].filter("piece = 0").collect())
    assert packed == Counter(texts["mix"].keys())
    sources = [r.source for r in held["mix"].collect()]
    assert len(set(sources[: len(sources) // 3])) > 1


@needs_tables
def test_run_gives_the_rows_of_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0
