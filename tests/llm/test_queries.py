"""Registered corpus queries on the small tables, and the pipeline's stages."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from areapanel.llm import queries
from areapanel.session import staged

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")

COLUMNS = {
    1: "vec_id n_links component_id kept",
    2: "doc_id piece start length ids_crc32 sequence_id offset",
    3: "doc_id held_out score predicted",
    4: "doc_id n_tokens ids_sha256 decoded_sha256",
    5: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    6: "doc_id n_assign n_access n_hex base_sha256 spans",
    7: "doc_id start n_tokens ids_crc32",
    8: "doc_id held_out n_tokens n_known train_tokens base_score score",
    9: "doc_id held_out score predicted",
    10: "doc_id n_shingles component_id",
    11: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    12: "item_id rank doc_id score",
    13: "doc_id n_bytes n_removed n_spans kept_sha256",
}


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_query(spark, n):
    (name,) = [q for q in queries.queries() if q.startswith(f"op{n}_")]
    df = queries.queries()[name](spark, FOLDER)
    assert set(COLUMNS[n].split()) <= set(df.columns)
    sql = queries.oracle_sql().get(name)
    if sql is None:
        table, key = ("conversations", "conv_id") if n == 11 else ("documents", "doc_id")
        assert df.count() >= spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).distinct().count()
        return
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept, ids = docs, set()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = staged(stage(spark, kept, FOLDER), name)
        assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    clean = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in ids for i in clean) >= 0.85 * len(clean)  # copies of clean documents go
    assert sum(i in ids for i, r in labels.items() if r["toxic"] == 1 or r["quality"] == 0) <= 4
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids


def test_pipeline_on_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, FOLDER), name)
    assert docs.count() == 0
