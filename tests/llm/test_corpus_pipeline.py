"""The registered corpus queries against SQL, and the pipeline's stages against plain versions."""

import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from test_corpus_texts import plain_components, plain_exact, plain_fingerprint
from tidemark.llm import secrets, toxicity
from tidemark.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_every_operator_has_its_query():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    expected = con.sql(ORACLES[name])
    rows = QUERIES[name](spark, SMALL).select(*expected.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(expected.fetchall())


def test_packing_query_covers_every_id(spark):
    rows = QUERIES["op9_packing"](spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(WORDS)
    covered = dict.fromkeys(texts, 0)
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for d, t in texts.items()}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
    assert covered == {d: len(x) for d, x in ids.items()}
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in {r["sequence_id"]: r["sequence_tokens"] for r in rows}.values())
    assert padding == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.stage(function(spark, docs, SMALL), "test")
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    kept = lambda name: {r["doc_id"]: r["text"] for r in seen[name][1].collect()}

    before = seen["toxicity"][0]
    scored = toxicity.toxicity(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert set(kept("toxicity")) == {r["doc_id"] for r in scored.where("not toxic").collect()} <= set(before)
    before = seen["exact_dedup"][0]
    assert set(kept("exact_dedup")) == {x[0] for x in plain_exact(before.items()) if x[3]}
    before = seen["simhash"][0]
    assert set(kept("simhash")) == set(plain_components([(d, plain_fingerprint(t)) for d, t in before.items()]).values())
    before = seen["secrets"][0]
    assert kept("secrets") == {d: secrets.redacted(t, "[SECRET]") for d, t in before.items()}
    tokenizer, lengths = Tokenizer.from_file(WORDS), {}
    for r in seen["packing"][1].collect():
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in kept("secrets").items()}


def test_run_returns_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SMALL).select("doc_id").distinct().count() > 50
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py" and corpus_pipeline.ORACLE_SQL is None
