from __future__ import annotations

import hashlib
import struct
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from ticketmill.llm import bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    prose = [" ".join(f"{a}{b}{'nostr'[(i * k) % 5]}" for k, (a, b) in enumerate(zip("thewor" * 7, "andsofthe" * 5))) + f" number{i}"
             for i in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(prose)]
    rows += [(100, prose[3] + " more", "en", "s", 1), (101, None, "en", "s", 0), (102, "123 456", None, None, 7),
             (103, prose[5] + " write me@here.org", None, "s", 5), (104, "Leading words. Some Secret question, with an ANSWER in it: forty two! Tail.", "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some secret question with an answer in it forty two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_decisions_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns, name
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert {101, 102} & set(seen["language_id"]) == set()
    assert 104 in seen["near_duplicates"] and 104 not in seen["decontamination"]
    assert not any("me@here.org" in t for t in seen["personal_data"].values())
    ids = set(seen["personal_data"])
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, tables).collect()}
    assert set(out) == ids
    for i, text in seen["personal_data"].items():
        encoded = own.encode_ordinary(text)
        assert out[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(encoded)}I", *encoded)).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark, tables, tmp_path_factory):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    assert docs.count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="tables not there")
def test_given_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() == out.select("doc_id").distinct().count() <= spark.read.parquet(f"{SF}/documents.parquet").count()
