"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.llm import (
    alignment, bpe, fim, langid, leaks, paragraphs, pseudonyms, recurrent, repeats, rules, simhash, token_counts, warc,
)
from ticketmill.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

# Tokens that a training window of the registered query holds.
TOKEN_LIMIT = 4096

# A key for the registered queries; real data needs a secret one.
PSEUDONYM_KEY = "example key of the registered queries"


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op1_warc_derivatives(spark, sf):
    records = warc.derivatives(warc.page_responses(table(spark, sf, "pages")))
    listed = F.array_join(F.transform("source_headers", lambda h: F.concat(h["name"], F.lit("="), h["value"])), "|")
    return records.withColumn("source_headers", listed)


ORACLES["op1_warc_derivatives"] = warc.ORACLE


@query
def op2_feistel_pseudonyms(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY, count="n_pseudonyms")


@query
def op3_kneser_ney_language(spark, sf):
    docs = table(spark, sf, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    found = langid.identify(docs, out)
    return found.select("doc_id", out.alias("held_out"), *found.columns[1:])


@query
def op4_interval_expansion(spark, sf):
    return repeats.remove_repeats(table(spark, sf, "documents"))


@query
def op5_spaced_seeds(spark, sf):
    return leaks.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


ORACLES["op5_spaced_seeds"] = leaks.ORACLE


@query
def op6_paragraph_bands(spark, sf):
    return paragraphs.repeated_paragraphs(table(spark, sf, "documents"))


@query
def op7_merge_replay(spark, sf):
    return bpe.encode_documents(table(spark, sf, "documents"), VOCABULARY, public_tokenizers.PATTERN)


@query
def op8_gated_recurrent(spark, sf):
    return recurrent.score_documents(table(spark, sf, "documents"), held_out(F.col("doc_id"), 7, 2))


@query
def op9_adaptive_rules(spark, sf):
    return rules.filter_documents(table(spark, sf, "documents"))


ORACLES["op9_adaptive_rules"] = rules.ORACLE


@query
def op10_pivot_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents")).drop("text_key", "fp", "component")


@query
def op11_distinct_text_alignment(spark, sf):
    return alignment.align_documents(table(spark, sf, "documents"), BYTE_LEVEL, PIECES)


@query
def op12_framed_fill_in_middle(spark, sf):
    return fim.fill_in_middle(table(spark, sf, "documents"))


ORACLES["op12_framed_fill_in_middle"] = fim.ORACLE


@query
def op13_balanced_token_counts(spark, sf):
    return token_counts.count_tokens(table(spark, sf, "documents"), PIECES, TOKEN_LIMIT)
