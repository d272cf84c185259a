"""A training corpus from raw documents: quality, near copies, repeated passages, benchmarks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents. Documents that a stage rejects are gone; substring dedup rewrites
the texts it cuts and drops those of which nothing is left.

Edge cases: null and empty texts fail the quality rules, so later stages see none unless called by
themselves; an empty table gives empty stages; of ties in near dedup the smallest doc_id stays. Rows that
repeat a doc_id share its verdict; equal rows of the document that stays all stay. Rows without a doc_id
are judged like any other, under a number made of their text and above all doc_ids, so a numbered copy
stays rather than theirs; they keep their null. Extra columns pass through the four filtering stages.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.llm import bpe, decontaminate, quality_rules, simhash, substring_dedup
from recallgrid.llm.common import materialize, read
from recallgrid.llm.queries import tokenizer_path

_UNNUMBERED = "_corpus_unnumbered"


def _number():
    """The doc_id; for a row without one a number from 2^62 up, made of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62))


def _numbered(docs):
    return docs.withColumn("doc_id", _number())


def _filtered(docs, judged, how):
    """The rows of docs whose number is (left_semi) or isn't (left_anti) among the judged doc_ids."""
    return docs.join(judged.select(F.col("doc_id").alias("_corpus_judged")), _number() == F.col("_corpus_judged"), how)


def quality(spark, docs, sf_dir):
    return _filtered(docs, quality_rules.judge(_numbered(docs)).where("kept"), "left_semi")


def near_dedup(spark, docs, sf_dir):
    """The component's smallest doc_id stays."""
    return _filtered(docs, simhash.near_duplicates(_numbered(docs)).where("doc_id = component_id"), "left_semi")


def substring(spark, docs, sf_dir):
    known = _numbered(docs.withColumn(_UNNUMBERED, F.col("doc_id").isNull()))
    out = substring_dedup.dedup_substrings(known, splits=(0.2,), keep_text=True).where("n_removed < n_words or n_words = 0")
    text = F.when(F.col("carry.had_text"), F.col("kept_text"))
    size = F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("carry.n_chars"))
    number = F.when(~F.col(f"carry.{_UNNUMBERED}"), F.col("carry.doc_id"))
    new = {"doc_id": number.cast(docs.schema["doc_id"].dataType), "text": text, "n_chars": size.cast(docs.schema["n_chars"].dataType)}
    return out.select(*(new.get(c, F.col(f"carry.{c}")).alias(c) for c in docs.columns))


def decontaminated(spark, docs, sf_dir):
    return _filtered(docs, decontaminate.decontaminate(_numbered(docs), read(spark, sf_dir, "benchmark")).where("contaminated"), "left_anti")


def tokens(spark, docs, sf_dir):
    return bpe.encode(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("substring dedup", substring), ("decontamination", decontaminated), ("bpe", tokens)]
#: Perplexity bands, components and the tokenizer's merges are beyond SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
