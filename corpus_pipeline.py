"""From raw documents to token files, in stages that are each written and read again.

A stage is a function of (spark, docs, sf_dir); all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.llm.bitplane_tokens import tokens_of
from kiln.llm.common import materialise, table
from kiln.llm.decontaminate import find_leaks
from kiln.llm.fast_minhash import near_duplicates
from kiln.llm.mix_threshold import mix
from kiln.llm.toxicity import score_toxicity


def toxicity(spark, docs, sf_dir):
    """Reject the documents whose toxicity score is 0.5 or more (operator 1)."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where("toxic_score < 0.5").select(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    """Of every group of near-duplicates (five-word shingles, similarity 0.8) keep the one with the smallest id (operator 5).

    Documents without an id are kept.
    """
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark, docs, sf_dir):
    """Reject the documents in which a benchmark passage was found (operator 4)."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Take every document as often as the mix says: not at all, once or twice (operator 9)."""
    repeats = F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))
    return mix(docs).withColumn("_copy", repeats).select(*docs.columns)


def token_files(spark, docs, sf_dir):
    """Write the token files and return what reading them back gives, one row per document taken (operator 6)."""
    return tokens_of(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token-files", token_files),
]

#: Two stages cannot be written in SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``; every stage's result is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
