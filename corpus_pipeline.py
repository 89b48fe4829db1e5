"""Corpus pipeline: documents -> quality -> near duplicates -> repeated passages -> sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

import public_tokenizers
from pyspark.sql import functions as F

from userprism.llm import jaccard, packing, quality, substrings
from userprism.llm.shipping import ship
from userprism.operators.scale import stage


def keep_quality(spark, docs, sf_dir):
    """Documents whose probability of label 1 is 0.5 or more; a third of the labels never trains."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trains = ~F.coalesce(quality.remainder() == 1, F.lit(False))
    model = quality.fit(docs, labels.filter(trains))
    return quality.score(docs, model, "__score").filter("__score >= 0.5").drop("__score")


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    ship(spark)
    return jaccard.representatives(docs, percent=80, width=5)


def cut_repeats(spark, docs, sf_dir):
    """Texts without the passages of 35 words that occur elsewhere; ``n_chars`` follows."""
    ship(spark)
    cut = substrings.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def pack_sequences(spark, docs, sf_dir):
    """Token sequences of at most 4096 tokens."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("packing", pack_sequences),
]

# Tokens and learnt weights have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
