"""Training-corpus pipeline: language, near duplicates, repeated passages, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefit.llm import jaccard, language, mixing, pieces, repeats
from tablefit.session import ship
from tablefit.sources.tables import shared_folder

#: a text closer to no profile than this is in none of the languages, however few labelled rows there are
LEAST_SCORE = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rank-order profiles learnt from the rows with a language; rows without letters, or further from
    every profile than labelled rows of about as many n-grams are, go. ``lang`` becomes the predicted
    language. Null and empty texts go."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    profiles = language.train(docs)
    found = language.predict(rows, profiles, keep=["row"], sizes=True)
    # one row for each language: its least scores by octave; an octave without one takes that below it
    least = language.least_scores(docs, profiles).groupBy(F.col("lang_pred").alias("__lang")).agg(F.sort_array(F.collect_list(F.struct("octave", "least"))).alias("__least"))
    found = found.join(F.broadcast(least), F.col("lang_pred") == F.col("__lang"), "left")
    own = F.try_element_at(F.filter("__least", lambda x: x["octave"] <= F.col("octave")), F.lit(-1))["least"]
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= F.greatest(F.lit(LEAST_SCORE), own)))
    return kept.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id."""
    return jaccard.one_of_each_class(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes or more that occur more than once are cut out of every text."""
    return repeats.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.emit_mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken, and the text that they decode to."""
    return pieces.encode(docs, pieces.public_model, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixture", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is stored in the shared folder."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: stages 1 to 3 have no SQL; tests compare run() with a brute-force version
ORACLE_SQL = None
