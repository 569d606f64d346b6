"""Corpus cleaning: language, near copies, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns
rows with the columns of ``documents``; the last returns tokens. Between stages the
rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfolio.llm.bpe import encode_decode
from quartzfolio.llm.common import Scratch
from quartzfolio.llm.decontamination import find_contamination
from quartzfolio.llm.language_id import keep_identified, train
from quartzfolio.llm.minhash import near_duplicates
from quartzfolio.llm.secrets import redact, scan, train_models

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of a list of rows to drop that go to every executor at most.
BROADCAST_ROWS = 1_000_000


def _checked(frame: DataFrame) -> DataFrame:
    """Broadcast behind a count; a shuffle join beyond it."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is not known go: no letters, or unlike all that was learnt."""
    docs = docs.select(*COLUMNS)
    return keep_identified(docs, train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the least id.

    Rows without an id stay; of equal rows one stays; of rows that share an id but not
    a text, each stays or goes with its own text's class.
    """
    docs = docs.select(*COLUMNS)
    scratch = Scratch(spark, "near")
    marks = scratch.save(near_duplicates(docs).select("doc_id", "row", "kept"), "marks")
    gone = marks.where("doc_id is not null").groupBy("doc_id", "row").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone = scratch.save(gone.where("not kept or n > 1"), "gone")
    keyed = docs.withColumn("row", F.xxhash64("text"))
    out = keyed.join(_checked(gone.select("doc_id", "row")), ["doc_id", "row"], "left_anti")
    repeated = gone.where("kept")
    if repeated.limit(1).count():
        again = keyed.join(_checked(repeated.select("doc_id", "row")), ["doc_id", "row"], "left_semi")
        out = out.unionByName(again.dropDuplicates(["doc_id", "text"]))
    return out.select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold half or more of a benchmark item's words go."""
    docs = docs.select(*COLUMNS)
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = Scratch(spark, "leaks").save(found.select(F.col("doc_id").alias("leak_id"), F.col("row").alias("leak_row")).distinct(), "found")
    same = F.col("doc_id").eqNullSafe(F.col("leak_id")) & (F.xxhash64("text") == F.col("leak_row"))
    return docs.join(_checked(found), same, "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows where it changed. Null texts stay
    null; rows without an id and repeated rows stay as they are."""
    docs = docs.select(*COLUMNS)
    found = scan(docs.withColumn("no_text", F.col("text").isNull()), train_models(docs), carry=("lang", "source", "n_chars", "no_text"))
    changed = F.size("found") > 0
    text = F.when(~F.col("no_text"), redact(F.col("text"), F.col("found")))
    out = found.select("doc_id", text.alias("text"), "lang", "source", "n_chars", changed.alias("changed"))
    return out.withColumn("n_chars", F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row as digests; null text is empty, repeated rows stay."""
    out = encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("secrets", secrets), ("tokens", tokens)]
#: Trained models and tokenizers can't be stated in SQL; tests hold it against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
