"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a frame whose decisions have
taken effect. run() writes each stage's rows to the shared folder and rereads them as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm import decontam, toxicity
from quarrygraph.llm.common import fresh_path, read_table, written
from quarrygraph.llm.minhash_dedup import near_groups
from quarrygraph.llm.mixing import mix
from quarrygraph.llm.queries import tokenizer_file
from quarrygraph.llm.token_output import token_output

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity machine rejects go; all others stay. Every row is judged by its own text, whatever its doc_id."""
    return toxicity.drop_toxic(docs.select(COLUMNS), read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least doc_id.

    Rows that share a doc_id are one document and stay or go together. Rows without doc_id are in no group and stay.
    """
    gone = written(near_groups(docs, shingle=5, percent=80).where("NOT kept").select("doc_id").distinct(), "near-gone")
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go, each judged by its own text, whatever its doc_id."""
    return decontam.drop_leaks(docs.select(COLUMNS), read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: 0, 1 or 2 times. Documents without words weigh nothing and stay once."""
    mixed = mix(docs.select(COLUMNS))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1)).cast("int")
    return mixed.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, written in directly addressable codes; per document what the files hold.

    With a smaller cache and smaller groups than the operator's usual ones: the executors' heaps are full after four stages.
    """
    return token_output(docs, tokenizer_file("byte_bpe_50k.json"), cache=100_000, group=500_000).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: The stages' models, sketches and token ids cannot be written in SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
