"""From raw documents to placed training data: five stages, each an operator of the package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultferry.llm.decontaminate import benchmark_overlap, contaminated
from vaultferry.llm.mixing import Mix, domain_of, mixed_documents
from vaultferry.llm.near_dedup import near_duplicates
from vaultferry.llm.quality import ACCEPT, fit, scorer
from vaultferry.llm.queries import DOMAINS, SHARDS
from vaultferry.llm.sharding import placed
from vaultferry.llm.support import restrict, stored, table
from vaultferry.session import scratch_path

# Link texts with at least this similarity of their five-word shingles.
SIMILARITY = 80
# Target weights; each document is read once at most, so the rows stay distinct.
WEIGHTS = ({"web": 0.5, "books": 0.3, "code": 0.2}, {}, {})
SHARE = 0.9


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts. It learns from the labelled raw documents."""
    raw, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.where(scorer(fit(raw, labels))(F.col("text")) >= ACCEPT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies.

    Of rows that repeat an id one is kept. Rows without an id are in no group and stay.
    """
    groups = stored(near_duplicates(docs, SIMILARITY), "groups")
    dropped = groups.where("not kept").select(F.col("doc_id").alias("llm_dropped")).distinct()
    left = restrict(docs, stored(dropped, "dropped"), "doc_id", keep=False)
    repeated = (
        groups.where("kept and doc_id is not null")
        .groupBy(F.col("doc_id").alias("llm_repeated"))
        .count()
        .where("count > 1")
        .select("llm_repeated")
    )
    repeated = stored(repeated, "repeated")
    if repeated.isEmpty():
        return left
    once = restrict(left, repeated, "doc_id", keep=False)
    return once.union(restrict(left, repeated, "doc_id", keep=True).dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies inside benchmark windows."""
    overlap = benchmark_overlap(docs, table(spark, sf_dir, "benchmark"))
    flagged = overlap.where(contaminated()).select(F.col("row_key").alias("llm_flagged")).distinct()
    keyed = docs.select("*", F.xxhash64("doc_id", "text").alias("llm_row_key"))
    clean = restrict(keyed, stored(flagged, "flagged"), "llm_row_key", keep=False)
    return clean.drop("llm_row_key")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token prefix of every source that its target weight allows."""
    mix = Mix(weights=WEIGHTS, share=SHARE, epochs=1)
    return mixed_documents(docs, domain_of(F.col("source"), DOMAINS), mix).select("row.*")


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number of their shard."""
    return placed(docs, SHARDS)


STAGES = [
    ("quality classifier", accept_quality),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("sharding", place_in_shards),
]

# The classifier and the similarity groups have no SQL form; tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
