"""The corpus pipeline: quality rules, n-gram Jaccard join, substring dedup, benchmark decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and rereads it as the next
one's docs. All but the last return the columns of ``documents``; n_chars is that of the text they return. Extra columns of
the input are passed through by no stage.

Every stage tells rows apart by all their columns, never by doc_id alone, so that documents of a repeated or null doc_id are
judged on their own; equal rows share their fate (the Jaccard join keeps one of them). A null text has no words: the
quality rules drop it, the other stages leave it as it is (the mix takes no words of it). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, jaccard, mixing, quality, substring
from tideline.llm.common import WORD, Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs.select(*COLUMNS), COLUMNS).where("kept").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ``_row``, a hash of all columns: rows of one doc_id, or of none, are told apart; only equal rows share it."""
    nulls = F.concat(*[F.col(c).isNull().cast("string") for c in COLUMNS])
    return docs.select(*COLUMNS).withColumn("_row", F.xxhash64(*COLUMNS, nulls))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each similarity class: the one with the least doc_id (a null one last). Documents without words are classes of their own."""
    docs = _keyed(docs)
    classes = Scratch(spark).keep(jaccard.similarity_classes(docs, "_row").where("class is not null").select("_row", "class", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("rank")), "classes")
    best = classes.groupBy("class").agg(F.min("rank").alias("best")).select(F.col("class").alias("c"), F.col("best._row").alias("best"))
    lost = classes.join(best, F.col("class") == F.col("c")).where("_row <> best").select("_row")
    some = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = docs.where(some).join(lost, "_row", "left_anti").dropDuplicates(["_row"])
    return kept.select(*COLUMNS).unionByName(docs.where(~some).select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeat a passage of a document of smaller doc_id; texts that lose nothing stay as they are, emptied ones go."""
    docs = _keyed(docs)
    cut = substring.dedup_substrings(docs, "_row").where("n_removed > 0").select(F.col("_row").alias("r"), F.col("kept").cast("string").alias("kept")).dropDuplicates(["r"])
    out = docs.join(Scratch(spark).keep(cut, "cut"), F.col("_row") == F.col("r"), "left").withColumn("text", F.coalesce("kept", "text")).where("kept is null or kept <> ''")
    return out.withColumn("n_chars", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    docs = _keyed(docs)
    hit = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), "_row").select("_row").distinct()
    return docs.join(hit, "_row", "left_anti").select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document with its number of copies, 0 included, and the words that these take."""
    out = mixing.mix(mixing.numbered(mixing.sizes(docs)))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
]
#: SQL can express neither the classes of the Jaccard join nor the random rounding; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over all documents. What a stage has written on its way goes when its result is written."""
    scratch, mark = Scratch(spark), Scratch.mark()
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.clear(mark, docs)
    return docs
