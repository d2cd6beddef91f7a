"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of ``docs``; the last adds token counts and digests. Rows are told apart by doc_id and text, so rows that share an
id, or have none, are judged each by its own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import bpe, decontam, line_dedup, quality, wide_simhash
from gridweave.llm._spark import BROADCAST_ROWS, NULL_ID, checkpoint, freeing_shuffles, join_sized, row_key, shared_path
from gridweave.llm.queries import table, tokenizer_path


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not in ``rows`` (rid, th); broadcast only if counted to be few."""
    gone = rows.select(F.col("rid").alias("__rid"), F.col("th").alias("__th")).distinct()
    rid, th = row_key()
    keyed = docs.select("*", rid.alias("__rid"), th.alias("__th"))
    return join_sized(keyed, checkpoint(gone), ["__rid", "__th"], "left_anti", BROADCAST_ROWS).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model).filter(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents share; every document stays."""
    return line_dedup.drop_lines(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id; null ids only if no row has another.

    Near copies are texts whose sets of five-word shingles have a similarity of 0.8 or more.

    Of rows that share the id, the one with the smallest hash of its text stays; of rows that share both, the one with the
    smallest hash of all its columns.
    """
    each = wide_simhash.similar_groups(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("rid"), "th", "stays")
    left = _without(docs, each.filter("not stays"))
    twice = checkpoint(each.filter("stays").groupBy("rid", "th").agg(F.count("*").alias("n")).filter("n > 1").select("rid", "th"))
    if twice.isEmpty():
        return left
    rid, th = row_key()
    keys = twice.select(F.col("rid").alias("__rid"), F.col("th").alias("__th"))
    again = join_sized(left.select("*", rid.alias("__rid"), th.alias("__th")), keys, ["__rid", "__th"], "left_semi", BROADCAST_ROWS)
    one = again.groupBy("__rid", "__th").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
    return _without(left, twice).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontam.contaminated_rows(docs, table(spark, sf_dir, "benchmark")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.encode(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("line_dedup", drop_common_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenise),
]

#: A fitted classifier, fingerprints, alignment and merges are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with freeing_shuffles(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
