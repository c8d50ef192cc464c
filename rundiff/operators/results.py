"""Keyed result tables: newest row per key, reuse, expiry and statistics.

Columns: ``key, data, timestamp, access_count, last_accessed, entry_type``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rundiff.functions.numbers import rounded
from rundiff.session import cut_lineage

# Lifetime and size of a result table, and its entry types.
MAX_AGE_DAYS = 7
MAX_ENTRIES = 1000
EXTRACTED_CODE = "extracted_code"
ANALYSIS_RESULT = "analysis_result"
BUCKETS = 256  # of a stored result table


def result_key(repo: Column, class_path: Column, method: Column, analysis: bool = False) -> Column:
    """First 16 hex digits of the SHA-256 of ``repo::class::method``."""
    text = F.concat_ws("::", repo, class_path, F.coalesce(method, F.lit("unknown")))
    key = F.substring(F.sha2(text, 256), 1, 16)
    return F.concat(F.lit("analysis_"), key) if analysis else key


def _age_hours(now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / F.lit(3.6e9)


def is_valid(now: Column, max_age_days: int = MAX_AGE_DAYS) -> Column:
    """Not older than the lifetime."""
    return _age_hours(now) <= max_age_days * 24


def newest_per_key(results: DataFrame, *more: DataFrame) -> DataFrame:
    """Union of result tables with the newest row of each key.

    The maximum of a struct folds the copies of a key before the shuffle.
    """
    for other in more:
        results = results.unionByName(other)
    rest = [c for c in results.columns if c not in ("key", "timestamp")]
    newest = results.groupBy("key").agg(F.max(F.struct("timestamp", *rest)).alias("_r"))
    return newest.select("key", "_r.*").select(*results.columns)


def missing_inputs(inputs: DataFrame, results: DataFrame, now: Column, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Inputs whose key has no valid result yet."""
    return inputs.join(results.where(is_valid(now, max_age_days)).select("key"), "key", "left_anti")


def reused_results(inputs: DataFrame, results: DataFrame, now: Column, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Valid results that the inputs ask for, with the access counted."""
    asked = inputs.groupBy("key").agg(F.count("*").alias("_asked"))
    hits = results.where(is_valid(now, max_age_days)).join(asked, "key")
    counted = hits.withColumn("access_count", F.col("access_count") + F.col("_asked"))
    return counted.withColumn("last_accessed", now).drop("_asked")


def retain(
    results: DataFrame, now: Column, max_age_days: int = MAX_AGE_DAYS, max_entries: int = MAX_ENTRIES
) -> DataFrame:
    """Drop expired rows, then keep the most recently used ones (top-k, no global sort)."""
    valid = results.where(is_valid(now, max_age_days))
    return valid.orderBy(F.col("last_accessed").desc(), F.col("key")).limit(max_entries)


def statistics(results: DataFrame, now: Column) -> DataFrame:
    """Totals by type, accesses and the average age in hours."""
    return results.agg(
        F.count("*").alias("total_entries"),
        F.count_if(F.col("entry_type") == EXTRACTED_CODE).alias("extracted_code_entries"),
        F.count_if(F.col("entry_type") == ANALYSIS_RESULT).alias("analysis_result_entries"),
        F.coalesce(F.sum("access_count"), F.lit(0)).alias("total_access_count"),
        rounded(F.coalesce(F.avg(_age_hours(now)), F.lit(0.0))).alias("average_age_hours"),
    )


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")


def stored_results(spark: SparkSession, folder: str, now: Column, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """The valid rows of a result table in a folder."""
    return spark.read.parquet(folder).drop("bucket").where(is_valid(now, max_age_days))


def upkeep(folder: str, new: DataFrame, now: Column, max_age_days: int = MAX_AGE_DAYS, buckets: int = BUCKETS) -> list[int]:
    """Merge new rows into a result table in a folder, in place, and return the buckets that were rewritten.

    Rows are stored by a hash of their key. Only the buckets of new keys are read and replaced, with the newest row of
    each key, without expired ones; other buckets keep their files, and their expired rows are left out when read. The
    merged rows are written aside first, so a lost executor costs no stored row; two writers must take turns.
    """
    spark = new.sparkSession
    incoming = cut_lineage(new.select("*", _bucket(buckets)))
    touched = sorted(r["bucket"] for r in incoming.select("bucket").distinct().collect())  # at most ``buckets``
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    merged = incoming
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        old = spark.read.parquet(folder).where(F.col("bucket").isin(touched))
        merged = incoming.unionByName(old.select(incoming.columns))
    # at least one row of a bucket stays, or its old files would: the newest, which reading leaves out if it expired
    newest = newest_per_key(merged.drop("bucket")).select("*", _bucket(buckets))
    newest = cut_lineage(newest)
    last = newest.groupBy("bucket").agg(F.max(F.struct("timestamp", "key")).alias("_last"))  # one row per bucket
    kept = newest.join(last, "bucket").where(is_valid(now, max_age_days) | (F.struct("timestamp", "key") == F.col("_last"))).drop("_last")
    written = cut_lineage(kept).repartition("bucket")
    written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return touched
