"""Write-once files with a manifest that they are held against when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(RuntimeError):
    """Files or rows that are not those of the manifest."""


def series_manifest(rows: DataFrame) -> DataFrame:
    """series_id, n, first, last and a digest of each series (d, v); rows are hashed where they lie and summed, so no series is gathered."""
    line = F.sha2(F.concat_ws(",", F.col("d").cast("string"), F.col("v").cast("string")), 256)
    part = lambda a: F.sum(F.conv(F.substring(line, a, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("first"), F.max("d").alias("last"), F.sha2(F.concat_ws("|", part(1), part(13), part(25)), 256).alias("digest")
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, length and SHA-256 of each data file. A file is one value in a task, so files must be of bounded size, as Spark writes them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def write_once(rows: DataFrame, path: str) -> None:
    """Writes series_id, d and v with their manifest; a path that exists is an error, and so a second write is refused."""
    rows.select("series_id", "d", "v").write.mode("errorifexists").parquet(f"{path}/data")
    spark = rows.sparkSession
    file_digests(spark, path).write.mode("errorifexists").json(f"{path}/files")
    series_manifest(spark.read.parquet(f"{path}/data")).write.mode("errorifexists").json(f"{path}/series")


def file_issues(spark: SparkSession, path: str) -> DataFrame:
    """name and issue of files that changed, are gone or were added."""
    told = spark.read.schema("name string, length long, sha256 string").json(f"{path}/files")
    both = told.join(file_digests(spark, path).select("name", F.col("length").alias("l"), F.col("sha256").alias("s")), "name", "full")
    issue = F.when(F.col("s").isNull(), "FILE_GONE").when(F.col("sha256").isNull(), "FILE_ADDED").when((F.col("s") != F.col("sha256")) | (F.col("l") != F.col("length")), "FILE_CHANGED")
    return both.select("name", issue.alias("issue")).where("issue is not null")


def row_issues(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """name (a series) and issue where rows are not those of the manifest, repeat a date or hold no finite value."""
    found = series_manifest(rows).select("series_id", *[F.col(c).alias(f"f_{c}") for c in ("n", "first", "last", "digest")])
    both = manifest.join(found, "series_id", "full")
    issue = (
        F.when(F.col("f_n").isNull(), "SERIES_GONE").when(F.col("n").isNull(), "SERIES_ADDED").when(F.col("n") != F.col("f_n"), "ROW_COUNT")
        .when((F.col("first") != F.col("f_first")) | (F.col("last") != F.col("f_last")), "RANGE").when(F.col("digest") != F.col("f_digest"), "DIGEST")
    )
    differs = both.select(F.col("series_id").alias("name"), issue.alias("issue")).where("issue is not null")
    odd = rows.groupBy("series_id", "d").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))).alias("no"))
    odd = odd.select(F.col("series_id").alias("name"), F.when(F.col("n") > 1, "REPEATED_DATE").when(F.col("no") | F.col("d").isNull(), "NOT_FINITE").alias("issue"))
    return differs.unionByName(odd.where("issue is not null").distinct())


def issues(spark: SparkSession, path: str) -> DataFrame:
    """name and issue of whatever is wrong: files first, and rows if the files are whole."""
    wrong = file_issues(spark, path)
    if not wrong.isEmpty():
        return wrong
    manifest = spark.read.schema("series_id string, n long, first date, last date, digest string").json(f"{path}/series")
    return row_issues(spark.read.parquet(f"{path}/data"), manifest)


def read_verified(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a path, or an error that names the first thing wrong with it."""
    first = issues(spark, path).orderBy("name").first()
    if first is not None:
        raise Refused(f"{first['issue']}: {first['name']}")
    return spark.read.parquet(f"{path}/data")
