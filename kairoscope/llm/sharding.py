"""Sharding by a two-pass external shuffle (DataFrame functions only).

Pass 1 scatters the records into memory-sized buckets by a seeded hash: one
exchange of the whole rows. Pass 2 gives every bucket a Fisher-Yates
permutation, drawn from a seeded hash of (bucket, step) in the bucket's own
task, deals the permuted records to the shards in turn and writes them. All of
it is a pure function of the rows and the seed, so a task that is run again
after a lost executor gives the same rows.

Defined results: a null or empty text counts one byte; null ids hash like any
value; rows that are equal in all columns are numbered before they are
scattered, so any number of them spreads over all buckets; rows equal in id and
text may take each other's slots; very long texts move as they are; an empty
table gives an empty result; input columns named like an output column
(``shard``, ``slot``) are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, new_path, read_table
from .row_keys import keyed_rows

SEED = 20_011
#: A bucket is cut to these bounds on average.
BUCKET_BYTES = 16 << 20
BUCKET_ROWS = 512
#: Buckets of one group of the two-level prefix sum.
GROUP = 4096

#: Fisher-Yates from the last place down: draw j in 1..i, swap places i and j.
FISHER_YATES = """
    CASE WHEN b_rows < 2 THEN array(1L) ELSE aggregate(
        transform(sequence(b_rows, 2L, -1L), i -> named_struct(
            'i', CAST(i AS INT), 'j', CAST(1 + pmod(xxhash64({seed}L, b_bucket, i), i) AS INT))),
        sequence(1L, b_rows),
        (p, d) -> CASE WHEN d.i = d.j THEN p ELSE concat(
            slice(p, 1, d.j - 1), array(p[d.i - 1]),
            slice(p, d.j + 1, d.i - d.j - 1), array(p[d.j - 1]),
            slice(p, d.i + 1, CAST(b_rows AS INT) - d.i)) END) END
"""


def _offsets(buckets: DataFrame) -> DataFrame:
    """b_bucket and b_offset, the rows in earlier buckets."""
    buckets = buckets.withColumn("b_group", F.floor(F.col("b_bucket") / GROUP))
    before = W.partitionBy("b_group").orderBy("b_bucket").rowsBetween(W.unboundedPreceding, -1)
    groups = buckets.groupBy("b_group").agg(F.sum("b_rows").alias("g_rows"))
    #: One row for each 4,096 buckets, so this window stays small.
    earlier = W.orderBy("b_group").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("b_group", F.coalesce(F.sum("g_rows").over(earlier), F.lit(0)).alias("g_offset"))
    inside = buckets.withColumn("in_group", F.coalesce(F.sum("b_rows").over(before), F.lit(0)))
    return inside.join(groups, "b_group").select("b_bucket", (F.col("g_offset") + F.col("in_group")).alias("b_offset"))


def external_shuffle(
    df: DataFrame,
    n_shards: int = 8,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``df`` plus ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    Law ``rows``: shard sizes are at most one row apart.
    """
    df = df.drop("shard", "slot")
    total = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(1).cast("long")), F.lit(0)).alias("b"),
    ).first()
    n_buckets = max(1, -(-total["n"] // bucket_rows), -(-total["b"] // bucket_bytes))
    bucket = F.pmod("key", F.lit(n_buckets).cast("long"))
    scattered = keyed_rows(df, seed, [id_col, text_col]).withColumn("b_bucket", bucket)
    buckets = scattered.groupBy("b_bucket").agg(F.count(F.lit(1)).alias("b_rows"))
    offsets = _offsets(materialize(buckets, "shard-buckets"))
    place = W.partitionBy("b_bucket").orderBy("key", F.xxhash64("row"), F.col(f"row.{id_col}"), F.col(f"row.{text_col}"))
    #: The permutations grow with the rows: they are drawn where the bucket's rows are, never broadcast.
    perms = buckets.select("b_bucket", F.expr(FISHER_YATES.format(seed=seed)).alias("b_perm"))
    placed = scattered.withColumn("b_place", F.row_number().over(place)).join(perms.hint("merge"), "b_bucket")
    at = F.col("b_offset") + F.element_at("b_perm", F.col("b_place")) - 1
    return (
        placed.join(offsets, "b_bucket")
        .select("row", at.alias("b_at"))
        .select(
            "row.*",
            F.pmod("b_at", F.lit(n_shards)).cast("int").alias("shard"),
            F.floor(F.col("b_at") / n_shards).cast("long").alias("slot"),
        )
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; each file has whole buckets, its rows in the order of their slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    write_shards(external_shuffle(read_table(spark, sf_dir, "documents").select("doc_id", "text")), path)
    out = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
