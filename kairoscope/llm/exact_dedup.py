"""Exact deduplication by content hash (DataFrame functions only).

Rows are grouped by a 128-bit hash of their text; of each group the row with
the smallest (or largest) id stays. The bytes of the texts are then compared
inside the groups of more than one row: where a hash stands for several texts,
these rows are grouped anew by hash and text. What is shuffled by hash is
narrow; texts move once, to be compared. Groups that hold a large part of all
rows are pre-aggregated in the tasks and joined back by broadcast (there are
at most 1,000 such groups, at every size).

Defined results: a null text counts as empty; a null id comes last, so it stays
only where all ids of the group are null; of rows with equal ids the one with
the greater row hash stays, and of rows equal in all columns exactly one; very
long texts move as they are; an empty table gives an empty result; columns named
like an output column are replaced, all others are kept (they must be groupable,
so no maps).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialize, read_table

OUTPUTS = ("keep_id", "group_size", "kept")
#: Equal rows that one row stands for while they move.
CHUNK = 4096


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text))


def _groups(rows: DataFrame, keys: list[str], id_col: str, largest: bool) -> DataFrame:
    """For each value of ``keys`` its rows, and of the row that stays its id, its hash and how many are like it."""
    known = F.col(id_col).isNotNull() if largest else F.col(id_col).isNull()
    alike = rows.groupBy(*keys, id_col, "d_row").agg(F.count(F.lit(1)).alias("d_n"))
    first = F.struct(known, F.col(id_col).alias("id"), F.col("d_row").alias("row"), F.col("d_n").alias("n"))
    best = F.max(first) if largest else F.min(first)
    got = alike.groupBy(*keys).agg(F.sum("d_n").alias("group_size"), best.alias("d"))
    return got.select(*keys, "group_size", F.col("d.id").alias("keep_id"), F.col("d.row").alias("d_keep_row"), F.col("d.n").alias("d_keep_n"))


def _decided(rows: DataFrame, groups: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """``rows`` with keep_id, group_size and kept."""
    joined = join_groups(rows, groups, keys, "group_size")
    top = F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("d_row") == F.col("d_keep_row"))
    columns = [*[F.col(f"`{c}`") for c in rows.columns], "keep_id", "group_size"]
    if groups.where("d_keep_n > 1").isEmpty():
        return joined.select(*columns, top.alias("kept"))
    tied = top & (F.col("d_keep_n") > 1)
    out = joined.where(~tied).select(*columns, top.alias("kept"))
    counted = joined.where(tied).groupBy(*columns).agg(F.count(F.lit(1)).alias("d_n"))
    chunks = counted.withColumn("d_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d_n") - 1, F.lit(CHUNK).cast("long"))))
    chunks = chunks.repartition("d_row", "d_first")  # the rows of a chunk are made where it went
    again = chunks.withColumn("d_i", F.explode(F.sequence("d_first", F.least(F.col("d_first") + CHUNK, "d_n") - 1)))
    return out.unionByName(again.select(*columns, (F.col("d_i") == 0).alias("kept")))


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """``docs`` plus keep_id (the id of the row that stays), group_size (long) and kept.

    ``keep``: ``smallest`` or ``largest`` id. ``digest`` may be any hash: texts
    that share one without being equal are told apart by their bytes.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    largest = keep == "largest"
    docs = docs.drop(*OUTPUTS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], digest(text).alias("d_key"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("d_row"))
    groups = materialize(_groups(rows, ["d_key"], id_col, largest), "exact-groups")

    repeated = groups.where("group_size > 1").select("d_key", "group_size")
    bytes_of = rows.select("d_key", text.alias("d_text"))
    texts = join_groups(bytes_of, repeated, ["d_key"], "group_size").groupBy("d_key", "d_text").agg(F.count(F.lit(1)).alias("n"))
    collided = materialize(texts.groupBy("d_key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("d_key"), "exact-collisions")
    if collided.isEmpty():
        return _decided(rows, groups, ["d_key"], id_col).select(*[F.col(f"`{c}`") for c in docs.columns], *OUTPUTS)

    one = groups.join(collided, "d_key", "left_anti")
    keys = ["d_key", "d_text"]
    of_group = groups.join(collided, "d_key").select("d_key", "group_size")
    mixed = join_groups(rows.withColumn("d_text", text), materialize(of_group, "exact-mixed"), ["d_key"], "group_size").drop("group_size")
    parts = materialize(_groups(mixed, keys, id_col, largest), "exact-parts")
    out = _decided(rows, materialize(one, "exact-single"), ["d_key"], id_col)
    out = out.unionByName(_decided(mixed, parts, keys, id_col).drop("d_text"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *OUTPUTS)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_dedup(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
    SELECT doc_id, first_value(doc_id) OVER same AS keep_id,
        CAST(count(*) OVER (PARTITION BY coalesce(text, '')) AS BIGINT) AS group_size,
        row_number() OVER same = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST)
"""
