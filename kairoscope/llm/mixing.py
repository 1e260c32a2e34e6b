"""Mixing sources to target weights (DataFrame functions only).

The documents of a source are scattered by a seeded hash into blocks, as many
as the documents to the power 2/3. A source is taken in full passes over all
its blocks and then in part: permuted blocks from the front, then of the block
in which the target falls the documents that fit, then the largest documents of
the source that still fit. So a source misses its target by less than the
smallest document that it leaves out.
Which output shard gets how many blocks of which source is drawn by a splitting
tree: each node divides its exact quotas between its two halves by a
multivariate hypergeometric draw (an urn emptied one block at a time), so every
shard gets its exact share of blocks and every source its exact total. Blocks
of a source are then dealt to the shards in their permuted order without
overlap, and the rows are shuffled where they are, by a seeded hash.

Defined results: a null text has size 0 and a null source is a source of its
own, last in order; rows with no words are taken with their block; documents
repeated in the input are repeated in the output, and any number of equal ones
spreads over all blocks of their source; very long texts move as they are; an
empty table gives an empty result; output columns replace input columns of
their name. The quotas of all sources are one row (a long for each source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, read_table
from .row_keys import keyed_rows

SEED = 80_021
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MAX_REPEATS = 3
#: Blocks of a source: its rows to this power, at every size.
BLOCKS_POWER = 2 / 3
WORD = r"[^\x20\x09-\x0D]+"

OUTPUTS = ("size", "source_size", "target", "copies", "shards")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes``: m_rank (place of the source from 1), m_size. Adds m_weight, m_target.

    Water filling: with sources in the order of cap / weight, the level is the
    largest of the levels got by capping the first k of them.
    """
    everything = W.partitionBy()
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = sizes.withColumn("m_weight", F.element_at(weights, (F.pmod(F.col("m_rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    ranked = ranked.withColumn("m_cap", F.col("m_size") * float(MAX_REPEATS))
    order = W.orderBy(F.col("m_cap") / F.col("m_weight"), "m_rank").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("m_size").over(everything) - F.coalesce(F.sum("m_cap").over(order), F.lit(0.0))) / (
        F.sum("m_weight").over(everything) - F.coalesce(F.sum("m_weight").over(order), F.lit(0.0))
    )
    ranked = ranked.withColumn("m_level", level)
    return ranked.withColumn(
        "m_target", F.least("m_cap", F.max("m_level").over(everything) * F.col("m_weight"))
    ).drop("m_level")


def split_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """``quotas``: m_rank, m_units. Returns m_rank, m_upto: for each shard the
    units of the source that go to it and the shards before it."""
    node = quotas.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("m_rank", "m_units"))), lambda x: x["m_units"]).alias("q")
    ).select(F.lit(0).alias("lo"), F.lit(n_shards).alias("n"), "q")
    depth = max(0, (n_shards - 1).bit_length())
    draw = f"""
        aggregate(sequence(1, size(q)),
            named_struct('all', total, 'left', CAST(total * half DIV n AS BIGINT), 'out', CAST(array() AS ARRAY<BIGINT>)),
            (s, k) -> named_struct(
                'all', s.all - q[k - 1],
                'left', s.left - {{x}},
                'out', concat(s.out, array({{x}}))),
            s -> s.out)
    """
    urn = f"""(CASE WHEN q[k - 1] = 0 THEN 0L ELSE aggregate(sequence(1L, q[k - 1]),
        named_struct('all', s.all, 'left', s.left, 'x', 0L),
        (u, i) -> CASE WHEN pmod(xxhash64({seed}L, lo, n, k, i), u.all) < u.left
            THEN named_struct('all', u.all - 1L, 'left', u.left - 1L, 'x', u.x + 1L)
            ELSE named_struct('all', u.all - 1L, 'left', u.left, 'x', u.x) END,
        u -> u.x) END)"""
    for _ in range(depth):
        node = node.withColumn("half", F.expr("CAST(n DIV 2 AS INT)")).withColumn(
            "total", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        )
        node = node.withColumn("l", F.expr(f"CASE WHEN n < 2 OR size(q) = 0 THEN q ELSE {draw.format(x=urn)} END"))
        node = node.select(
            F.explode(
                F.expr(
                    """CASE WHEN n < 2 THEN array(named_struct('lo', lo, 'n', n, 'q', q)) ELSE array(
                        named_struct('lo', lo, 'n', half, 'q', l),
                        named_struct('lo', lo + half, 'n', n - half, 'q', zip_with(q, l, (a, b) -> a - b))) END"""
                )
            ).alias("c")
        ).select("c.lo", "c.n", "c.q")
    leaves = node.select("lo", F.posexplode("q").alias("k", "units"))
    upto = W.partitionBy("k").orderBy("lo").rowsBetween(W.unboundedPreceding, 0)
    return (
        leaves.withColumn("upto", F.sum("units").over(upto))
        .groupBy((F.col("k") + 1).alias("m_rank"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("lo", "upto"))), lambda x: x["upto"]).alias("m_upto"))
    )


#: Parts of the rows of one source and size that are ranked apart before they are ranked together.
PICK_PARTS = 64


def fill(narrow: DataFrame, ordered: DataFrame) -> DataFrame:
    """The documents that make up what the whole blocks leave open of a source's target.

    First those of the cut block that fit in hash order, then over all other
    documents of the source the largest that fits, and so on until none does; what
    is left then is less than the smallest document not taken. That choice is made
    over the distinct sizes up to the open rest, so its state is bounded by the
    longest document. Returns m_rank, m_block, m_picks (key: how many of its rows)
    and m_cut_place.
    """
    cut = ordered.where("m_take = 'cut'").select(
        "m_rank", F.col("m_block").alias("m_cut_block"), F.col("m_place").alias("m_cut_place"), (F.col("m_part") - F.col("m_before")).alias("m_room")
    )
    cut = materialize(cut, "mix-cut")
    order = W.partitionBy("m_rank").orderBy("m_key")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    inside = narrow.join(cut, (narrow["m_rank"] == cut["m_rank"]) & (F.col("m_block") == F.col("m_cut_block"))).select(narrow["*"], "m_room")
    inside = inside.withColumn("m_fit", F.when(F.col("m_words") <= F.col("m_room"), F.col("m_words")))
    first = inside.withColumn("m_sum", F.sum("m_fit").over(upto)).where(F.col("m_fit").isNotNull() & (F.col("m_sum") <= F.col("m_room")))
    first = materialize(first.groupBy("m_rank", "m_block", "m_key", "m_words").agg(F.count(F.lit(1)).alias("m_n")), "mix-first")
    used = first.groupBy("m_rank").agg(F.sum(F.col("m_n") * F.col("m_words")).alias("m_used"))
    open_ = cut.join(used, "m_rank", "left").select("m_rank", (F.col("m_room") - F.coalesce("m_used", F.lit(0))).cast("double").alias("m_open"))
    other = ordered.where("m_take IN ('none', 'cut')").select("m_rank", "m_block")
    free = narrow.join(open_, "m_rank").where((F.col("m_words") > 0) & (F.col("m_words") <= F.col("m_open"))).join(other, ["m_rank", "m_block"])
    free = free.groupBy("m_rank", "m_block", "m_key", "m_words", "m_open").agg(F.count(F.lit(1)).alias("m_n"))
    taken = first.select("m_rank", "m_block", "m_key", F.col("m_n").alias("m_taken"))
    free = free.join(taken, ["m_rank", "m_block", "m_key"], "left").withColumn("m_n", F.col("m_n") - F.coalesce("m_taken", F.lit(0))).where("m_n > 0").drop("m_taken")
    free = materialize(free, "mix-free")
    sizes = free.groupBy("m_rank", "m_open", "m_words").agg(F.sum("m_n").alias("m_n"))
    greedy = """aggregate(m_sizes, named_struct('open', m_open, 'out', CAST(array() AS ARRAY<STRUCT<words: BIGINT, n: BIGINT>>)),
        (s, x) -> named_struct(
            'open', s.open - least(x.m_n, CAST(floor(s.open / x.m_words) AS BIGINT)) * x.m_words,
            'out', CASE WHEN x.m_words <= s.open THEN concat(s.out, array(named_struct('words', x.m_words, 'n', least(x.m_n, CAST(floor(s.open / x.m_words) AS BIGINT))))) ELSE s.out END),
        s -> s.out)"""
    falling = F.reverse(F.array_sort(F.collect_list(F.struct("m_words", "m_n"))))
    wanted = sizes.groupBy("m_rank", "m_open").agg(falling.alias("m_sizes")).select("m_rank", F.explode(F.expr(greedy)).alias("m"))
    wanted = wanted.select("m_rank", F.col("m.words").alias("m_words"), F.col("m.n").alias("m_wanted"))
    ranked = free.join(wanted, ["m_rank", "m_words"])
    for part in (F.pmod("m_key", F.lit(PICK_PARTS)), F.lit(0)):
        upto = W.partitionBy("m_rank", "m_words", part).orderBy("m_key").rowsBetween(W.unboundedPreceding, -1)
        ranked = ranked.withColumn("m_prior", F.coalesce(F.sum("m_n").over(upto), F.lit(0))).where("m_prior < m_wanted")
    second = ranked.select("m_rank", "m_block", "m_key", F.least("m_n", F.col("m_wanted") - F.col("m_prior")).alias("m_n"))
    picks = first.select("m_rank", "m_block", "m_key", "m_n").unionByName(second).groupBy("m_rank", "m_block", "m_key").agg(F.sum("m_n").alias("m_n"))
    picks = picks.groupBy("m_rank", "m_block").agg(F.map_from_entries(F.collect_list(F.struct("m_key", "m_n"))).alias("m_picks"))
    return picks.join(cut.select("m_rank", "m_cut_place"), "m_rank")


def plan_mix(
    docs: DataFrame,
    n_shards: int = 8,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
    block_rows: int | None = None,
) -> DataFrame:
    """``docs`` plus size, source_size, target, copies (int) and shards (the
    output shard of each copy). ``block_rows``: rows of a block, by default
    those that make BLOCKS_POWER."""
    docs = docs.drop(*[c for c in OUTPUTS if c in docs.columns])
    rows = keyed_rows(docs, seed, [id_col, text_col]).select(
        F.col("row").alias("m_row"), F.col(f"row.{source_col}").alias("m_source"), F.col("key").alias("m_key"), word_count(F.col(f"row.{text_col}")).alias("m_words")
    )
    counts = docs.groupBy(F.col(source_col).alias("c_source")).agg(F.count(F.lit(1)).alias("m_docs"))
    blocks_of = F.ceil(F.col("m_docs") / block_rows) if block_rows else F.ceil(F.pow("m_docs", F.lit(BLOCKS_POWER)) - 1e-6)
    counts = counts.select(
        "c_source", F.row_number().over(W.orderBy(F.col("c_source").asc_nulls_last())).alias("m_rank"), blocks_of.cast("long").alias("m_blocks")
    )
    counts = materialize(counts, "mix-sources")
    in_block = lambda df: df.join(counts, F.col("m_source").eqNullSafe(F.col("c_source"))).withColumn("m_block", F.pmod("m_key", "m_blocks"))
    narrow = materialize(in_block(rows.drop("m_row")).select("m_rank", "m_block", "m_key", "m_words"), "mix-words")
    blocks = materialize(narrow.groupBy("m_rank", "m_block").agg(F.sum("m_words").alias("m_words")), "mix-blocks")
    targets = source_targets(blocks.groupBy("m_rank").agg(F.sum("m_words").alias("m_size")))
    whole = F.when(F.col("m_size") > 0, F.least(F.floor(F.col("m_target") / F.col("m_size")), F.lit(MAX_REPEATS))).otherwise(0)
    targets = targets.withColumn("m_whole", whole.cast("int")).withColumn(
        "m_part", F.col("m_target") - F.col("m_whole") * F.col("m_size")
    )
    order = W.partitionBy("m_rank").orderBy(F.xxhash64(F.lit(seed), F.lit("block"), F.col("m_rank"), F.col("m_block")), "m_block")
    ordered = (
        blocks.join(targets.select("m_rank", "m_size", "m_target", "m_whole", "m_part"), "m_rank")
        .withColumn("m_place", F.row_number().over(order) - 1)
        .withColumn("m_upto_words", F.sum("m_words").over(order))
        .withColumn("m_before", F.col("m_upto_words") - F.col("m_words"))
        .withColumn(
            "m_take",
            F.when(F.col("m_part") <= 0, "none").when(F.col("m_upto_words") <= F.col("m_part"), "all").when(F.col("m_before") < F.col("m_part"), "cut").otherwise("none"),
        )
    )
    quotas = ordered.groupBy("m_rank").agg(
        F.sum(F.col("m_whole") + F.when(F.col("m_take") == "none", 0).otherwise(1)).cast("long").alias("m_units")
    )
    ordered = materialize(ordered, "mix-ordered")
    filled = fill(narrow, ordered)
    dealt = (
        ordered.join(split_quotas(quotas, n_shards, seed), "m_rank")
        .join(filled, ["m_rank", "m_block"], "left")
        .select("m_rank", "m_block", "m_size", "m_target", "m_take", "m_whole", "m_place", "m_upto", "m_picks", "m_cut_place")
    )
    placed = in_block(rows).join(dealt, ["m_rank", "m_block"])
    #: Rows move once: the join above and this window share their partitioning.
    alike = W.partitionBy("m_rank", "m_block", "m_key").orderBy(F.xxhash64("m_row"), F.col(f"m_row.{id_col}"), F.col(f"m_row.{text_col}"))
    picked = F.coalesce(F.row_number().over(alike) <= F.element_at("m_picks", F.col("m_key")), F.lit(False))
    more = F.when((F.col("m_take") == "all") | picked, 1).otherwise(0)
    #: The units of a source are numbered by pass and place; all picks make up the unit of the cut block.
    shards = F.expr(
        """transform(concat(
                transform(slice(sequence(0, 3), 1, m_whole), p -> p * m_blocks + m_place),
                CASE WHEN m_more = 1 THEN array(m_whole * m_blocks + CASE WHEN m_take = 'all' THEN m_place ELSE m_cut_place END) ELSE array() END),
            at -> size(filter(m_upto, u -> u <= at)))"""
    )
    return placed.withColumn("m_more", more).select(
        "m_row.*",
        F.col("m_words").alias("size"),
        F.col("m_size").alias("source_size"),
        F.col("m_target").alias("target"),
        (F.col("m_whole") + F.col("m_more")).cast("int").alias("copies"),
        shards.alias("shards"),
    )


def mix(docs: DataFrame, n_shards: int = 8, *, seed: int = SEED, **options) -> DataFrame:
    """The mixture: a row of ``docs`` for each copy, with ``mix_shard``, ``mix_copy``
    and ``mix_order``, the key by which the rows of a shard are shuffled in each task."""
    plan = plan_mix(docs, n_shards, seed=seed, **options)
    kept = [c for c in docs.columns if c not in OUTPUTS]
    id_col = options.get("id_col", "doc_id")
    rows = plan.select(*[F.col(f"`{c}`") for c in kept], F.posexplode("shards").alias("mix_copy", "mix_shard"))
    rows = rows.withColumn("mix_order", F.xxhash64(F.lit(seed), F.lit("order"), F.col(id_col), F.col("mix_copy")))
    return rows.sortWithinPartitions("mix_shard", "mix_order")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan_mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "shards"
    )
