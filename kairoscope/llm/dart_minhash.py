"""Near-duplicates by DartMinHash signatures over weighted five-word shingles.

Every element (shingle) owns a region of the plane weight x rank into which
darts are thrown: the region is cut into cells (weights 0..1, 1..3, 3..7, ...
by ranks 0..1/128, 1/128..1/64, ...), the number of darts of a cell is Poisson
with the cell's area, and everything about a dart is a hash of (element, cell,
number). A document sees the darts of its elements that lie below the elements'
weights; each dart belongs to one of ``COORDS`` coordinates, and a coordinate
keeps the dart of the earliest rank. Ranks are searched ring by ring until all
coordinates are filled, so a document costs about COORDS * ln(COORDS) darts
whatever its length. Two documents agree in a coordinate with the probability
of their weighted Jaccard similarity.

Signatures are joined by bands. Equal texts are collapsed first. A bucket of up
to ``SMALL`` texts gives all its pairs, a larger one the pairs of each text
with four centres, so no group is expanded quadratically. Each pair is verified
on the whole texts, and the links are closed to classes.

A second round makes classes exact over all pairs that share a bucket. In a
large bucket only pairs of different classes can still change a class, and one
of the two is outside the bucket's largest class. Those pairs are formed unless
they cannot be links. The shingles that a text has in common with no other text
of such buckets bound its similarity to any of them, which drops most texts
before pairs are formed, and the similarity of a pair; so do the counts of
shingles by hash, which overlap at least as much as the texts; and as 1 - similarity is
a metric, two texts whose similarities to a centre differ too much are no link.

Defined results: weights are the shingle counts; a text of one to four words is
one shingle; null texts and texts without words are classes of their own;
texts are told apart by their content, so rows of one id and different texts have
the classes of their texts, and rows without an id are compared like all others
(the class of texts that only such rows have is null); very long texts are compared
whole; columns other than doc_id and text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table
from .text_hash import BITS, MASK, U, batches, mix, shingles

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5
COORDS = BANDS * ROWS
SMALL = 8
#: Members of a part of a large bucket in the second round.
PART = 4096
CENTRES = 4
#: Counters of shingles by hash in the sketch that bounds a pair's overlap.
BINS = 128
FIRST_RANK = 1 / 128
_NONE = np.iinfo(np.uint64).max
_poisson: dict[float, np.ndarray] = {}


def poisson_cdf(area: float) -> np.ndarray:
    if area not in _poisson:
        k = np.arange(int(area + 12 * math.sqrt(area) + 30))
        logs = k * math.log(area) - area - np.array([math.lgamma(x + 1) for x in k])
        _poisson[area] = np.cumsum(np.exp(logs))
    return _poisson[area]


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text its total weight and COORDS values (all _NONE without words)."""
    keys, counts = shingles(texts, SHINGLE)
    doc = (keys >> U(BITS)).astype(np.int64)
    element = keys & MASK
    total = np.bincount(doc, counts, len(texts)).astype(np.int64)
    sig = np.full(len(texts) * COORDS, _NONE, U)
    ring, low, high = 0, 0.0, FIRST_RANK
    while len(doc):
        level, width = 0, 1
        d, e, w = doc, element, counts
        while len(d):
            _throw(sig, d, e, w, level, width, ring, low, high)
            level, width = level + 1, width * 2
            more = w > width - 1
            d, e, w = d[more], e[more], w[more]
        open_ = (sig.reshape(-1, COORDS) == _NONE).any(axis=1)[doc]
        doc, element, counts = doc[open_], element[open_], counts[open_]
        ring, low, high = ring + 1, high, high * 2
    return total, sig.reshape(-1, COORDS)


def _throw(sig, doc, element, weight, level, width, ring, low, high) -> None:
    """The darts of one cell of each element: weights from width - 1 to 2 * width - 1."""
    cell = mix(element * U(0xA24BAED4963EE407) + U((ring * 64 + level + 1) * 0x9FB21C651E98DF25 % (1 << 64)))
    cdf = poisson_cdf(width * (high - low))
    n = np.searchsorted(cdf, (cell >> U(11)).astype(np.float64) * 2.0**-53, "right")
    some = np.flatnonzero(n)
    if not len(some):
        return
    n = n[some]
    who = np.repeat(some, n)
    number = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    dart = mix(cell[who] + (number + 1).astype(U) * U(0xD1342543DE82EF95))
    place = mix(dart ^ U(0x2545F4914F6CDD1D))
    rank = low + (high - low) * ((place >> U(11)).astype(np.float64) * 2.0**-53)
    if level:
        at = width - 1 + width * (mix(place + U(1)) >> U(11)).astype(np.float64) * 2.0**-53
        hit = at < weight[who]
        who, dart, rank = who[hit], dart[hit], rank[hit]
    value = ((rank * 2.0**30).astype(U) << U(22)) | (dart & U((1 << 22) - 1))
    np.minimum.at(sig, doc[who] * COORDS + ((dart >> U(24)) % U(COORDS)).astype(np.int64), value)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """A hash of each band's number and values."""
    parts = sig.reshape(-1, BANDS, ROWS)
    h = np.broadcast_to(mix(np.arange(1, BANDS + 1).astype(U)), parts.shape[:2])
    for k in range(ROWS):
        h = mix(h * U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h.view(np.int64)


def similarity(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle counts of a[i] and b[i]."""
    ka, ca = shingles(a, SHINGLE)
    kb, cb = shingles(b, SHINGLE)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.bincount((ka[ia] >> U(BITS)).astype(np.int64), np.minimum(ca[ia], cb[ib]), len(a))
    every = np.bincount((ka >> U(BITS)).astype(np.int64), ca, len(a)) + np.bincount((kb >> U(BITS)).astype(np.int64), cb, len(a)) - both
    return np.divide(both, every, out=np.zeros(len(a)), where=every > 0)


def _sign(text: Column) -> Column:
    @F.pandas_udf("total long, bands array<long>")
    def sign(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [t.encode("utf-8", "surrogatepass") for t in part]
            totals, bands = [], []
            for s, e in batches(texts):
                total, sig = signatures(texts[s:e])
                totals.append(total)
                bands += list(band_hashes(sig))
            yield pd.DataFrame({"total": np.concatenate(totals) if totals else [], "bands": bands})

    return sign(text)


def _similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = ([t.encode("utf-8", "surrogatepass") for t in s] for s in (a, b))
        out = [similarity(x[s:e], y[s:e]) for s, e in batches(x)]
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return compare(a, b)


def bucket_members(distinct: DataFrame) -> DataFrame:
    """``distinct``: id, r (a hash of the text), bands. The members of buckets of two texts or more: h, n (texts of the bucket), id, r."""
    spread = distinct.select("id", "r", F.explode("bands").alias("h"))
    counts = spread.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return spread.join(counts, "h").select("h", "n", "id", "r")


def with_centres(large: DataFrame) -> DataFrame:
    """``large`` with the centres of each bucket, four texts at most, chosen by hashes."""
    centre = lambda k: F.min_by("id", F.struct(F.xxhash64(F.lit(k), "r"), "r"))
    centres = large.groupBy("h").agg(F.array_distinct(F.array(*[centre(k) for k in range(CENTRES)])).alias("centres"))
    return large.join(materialize(centres, "dart-centres"), "h")  # written, so that a hot bucket can be split


def candidate_pairs(small: DataFrame, large: DataFrame) -> DataFrame:
    """Distinct pairs a < b of the first round."""
    star = large.select("id", F.explode("centres").alias("other"))
    every = (
        small.groupBy("h").agg(F.collect_set("id").alias("ids"))
        .select(F.explode("ids").alias("id"), "ids").select("id", F.explode("ids").alias("other")).where("id < other")
    )
    return star.where("id <> other").unionByName(every).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def mixed_members(large: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of large buckets that hold several classes, with their class
    and whether it is the largest of the bucket."""
    classed = large.join(labels, "id", "left").withColumn("class", F.coalesce("label", "id")).drop("label")
    sizes = classed.groupBy("h", "class").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("h").agg(F.max_by("class", F.struct("k", "class")).alias("largest"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    return classed.join(largest, "h").withColumn("most", F.col("class") == F.col("largest")).drop("largest", "classes")


def shared_weights(texts: DataFrame) -> DataFrame:
    """``texts``: id (distinct), text. Returns id, total (weight of the text),
    shared (weight of its shingles that another of the texts has too) and bins
    (weight of its shingles by hash)."""

    @F.pandas_udf("es array<long>, cs array<long>, total long, bins array<int>")
    def elements(part: pd.Series) -> pd.DataFrame:
        texts, out = [t.encode("utf-8", "surrogatepass") for t in part], []
        for s, e in batches(texts):
            keys, counts = shingles(texts[s:e], SHINGLE)
            at = np.searchsorted(keys >> U(BITS), np.arange(e - s + 1).astype(U))
            hashes = (keys & MASK).astype(np.int64)
            for a, b in zip(at[:-1], at[1:], strict=True):
                bins = np.bincount(hashes[a:b] % BINS, counts[a:b], BINS).astype(np.int32)
                out.append((hashes[a:b], counts[a:b], int(counts[a:b].sum()), bins))
        return pd.DataFrame(out, columns=["es", "cs", "total", "bins"])

    found = materialize(texts.select("id", elements("text").alias("s")).select("id", "s.*"), "dart-elements")
    flat = found.select("id", F.inline(F.arrays_zip("es", "cs"))).withColumnsRenamed({"es": "e", "cs": "c"})
    solo = flat.groupBy("e").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id"), F.min("c").alias("c")).where("k = 1")
    solo = solo.groupBy("id").agg(F.sum("c").alias("solo"))
    return found.join(solo, "id", "left").select("id", "total", (F.col("total") - F.coalesce("solo", F.lit(0))).alias("shared"), "bins")


def cross_pairs(mixed: DataFrame, verified: DataFrame, similar: float) -> DataFrame:
    """Pairs a < b of different classes in one bucket of ``mixed`` that may be
    links and are not in ``verified`` (a, b, j: all pairs with centres). ``mixed``
    has total, shared and bins of each member.

    A bucket is cut to parts of about ``PART`` members, so that a hot one spreads.
    """
    mixed = mixed.where(F.col("shared") >= F.col("total") * similar - 1e-6)  # the others have no link here
    key = [F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")]
    spread = mixed.select("h", "id", F.explode("centres").alias("centre"))
    near = spread.select("*", *key).join(verified, ["a", "b"], "left")
    near = near.groupBy("h", "id").agg(F.array_sort(F.collect_set(F.struct("centre", F.coalesce("j", F.lit(1.0)).alias("j")))).alias("near"))
    mixed = mixed.join(near, ["h", "id"]).withColumn("parts", F.ceil(F.col("n") / PART))
    one = mixed.where(~F.col("most")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    every = mixed.withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    cols = lambda df, x: df.select("h", "part", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "class", "total", "shared", "bins", "most", "near")])
    joined = cols(one, "x").join(cols(every, "y"), ["h", "part"]).where("x_class <> y_class and (y_most or x_id < y_id)")
    both = F.least("x_shared", "y_shared")
    every_weight = F.col("x_total") + F.col("y_total")
    weights = both >= (every_weight - both) * similar - 1e-6
    overlap = F.aggregate(F.zip_with("x_bins", "y_bins", lambda p, q: F.least(p, q)), F.lit(0).cast("long"), lambda n, k: n + k)
    alike = overlap * (1 + similar) >= every_weight * similar - 1e-6
    apart = F.exists(F.zip_with("x_near", "y_near", lambda p, q: F.abs(p["j"] - q["j"])), lambda d: d > 1 - similar + 1e-9)
    return (
        joined.where(weights & ~apart & alike).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
        .join(verified, ["a", "b"], "left_anti")
    )


def components(edges: DataFrame, name: str) -> DataFrame:
    """``edges``: a, b. Returns id and label, the least id of its component.

    Each id points to the least of its neighbours and itself; pointers are followed
    to their roots, and the edges between different roots make the next, smaller
    graph. Roots at least halve each time, and each round is written to the
    shared folder.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        up = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{name}-up")
        while True:
            to = up.select(F.col("id").alias("label"), F.col("label").alias("to"))
            jumped = materialize(up.join(to, "label").select("id", F.col("label").alias("old"), F.col("to").alias("label")), f"{name}-up")
            up = jumped.select("id", "label")
            if jumped.where("label <> old").isEmpty():
                break
        to = up.select(F.col("id").alias("label"), F.col("label").alias("to"))
        labels = up if labels is None else materialize(labels.join(to, "label", "left").select("id", F.coalesce("to", "label").alias("label")), f"{name}-labels")
        root = lambda c: up.select(F.col("id").alias(c), F.col("label").alias(f"root_{c}"))  # noqa: E731, B023
        between = edges.join(root("a"), "a").join(root("b"), "b").where("root_a <> root_b")
        edges = materialize(between.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), f"{name}-edges")
        if edges.isEmpty():
            return labels


def merge_classes(labels: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """``labels`` (id, label) after the further links ``more`` (a, b). Only the
    links between classes are followed, not those inside them."""
    classed = more
    for end in ("a", "b"):
        known = labels.select(F.col("id").alias(end), F.col("label").alias(f"class_{end}"))
        classed = classed.join(known, end, "left").withColumn(f"class_{end}", F.coalesce(f"class_{end}", end))
    classed = materialize(classed, f"{name}-classed")
    merged = components(classed.where("class_a <> class_b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")), f"{name}-classes")
    ends = classed.select(F.col("a").alias("id"), F.col("class_a").alias("label")).union(classed.select("b", "class_b"))
    every = labels.union(ends).distinct()
    to = merged.select(F.col("id").alias("label"), F.col("label").alias("to"))
    return materialize(every.join(to, "label", "left").select("id", F.coalesce("to", "label").alias("label")), f"{name}-labels")


def content(text: Column) -> Column:
    """What texts are told apart by."""
    return F.unhex(F.md5(text.cast("binary")))


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def classify(docs: DataFrame, *, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """``docs``: doc_id, text, one row for each row with words: doc_id, content.
    Texts: a row for each distinct text: content, one (its least doc_id),
    class_id, n_links (verified pairs) and first: whether it is the text of the
    least id of its class (then of the least content)."""
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(has_words(F.col("text")))
    signed = materialize(full.select("doc_id", content(F.col("text")).alias("content"), _sign(F.col("text")).alias("s")).select("doc_id", "content", "s.bands"), "dart-signed")
    distinct = signed.groupBy("content", "bands").agg(F.min("doc_id").alias("one"))
    #: The numbers hold once they are written; nothing but the order of a pair depends on them.
    distinct = materialize(distinct.select(F.monotonically_increasing_id().alias("id"), F.xxhash64("content").alias("r"), "content", "one", "bands"), "dart-distinct")
    members = materialize(bucket_members(distinct.select("id", "r", "bands")), "dart-members")
    large = with_centres(members.where(F.col("n") > SMALL)).drop("r")
    pairs = materialize(candidate_pairs(members.where(F.col("n") <= SMALL), large), "dart-pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(distinct.select("id", F.col("content").alias("w_content"), "one"), "id")
    # the texts grow with the corpus, so this join is a shuffle at every size; with the id in the key copies stay spread
    same = (content(F.col("text")) == F.col("w_content")) & F.col("doc_id").eqNullSafe(F.col("one"))
    texts = materialize(full.join(wanted.hint("merge"), same).groupBy("id").agg(F.first("text").alias("text")), "dart-texts")
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    compare = lambda p: p.join(side("a"), "a").join(side("b"), "b").select("a", "b", _similarity(F.col("text_a"), F.col("text_b")).alias("j"))
    verified = materialize(compare(pairs), "dart-verified")
    edges = verified.where(F.col("j") >= similar).select("a", "b")
    labels = components(edges, "dart")
    mixed = materialize(mixed_members(large, labels), "dart-mixed")
    if not mixed.isEmpty():
        weights = materialize(shared_weights(texts.join(mixed.select("id").distinct().hint("merge"), "id", "left_semi")), "dart-weights")
        more = compare(materialize(cross_pairs(mixed.join(weights, "id"), verified, similar), "dart-cross")).where(F.col("j") >= similar)
        more = materialize(more.select("a", "b"), "dart-more")
        if not more.isEmpty():
            edges = edges.union(more)
            labels = merge_classes(labels, more, "dart")
    links = edges.select("a").union(edges.select("b")).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_links"))
    linked = labels.join(distinct.select("id", "one", "content"), "id").join(links, "id")
    least = linked.groupBy("label").agg(F.min(F.struct(F.col("one").isNull().alias("none"), "one", "content")).alias("least"))
    linked = linked.join(least, "label").select(
        "id", "n_links", F.col("least.one").alias("class_id"), (F.col("content") == F.col("least.content")).alias("first")
    )
    texts = distinct.select("id", "content", "one").join(linked, "id", "left").select(
        "content", "one", F.when(F.col("first").isNull(), F.col("one")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("first", F.lit(True)).alias("first"),
    )
    return signed.select("doc_id", "content"), texts


def near_duplicates(docs: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (least id of the class), n_links (verified pairs of the
    text), one row for each row of ``docs`` (doc_id, text)."""
    rows, texts = classify(docs, similar=similar)
    found = rows.join(texts, "content").select("doc_id", "class_id", "n_links")
    doc_id = F.col("doc_id").cast("long")
    rest = docs.where(~has_words(F.col("text"))).select(doc_id.alias("doc_id"), doc_id.alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(rest)


def one_of_each(docs: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` less all rows but one of each class.

    The row that stays has the class's least id and, of the texts of that id in
    the class, the least content; of rows equal in both one stays, chosen by a
    hash of all columns. Rows without words stay.
    """
    rows, texts = classify(docs.select("doc_id", "text"), similar=similar)
    own = rows.join(texts, "content").withColumn("keep", F.col("first") & F.col("doc_id").eqNullSafe(F.col("one")))
    own = own.groupBy("content", F.col("doc_id").alias("d_id")).agg(F.first("keep").alias("keep"), F.count(F.lit(1)).alias("n"))
    own = materialize(own.where("not keep or n > 1").withColumnRenamed("content", "d_content"), "dart-odd")
    odd = own.drop("keep", "n")
    repeated = materialize(own.where("keep").drop("keep", "n"), "dart-repeated")
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("k_id"), content(F.col("text")).alias("k_content"))
    same = (F.col("k_content") == F.col("d_content")) & F.col("k_id").eqNullSafe(F.col("d_id"))
    # what is dropped grows with the corpus, so this join is a shuffle at every size
    alone = keyed.join(odd.hint("merge"), same, "left_anti").select("row.*")
    if repeated.isEmpty():
        return alone
    repeated = keyed.join(repeated, same).groupBy("k_content", "k_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return alone.unionByName(repeated.select("row.*"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
