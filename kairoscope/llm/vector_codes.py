"""Vector codes: integer product quantization with partial-distance search.

Vectors become integers, floor(scale * x), and are cut into equal consecutive
parts, each with a codebook of its own. A round assigns the parts to their
nearest entries in the tasks, where their sums and counts are made too; Spark
adds these up by part, entry and position, and only the codebooks (entries
times dimensions numbers) pass through the driver. Sums are carried in limbs of
30 bits, so they are exact at every size.

The search goes through the dimensions of a part in descending order of their
variance in the codebook. Entries are taken in order; a vector drops an entry
as soon as the distance got so far strictly exceeds the best complete one, by
masks over the whole batch. Ties stay with the lower index.

Defined results: a vector that is null, empty or holds a null or a non-finite
component is dropped, and so is one whose length is not that of the first kept
vector (by id, null ids last, ties by components); where the length is no
multiple of the parts, part p goes from floor(p * length / parts). Of rows with equal
ids each is a vector. With fewer vectors than entries the codebook is shorter.
Components too large for 64-bit distances are worked with as Python integers;
an error that does not fit a long is null. An empty table gives an empty
result. Columns named like an output column are replaced, all others are kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialize, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers up to this size have 64-bit distances.
SMALL = 1 << 24
LIMB = 30
#: Vectors that are searched together.
BATCH = 8192
OUTPUTS = ("code", "error")

Codebooks = list[np.ndarray]


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    return [(p * length // parts, (p + 1) * length // parts) for p in range(parts)]


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as longs or, where these could overflow, as Python integers."""
    if np.abs(x).max(initial=0.0) * scale < SMALL:
        return np.floor(x * scale).astype(np.int64)
    return np.frompyfunc(lambda v: math.floor(Fraction(v) * scale), 1, 1)(x)


def spread_order(book: np.ndarray) -> np.ndarray:
    """Dimensions of a codebook by descending variance, ties in their order."""
    exact = book.astype(object)
    spread = len(book) * (exact * exact).sum(axis=0) - exact.sum(axis=0) ** 2
    return np.array(sorted(range(book.shape[1]), key=lambda d: (-spread[d], d)), int)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry of ``book`` for each row of ``part``, and its squared distance."""
    if part.dtype != book.dtype:
        part, book = part.astype(object), book.astype(object)
    order = spread_order(book)
    part, book = np.ascontiguousarray(part[:, order].T), book[:, order]
    n = part.shape[1]
    best = np.zeros(n, part.dtype)
    for d in range(len(part)):
        best += (part[d] - book[0, d]) ** 2
    index = np.zeros(n, np.int64)
    for e in range(1, len(book)):
        alive, far = np.arange(n), np.zeros(n, part.dtype)
        for d in range(len(part)):
            far = far + (part[d][alive] - book[e, d]) ** 2
            keep = far <= best[alive]
            alive, far = alive[keep], far[keep]
            if not len(alive):
                break
        nearer = far < best[alive]
        best[alive[nearer]], index[alive[nearer]] = far[nearer], e
    return index, best


def _vectors(batch: pa.RecordBatch, column: str, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of integer vectors of a batch, each with the place of its first row."""
    for start in range(0, batch.num_rows, BATCH):
        cell = batch.column(column).slice(start, BATCH)
        yield start, integers(cell.flatten().to_numpy(zero_copy_only=False).reshape(len(cell), -1), scale)


def _limbs(total: int, n: int) -> list[int]:
    """``total`` in ``n`` limbs of LIMB bits, the last one signed and of any size."""
    out = []
    for _ in range(n - 1):
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def _rounded(vectors: DataFrame, books: Codebooks, scale: int, n_limbs: int) -> Codebooks:
    """One round: parts go to their nearest entries, entries become the floor of their parts' mean."""
    length = sum(b.shape[1] for b in books)
    spans = cuts(length, len(books))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.shape, object) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, x in _vectors(batch, "q_vector", scale):
                for p, (lo, hi) in enumerate(spans):
                    index, _ = nearest(x[:, lo:hi], books[p])
                    got = np.zeros(books[p].shape, x.dtype)
                    np.add.at(got, index, x[:, lo:hi])
                    total[p] += got
                    count[p] += np.bincount(index, minlength=len(books[p]))
        rows = [
            (p, e, d, int(count[p][e]), *_limbs(int(total[p][e, d]), n_limbs))
            for p, b in enumerate(books) for e in range(len(b)) if count[p][e] for d in range(b.shape[1])
        ]
        names = ["part", "entry", "place", "n", *[f"l{i}" for i in range(n_limbs)]]
        kinds = [pa.int32()] * 3 + [pa.int64()] * (n_limbs + 1)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    limbs = [f"l{i}" for i in range(n_limbs)]
    schema = "part int, entry int, place int, n long, " + ", ".join(f"{x} long" for x in limbs)
    made = vectors.mapInArrow(sums, schema).groupBy("part", "entry", "place")
    made = made.agg(F.sum("n").alias("n"), *[F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in limbs])
    new = [b.astype(object) for b in books]
    for row in made.collect():  # at most entries times dimensions rows
        total = sum(int(row[x]) << (LIMB * i) for i, x in enumerate(limbs))
        new[row["part"]][row["entry"], row["place"]] = total // row["n"]
    return [_narrow(b) for b in new]


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(int(v)) <= SMALL for v in book.flat) else book.astype(object)


def kept_vectors(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``df`` without null, empty or non-finite vectors, plus ``q_vector`` (array of doubles)."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(vector_col).isNotNull()).where(F.size(vector) > 0).where(finite).withColumn("q_vector", vector)


def train(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks | None:
    """A codebook for each part, or None where no vector is kept."""
    vectors = kept_vectors(df, vector_col).select(F.col(id_col).alias("q_id"), "q_vector")
    order = [F.col("q_id").asc_nulls_last(), "q_vector"]
    first = vectors.orderBy(*order).first()
    if first is None:
        return None
    length = len(first["q_vector"])
    vectors = vectors.where(F.size("q_vector") == length)
    start = [r["q_vector"] for r in vectors.orderBy(*order).limit(entries).collect()]
    ints = integers(np.array(start, np.float64), scale)
    books = [_narrow(ints[:, lo:hi].copy()) for lo, hi in cuts(length, parts)]
    top = vectors.agg(F.max(F.array_max(F.transform("q_vector", F.abs)))).first()[0]
    n_limbs = 2 + -(-math.ceil(Fraction(top) * scale).bit_length() // LIMB)  # two more hold sums of 2**60 rows
    for _ in range(rounds):
        books = _rounded(vectors.select("q_vector"), books, scale, n_limbs)
    return books


def encode(df: DataFrame, books: Codebooks, *, vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The kept rows of ``df`` plus ``code`` (two hex digits for each part) and ``error`` (long)."""
    length = sum(b.shape[1] for b in books)
    spans = cuts(length, len(books))
    rows = kept_vectors(df.drop(*OUTPUTS, "q_vector"), vector_col).where(F.size("q_vector") == length)
    schema = rows.drop("q_vector").schema.add("code", "string").add("error", "long")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = [], []
            for _, x in _vectors(batch, "q_vector", scale):
                at, far = zip(*[nearest(x[:, lo:hi], b) for (lo, hi), b in zip(spans, books, strict=True)], strict=True)
                digits = np.stack(at, axis=1).astype(np.uint8)
                code += [row.tobytes().hex() for row in digits]
                error += [e if e < 1 << 63 else None for e in (sum(int(f[i]) for f in far) for i in range(len(x)))]
            kept = [i for i, name in enumerate(batch.schema.names) if name != "q_vector"]
            columns = [batch.column(i) for i in kept]
            names = [batch.schema.names[i] for i in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[*names, "code", "error"])

    return rows.mapInArrow(codes, schema)


def codebooks_text(books: Codebooks) -> str:
    """All integers of the entries by part, entry and position."""
    return ",".join(str(int(v)) for b in books for v in b.flat)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = train(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialize(encode(vectors, books).select("vec_id", "label", "code", "error"), "vector-codes")
    #: A label and whether it is null: keys that are never null.
    coded = coded.select("vec_id", "code", "error", F.coalesce("label", F.lit(0)).alias("label"), F.col("label").isNull().alias("unlabelled"))
    keys = ["label", "unlabelled"]
    labels = materialize(coded.groupBy(*keys).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "vector-labels")
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return join_groups(coded, labels, keys, "rows").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    finite = "embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"
    out = [
        f"vecs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings WHERE {finite})",
        f"""ints AS MATERIALIZED (SELECT r, CAST(i AS INTEGER) AS place, CAST(i * {PARTS} // len(embedding) AS INTEGER) AS part,
            CAST(floor({SCALE} * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT r, embedding, unnest(range(len(embedding))) AS i FROM vecs))""",
        f"book0 AS MATERIALIZED (SELECT part, place, CAST(r - 1 AS INTEGER) AS entry, v FROM ints WHERE r <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        out.append(
            f"""near{k} AS MATERIALIZED (SELECT r, part, arg_min(entry, far * {ENTRIES} + entry) AS entry, min(far) AS far
                FROM (SELECT r, part, entry, sum((i.v - b.v) * (i.v - b.v)) AS far FROM ints i JOIN book{k} b USING (part, place) GROUP BY ALL) GROUP BY r, part)"""
        )
        if k < ROUNDS:
            out.append(
                f"""book{k + 1} AS MATERIALIZED (SELECT part, place, entry, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), v) AS v FROM book{k} LEFT JOIN (
                    SELECT part, place, entry, sum(v) AS s, count(*) AS n FROM ints JOIN near{k} USING (r, part) GROUP BY ALL) USING (part, place, entry))"""
            )
    return f"""WITH {", ".join(out)}, coded AS (
            SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book{ROUNDS}) AS codebooks_sha256
        FROM coded JOIN vecs USING (r)"""


ORACLE_SQL = _oracle()
