"""Collocations: phrases whose words belong together, by counts of all n-grams.

Tasks gather documents into shards of one language and a bounded number of
words. A shard gives its words ids of its own and sorts its suffixes by prefix
doubling in numpy, until they are in order by as many words as the longest
phrase. Neighbours in that order give the LCP array, and its intervals the
n-grams of the shard with their counts. These go out packed: one row for each
shard and bucket of keys. A key is the 64-bit hashes of the phrase's words, so
Spark adds the counts up by key, and words are spelled out for the phrases that
remain. If two words of the corpus share a hash, another seed is taken, so keys
are exact.

Counts of parts, containment and ranks are joins, groups and windows of the
phrases that are frequent enough. Scores are whole numbers in decimals of 38
digits, which holds counts up to 10**15.

Defined results: a null text is empty, a null language is ``und``; empty texts
and pieces without words give nothing; a document of more words than a shard is
a shard of its own, so a very long text costs memory in proportion; repeated
rows count as often as they occur; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, read_table
from .text_hash import U, mix, powers
from .text_hash import batches as text_batches

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
#: A longer phrase with this share of the occurrences (in percent) replaces the phrases in it.
COVERED_PERCENT = 50
SCALE = 1_000_000
#: Words of a shard.
SHARD_WORDS = 1 << 20
#: Text bytes for each partition of the merge.
MERGE_BYTES = 8 << 20
#: Phrases of one task of the first ranking.
RANK_ROWS = 200_000
#: Frequent first words are spread over so many buckets.
SPREAD = U(64)

# White space inside pieces, and what ends a piece.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?\n\x0b\x0c\r")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def tokens(texts: list[bytes], *seeds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The lower-cased bytes of all texts; start and end of each word, the number of its piece, and its hash by each seed."""
    raw = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    stop = _STOP[raw]
    edge = np.flatnonzero(np.diff((stop | _SPACE[raw]).astype(np.int8), prepend=1))
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    hashes = []
    for seed in seeds:
        value = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, U)
        total = np.zeros(len(raw) + 1, U)
        np.cumsum(value[raw] * up[:-1], out=total[1:])
        hashes.append(np.maximum(mix((total[end] - total[start]) * down[start]), U(1)))  # 0 stands for no word
    return raw, start, end, np.cumsum(stop)[start], hashes


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` (from 0) sorted by the ``depth`` ids that follow, by prefix doubling."""
    n = len(ids)
    rank = ids.astype(np.int64) + 1
    order, known = np.argsort(rank, kind="stable"), 1
    while known < depth:
        after = np.zeros(n, np.int64)
        after[: n - known] = rank[known:]
        key = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[1], np.diff(key[order]) != 0]).astype(np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        known *= 2
    return order


def phrase_counts(word: np.ndarray, piece: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length up to ``longest``: the places where each phrase occurs first in suffix order, and its count."""
    if not len(word):
        return
    _, ids = np.unique(word, return_inverse=True)
    # a piece ends with id 0, which no phrase holds
    ends = np.flatnonzero(np.diff(piece)) + 1
    stream = np.insert(ids + 1, np.append(ends, len(ids)), 0)
    place = np.insert(np.arange(len(ids)), np.append(ends, len(ids)), -1)
    order = suffix_order(stream, longest)
    padded = np.concatenate([stream, np.zeros(longest, stream.dtype)])
    words_left = np.zeros(len(order), np.int64)
    lcp = np.zeros(len(order), np.int64)
    whole, equal = np.ones(len(order), bool), np.ones(len(order), bool)
    for k in range(longest):
        here = padded[order + k]
        whole &= here > 0
        equal[1:] &= whole[1:] & (here[1:] == here[:-1])
        equal[0] = False
        words_left += whole
        lcp += equal
    for n in range(1, longest + 1):
        inside = np.flatnonzero(words_left >= n)
        first = np.flatnonzero(lcp[inside] < n)  # where an LCP interval of depth n begins
        yield n, place[order[inside[first]]], np.diff(np.append(first, len(inside)))


def _shards(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a language whose words are about ``words`` at most, or one longer text."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            n = 1 + len(text) // 6
            if size and size + n > words:
                yield from held.items()
                held, size = {}, 0
            held.setdefault(lang, []).append(text)
            size += n
    yield from held.items()


def _dictionary(texts: DataFrame, seed: int, shard_words: int) -> DataFrame:
    """lang, word, key (its hash) and count, summed over all shards."""

    def summed(word: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((other, word))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(word[order]) != 0) | (np.diff(other[order]) != 0)])) if len(order) else order
        return order[new], np.add.reduceat(n[order], new) if len(order) else n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part in _shards(batches, shard_words):
            found, spelled = [], []
            for lo, hi in text_batches(part):
                raw, start, end, _, (word, other) = tokens(part[lo:hi], seed, seed + 1)  # the other hash tells words of one hash apart
                first, n = summed(word, other, np.ones(len(word), np.int64))
                data = raw.tobytes()
                spelled += [data[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                found.append((word[first], other[first], n))
            word, other, n = (np.concatenate(x) for x in zip(*found, strict=True))
            first, n = summed(word, other, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(first), pa.string()), pa.array([spelled[i].decode() for i in first.tolist()], pa.string()), pa.array(word[first].view(np.int64)), pa.array(n, pa.int64())],
                names=["lang", "word", "key", "n"],
            )

    made = texts.mapInArrow(count, "lang string, word string, key long, n long")
    return made.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def _packed(texts: DataFrame, seed: int, longest: int, buckets: int, shard_words: int) -> DataFrame:
    """lang, bucket, and arrays: words' hashes (k1, k2, ..., 0 beyond the phrase) and count of its phrases."""
    keys = [f"k{i + 1}" for i in range(longest)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part in _shards(batches, shard_words):
            words, pieces, before = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
            for lo, hi in text_batches(part):
                _, _, _, piece, (word,) = tokens(part[lo:hi], seed)
                words.append(word)
                pieces.append(piece + before)
                before += int(piece[-1]) + 1 if len(piece) else 0
            word, piece = np.concatenate(words), np.concatenate(pieces)
            del part, words, pieces
            padded = np.concatenate([word, np.zeros(longest, U)])
            for n, at, count in phrase_counts(word, piece, longest):
                key = [padded[at + i] if i < n else np.zeros(len(at), U) for i in range(longest)]
                bucket = (mix(key[0] + mix(key[min(1, longest - 1)]) % SPREAD) % U(buckets)).astype(np.int32)
                order = np.lexsort((*reversed(key[:n]), bucket))  # equal first words in a row pack well
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                offsets = pa.array(np.append(edges, len(order)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order].view(np.int64))) for c in [*key, count]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(edges), pa.string()), pa.array(bucket[order][edges]), *lists], names=["lang", "bucket", *keys, "a"])

    schema = "lang string, bucket int, " + ", ".join(f"{k} array<long>" for k in [*keys, "a"])
    return texts.mapInArrow(pack, schema)


def phrases(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = MAX_WORDS, min_count: int = MIN_COUNT, shard_words: int = SHARD_WORDS, seed: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two written tables and the words: phrases of min_count occurrences or more (lang, k1.., a),
    words of all languages (key, word, n), and the number of words of each language (lang, n)."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    while True:
        words = materialize(_dictionary(texts, seed, shard_words), "collocation-words")
        same = words.select("key", "word").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if same.isEmpty():
            break
        seed += 2
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, -(-size // MERGE_BYTES))
    keys = [f"k{i + 1}" for i in range(longest)]
    packed = _packed(texts, seed, longest, buckets, shard_words).repartitionById(buckets, F.col("bucket"))
    counts = packed.select("bucket", "lang", F.inline(F.arrays_zip(*keys, "a"))).groupBy("bucket", "lang", *keys).agg(F.sum("a").alias("a"))
    frequent = materialize(counts.where(F.col("a") >= min_count).drop("bucket"), "collocation-phrases")
    return frequent, words.groupBy("key").agg(F.min("word").alias("word"), F.sum("n").alias("n")), words.groupBy("lang").agg(F.sum("n").alias("n"))


def _of(frequent: DataFrame, longest: int, n: int) -> DataFrame:
    """The frequent phrases of ``n`` words."""
    last = F.col(f"k{n}") != 0
    return frequent.where(last & (F.col(f"k{n + 1}") == 0) if n < longest else last).select("lang", *[f"k{i + 1}" for i in range(n)], "a")


def _joined(rows: DataFrame, part: DataFrame, first: int, name: str) -> DataFrame:
    """``rows`` with the count, as ``name``, of the part of their phrase that begins at word ``first``."""
    keys = part.columns[1:-1]
    moved = part.select("lang", *[F.col(k).alias(f"k{i + first}") for i, k in enumerate(keys)], F.col("a").alias(name))
    return rows.join(moved, ["lang", *[f"k{i + first}" for i in range(len(keys))]])


def _scored(frequent: DataFrame, longest: int, n: int) -> DataFrame:
    """Phrases of ``n`` words with a, and l, r, score of their lowest-scoring cut."""
    rows = _of(frequent, longest, n)
    cuts = []
    for k in range(1, n):
        rows = _joined(rows, _of(frequent, longest, k), 1, f"l{k}")
        rows = _joined(rows, _of(frequent, longest, n - k), k + 1, f"r{k}")
        score = f"({SCALE} * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l{k} AS DECIMAL(15,0)) * CAST(r{k} AS DECIMAL(15,0)))"
        cuts.append(F.struct(F.expr(score).cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    keys = [f"k{i + 1}" for i in range(n)]
    rows = rows.withColumn("cut", F.array_min(F.array(*cuts)))
    return rows.select("lang", *keys, "a", "cut.l", "cut.r", "cut.score")


def _uncovered(rows: DataFrame, frequent: DataFrame, longest: int, n: int, percent: int) -> DataFrame:
    """``rows`` but for those inside a longer phrase with enough of their occurrences."""
    keys = [f"k{i + 1}" for i in range(n)]
    inside = None
    for m in range(n + 1, longest + 1):
        longer = _of(frequent, longest, m)
        for first in range(m - n + 1):
            part = longer.select("lang", *[F.col(f"k{first + i + 1}").alias(k) for i, k in enumerate(keys)], F.col("a").alias("a_longer"))
            inside = part if inside is None else inside.unionByName(part)
    if inside is None:
        return rows
    inside = inside.groupBy("lang", *keys).agg(F.max("a_longer").alias("a_longer"))
    covered = F.coalesce(100 * F.col("a_longer") >= percent * F.col("a"), F.lit(False))
    return rows.join(inside, ["lang", *keys], "left").where(~covered).drop("a_longer")


def collocations(
    docs: DataFrame, *, top: int = TOP, longest: int = MAX_WORDS, min_count: int = MIN_COUNT, covered_percent: int = COVERED_PERCENT, rank_rows: int = RANK_ROWS, **options
) -> DataFrame:
    """The ``top`` phrases of two to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score."""
    frequent, words, totals = phrases(docs, longest=longest, min_count=min_count, **options)
    words = materialize(words.where(F.col("n") >= min_count).select("key", "word"), "collocation-spelling")
    found = None
    for n in range(2, longest + 1):
        rows = _uncovered(_scored(frequent, longest, n), frequent, longest, n, covered_percent)
        for i in range(n):
            rows = rows.join(words.select(F.col("key").alias(f"k{i + 1}"), F.col("word").alias(f"w{i + 1}")), f"k{i + 1}")
        rows = rows.select("lang", F.concat_ws(" ", *[f"w{i + 1}" for i in range(n)]).alias("phrase"), "a", "l", "r", "score")
        found = rows if found is None else found.unionByName(rows)
    found = materialize(found, "collocation-candidates")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    #: The best of each salted part first, so that no task ranks all phrases of a language.
    parts = max(1, -(-found.count() // rank_rows))
    part = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE_SQL = r"""
    WITH texts AS (SELECT coalesce(lang, 'und') AS lang,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
    lists AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
    counts AS MATERIALIZED (SELECT lang, n, phrase, count(*) AS a FROM (
            SELECT lang, n, array_to_string(w[i + 1 : i + n], ' ') AS phrase
            FROM (SELECT lang, w, n, unnest(range(len(w) - n + 1)) AS i FROM lists, range(1, 4) AS t(n) WHERE len(w) >= n))
        GROUP BY ALL HAVING count(*) >= 10),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
    split AS (SELECT lang, n AS words, phrase, a, string_split(phrase, ' ') AS w FROM counts WHERE n >= 2),
    cuts AS (SELECT s.*, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 :], ' ') AS rest
        FROM split s, range(1, 3) AS t(k) WHERE k < words),
    scored AS (SELECT c.lang, c.phrase, c.words, c.a, c.k, l.a AS l, r.a AS r,
            CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
        FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.first JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, phrase, max(a) AS a FROM (
            SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM split WHERE words = 3)
        GROUP BY ALL),
    ranked AS (SELECT lowest.*, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, lowest.a DESC, lowest.phrase) AS rank
        FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.phrase = lowest.phrase
        WHERE NOT coalesce(100 * inside.a >= 50 * lowest.a, false))
    SELECT ranked.lang, rank, phrase, a, l, r, totals.n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""
