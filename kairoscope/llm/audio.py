"""Chroma fingerprints of audio recordings, and their alignment.

A recording (WAV bytes, PCM of 16 bits) is cut into overlapping frames; the
spectrum of a frame is folded to 12 pitch classes, smoothed over time and
normalised. An integral image of frames x pitch classes gives the sum of any
rectangle in four look-ups; 16 filters compare sums of rectangles, each is
quantised to two bits (as a Gray code), and the bits of all filters pack into
one 32-bit integer for each position. Thresholds of the quantisers are the exact
quartiles of the filters over all positions of all recordings (and one position of
zeros, which an empty table needs). Filter values are whole multiples of
1 / ``STEPS``; one pass counts them by cells of ``CELL`` steps, a second one counts
the steps of the cells that hold quartiles. Both recompute the filters, as their
values are many times larger than the recordings' integers.

Search: the queries go to all tasks in blocks of bounded size; each task looks
both halves of its recordings' integers up among the queries' halves, counts the
offsets of the hits, and compares the bits of the two recordings at the offsets that have
``VOTES`` hits. A match has a share of differing bits of at most ``MAX_ERROR``
over at least ``OVERLAP`` of the shorter recording.

Recordings with equal fingerprints are one class; classes are searched, and
members are found by their class id.

Defined results: null, broken, empty or too short audio has no integers and no
match; a recording does not match itself; null ids are kept and never queries.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

RATE, FRAME, HOP = 5512, 2048, 512
LOW_HZ, HIGH_HZ = 60.0, 2600.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
SPAN = 12  # frames that the widest filter looks at
STEPS = 1 << 24  # steps of a filter value in one unit
CELL = 1 << 14  # steps that are counted as one at first
RANGE = 1 << 29  # steps kept for each filter: values of -16 to 16, as |value| < log(42 / 0.01) < 9
VOTES, MAX_ERROR, OVERLAP = 4, 0.25, 0.5
EVERY = 50  # queries are the recordings whose id it divides
BLOCK = 2048  # queries that go to the tasks at once

#: (kind, first pitch class, pitch classes, frames), by rule: four kinds over
#: three heights, then four wide ones.
FILTERS = [(k, (3 * h + k) % (12 - 3 * h - 2), 3 * h + 3, (3, 6, 9, 12)[(h + k) % 4]) for h in range(3) for k in range(4)] + [
    (k, 0, 12, (12, 9, 6, 3)[k]) for k in range(4)
]


def read_wav(raw: bytes | None) -> np.ndarray:
    """Samples of the first channel, as floats; empty if the bytes are no such WAV."""
    try:
        with wave.open(io.BytesIO(raw or b"")) as f:
            if f.getsampwidth() != 2:
                return np.zeros(0)
            x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())[:, 0]
            x = x.astype(np.float64) / 32768
            if f.getframerate() != RATE and len(x):
                n = int(len(x) * RATE / f.getframerate())
                x = np.interp(np.arange(n) * f.getframerate() / RATE, np.arange(len(x)), x)
            return x
    except (wave.Error, EOFError, struct.error, ValueError):
        return np.zeros(0)


def _fold() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    table = np.zeros((len(hz), 12))
    used = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    table[used, np.round(12 * np.log2(hz[used] / 440)).astype(int) % 12] = 1
    return table


_FOLD, _WINDOW = _fold(), np.hanning(FRAME)


def chroma(x: np.ndarray) -> np.ndarray:
    if len(x) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * _WINDOW
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ _FOLD
    if len(power) < len(SMOOTH):
        return np.zeros((0, 12))
    power = sum(w * power[k : len(power) - len(SMOOTH) + 1 + k] for k, w in enumerate(SMOOTH))
    norm = np.sqrt((power**2).sum(axis=1, keepdims=True))
    return np.divide(power, norm, out=np.zeros_like(power), where=norm > 1e-6)


def filter_values(image: np.ndarray) -> np.ndarray:
    """positions x 16 values: log ratios of sums of rectangles, in whole steps."""
    n = len(image) - SPAN + 1
    if n < 1:
        return np.zeros((0, len(FILTERS)))
    total = np.zeros((13, len(image) + 1))
    total[1:, 1:] = image.T.cumsum(axis=1).cumsum(axis=0)

    def area(t0, t1, c0, c1):
        return total[c1, t1 : t1 + n] - total[c1, t0 : t0 + n] - total[c0, t1 : t1 + n] + total[c0, t0 : t0 + n]

    parts, others = np.empty((2, len(FILTERS), n))
    for k, (kind, y, h, w) in enumerate(FILTERS):
        whole = area(0, w, y, y + h)
        if kind == 0:  # the rectangle against all pitch classes
            part, other = whole, area(0, w, 0, 12) - (whole if h < 12 else 0)
        elif kind == 1:  # lower against upper half
            part = area(0, w, y, y + h // 2)
            other = whole - part
        elif kind == 2:  # earlier against later half
            part = area(0, w // 2, y, y + h)
            other = whole - part
        else:  # two opposite quarters against the others
            part = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
            other = whole - part
        parts[k], others[k] = part, other
    return np.rint(np.log((parts + 0.01) / (others + 0.01)).T * STEPS) / STEPS


def pack(values: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Two Gray-coded bits of each filter, as one unsigned 32-bit integer."""
    level = (values[:, :, None] >= thresholds[None, :, :]).sum(axis=2)
    bits = np.array([0, 1, 3, 2], np.uint32)[level]
    return (bits << (2 * np.arange(len(FILTERS), dtype=np.uint32))).sum(axis=1, dtype=np.uint32)


def quartiles(recordings: list[bytes]) -> np.ndarray:
    """``all_quartiles`` of a few recordings at hand."""
    values = [filter_values(chroma(read_wav(r))) for r in recordings]
    values = np.concatenate([*values, np.zeros((1, len(FILTERS)))])
    return np.quantile(values, (0.25, 0.5, 0.75), axis=0).T


def fingerprint(raw: bytes | None, thresholds: np.ndarray) -> np.ndarray:
    return pack(filter_values(chroma(read_wav(raw))), thresholds)


def align(a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> tuple[int, int, int] | None:
    """Best (offset, bit errors, bits) of b against a over the given offsets."""
    best = None
    for o in offsets:
        s, e = max(0, int(o)), min(len(a), len(b) + int(o))
        if e - s < OVERLAP * min(len(a), len(b)):
            continue
        errors = int(np.bitwise_count(a[s:e] ^ b[s - int(o) : e - int(o)]).sum())
        if best is None or errors * best[2] < best[1] * 32 * (e - s):
            best = (int(o), errors, 32 * (e - s))
    return best if best and best[1] <= MAX_ERROR * best[2] else None


def halves(p: np.ndarray) -> np.ndarray:
    """The lower and the upper 16 bits of each integer, told apart by bit 16."""
    return np.concatenate([p & np.uint32(0xFFFF), (p >> np.uint32(16)) | np.uint32(1 << 16)])


class Queries:
    """A block of query fingerprints, with all their integers in order."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in rows]
        self.prints = [np.frombuffer(p, "<u4") for _, p in rows]
        value = np.concatenate([*map(halves, self.prints), np.zeros(0, np.uint32)])
        order = np.argsort(value, kind="stable")
        self.values = value[order]
        self.query = np.repeat(np.arange(len(rows)), [2 * len(p) for p in self.prints])[order]
        self.at = np.concatenate([*(np.tile(np.arange(len(p)), 2) for p in self.prints), np.zeros(0, np.int64)])[order]

    def match(self, ident: int, b: np.ndarray) -> list[tuple]:
        seeds = halves(b)
        lo, hi = np.searchsorted(self.values, seeds, "left"), np.searchsorted(self.values, seeds, "right")
        n = hi - lo
        if not n.any():
            return []
        hit = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        offset = self.at[hit] - np.repeat(np.tile(np.arange(len(b)), 2), n)
        wide = 1 << 24
        key, votes = np.unique(self.query[hit] * wide + offset + wide // 2, return_counts=True)
        key, votes = key[votes >= VOTES], votes[votes >= VOTES]
        out = []
        query, offset = np.divmod(key, wide)
        cut = np.flatnonzero(np.diff(query)) + 1
        for part in np.split(np.arange(len(key)), cut):
            if not len(part) or self.ids[query[part[0]]] == ident:
                continue
            q = int(query[part[0]])
            found = align(self.prints[q], b, offset[part] - wide // 2)
            if found:
                held = int(votes[part][offset[part] - wide // 2 == found[0]][0])
                out.append((self.ids[q], ident, found[0], held, found[1], found[2]))
        return out


MATCH = "query_id long, match_id long, frame_offset long, votes long, bit_errors long, bits long"


def step_counts(df: DataFrame, to_wav: Callable[[object], bytes | None], cells: list[int] | None, *, audio_col: str) -> DataFrame:
    """code, n: how often each code occurs over all recordings, in cells or, of the cells given, in single steps.

    A code is a filter's number and a value of it in steps; codes are in order by both.
    Their number is bounded whatever the number of recordings: RANGE / CELL cells for each
    filter, CELL steps for each cell.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, slot = np.arange(len(FILTERS)) * RANGE + RANGE // 2, None
        if cells is None:
            n = np.zeros(len(FILTERS) * RANGE // CELL, np.int64)
        else:
            n, slot = np.zeros(len(cells) * CELL, np.int64), np.full(len(FILTERS) * RANGE // CELL, -1)
            slot[cells] = np.arange(len(cells))
        for batch in batches:
            for x in batch["audio"]:
                code = ((filter_values(chroma(read_wav(to_wav(x)))) * STEPS).astype(np.int64) + first).ravel()
                at = code // CELL
                if slot is not None:
                    code, at = code[slot[at] >= 0], slot[at[slot[at] >= 0]] * CELL
                    at += code % CELL
                np.add.at(n, at, 1)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"code": at * CELL if slot is None else np.asarray(cells, np.int64)[at // CELL] * CELL + at % CELL, "n": n[at]})

    zeros = df.sparkSession.range(len(FILTERS)).select((F.col("id") * RANGE + RANGE // 2).alias("code"), F.lit(1).cast("long").alias("n"))
    if cells is None:
        zeros = zeros.withColumn("code", F.col("code") - F.col("code") % CELL)
    else:
        zeros = zeros.where(F.floor(F.col("code") / CELL).isin(cells))
    found = df.select(F.col(audio_col).alias("audio")).mapInPandas(run, "code long, n long").unionByName(zeros)
    return found.groupBy("code").agg(F.sum("n").alias("n"))


def at_ranks(counts: DataFrame, key: Column, ranks: Column) -> DataFrame:
    """Codes that hold the ``ranks`` (an array of structs with ``rank``, from 0) of their key; ``left`` is the rank inside the code."""
    w = Window.partitionBy("key")
    told = counts.withColumn("key", key).withColumn("upto", F.sum("n").over(w.orderBy("code"))).withColumn("total", F.sum("n").over(w))
    told = told.withColumn("r", F.explode(ranks)).withColumn("left", F.col("r.rank") - F.col("upto") + F.col("n"))
    return told.where("left >= 0 and left < n").select("key", "r", "code", "left")


def all_quartiles(df: DataFrame, to_wav: Callable[[object], bytes | None], *, audio_col: str) -> np.ndarray:
    """Exact quartiles of each filter over all positions of all recordings, interpolated as by ``np.quantile``."""
    # ranks of the quartiles times 4 are whole: q * (total - 1), whose last two bits are the share of the next rank
    four = [(q, F.lit(q) * (F.col("total") - 1)) for q in (1, 2, 3)]
    ranks = F.array(*(
        F.struct(F.lit(q).alias("q"), F.lit(up).alias("up"), F.floor((x + 3 * up) / 4).alias("rank"), (x % 4).alias("share")) for q, x in four for up in (0, 1)
    ))
    coarse = at_ranks(step_counts(df, to_wav, None, audio_col=audio_col), F.floor(F.col("code") / RANGE), ranks).collect()
    wanted = sorted({r.code // CELL for r in coarse})
    inside = {c: sorted({r.left for r in coarse if r.code // CELL == c}) for c in wanted}
    lefts = F.create_map(*(x for c in wanted for x in (F.lit(c).cast("long"), F.array(*(F.struct(F.lit(k).cast("long").alias("rank")) for k in inside[c])))))
    cell = F.floor(F.col("code") / CELL)
    fine = at_ranks(step_counts(df, to_wav, wanted, audio_col=audio_col), cell, lefts[cell]).collect()
    code = {(r.key, r.r.rank): r.code for r in fine}
    ends = np.empty((len(FILTERS), 3, 2))
    share = np.empty((len(FILTERS), 3))
    for r in coarse:
        ends[r.key, r.r.q - 1, r.r.up] = (code[r.code // CELL, r.left] % RANGE - RANGE // 2) / STEPS
        share[r.key, r.r.q - 1] = r.r.share / 4
    return ends[:, :, 0] + (ends[:, :, 1] - ends[:, :, 0]) * share


def fingerprints(df: DataFrame, to_wav: Callable[[object], bytes | None], thresholds: np.ndarray, *, id_col: str, audio_col: str) -> DataFrame:
    """rec_id, n_items, print (packed integers, little-endian), one recording at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = [fingerprint(to_wav(x), thresholds).astype("<u4") for x in batch["audio"]]
            ids = batch["rec_id"].astype(object)
            yield pd.DataFrame({"rec_id": pd.array([None if pd.isna(i) else int(i) for i in ids], "Int64"), "n_items": [len(p) for p in prints], "print": [p.tobytes() for p in prints]})

    columns = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(audio_col).alias("audio"))
    return columns.mapInPandas(run, "rec_id long, n_items long, print binary")


def search(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """Matches of ``queries`` among ``classes`` (rec_id, print): a pass for each block of queries."""
    spark, found = classes.sparkSession, None
    n_blocks = max(1, -(-queries.count() // BLOCK))
    for k in range(n_blocks):
        rows = queries.where(F.pmod(F.xxhash64("rec_id"), F.lit(n_blocks)) == k).select("rec_id", "print").collect()
        block = spark.sparkContext.broadcast(Queries(sorted((r[0], bytes(r[1])) for r in rows)))

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            for batch in batches:
                hits = [h for i, p in zip(batch["rec_id"], batch["print"], strict=True) for h in block.value.match(int(i), np.frombuffer(p, "<u4"))]
                yield pd.DataFrame(hits, columns=MATCH.replace(",", "").split()[::2])

        part = classes.select("rec_id", "print").mapInPandas(run, MATCH)
        found = part if found is None else found.unionByName(part)
    return found


# ---------------------------------------------------------------- the query


def _notes() -> np.ndarray:
    """Samples of the notes 0 to 36, each with an octave partial, for an eighth of a second."""
    per = RATE // 8
    t = np.arange(per) / RATE
    hz = 110 * 2 ** (np.arange(37) / 12)
    sound = (np.sin(2 * np.pi * hz[:, None] * t) + 0.5 * np.sin(4 * np.pi * hz[:, None] * t)) * np.hanning(per)
    return (sound * 16000).astype("<i2")


_NOTES = _notes()


def sonify(vector) -> bytes | None:
    """A recording from a vector: each value, rounded to a tenth, is a note of two
    partials, a fourth higher for each tenth."""
    if vector is None or not len(vector):
        return None
    v = np.nan_to_num(np.asarray(vector, np.float64))
    note = np.clip(18 + 5 * np.round(10 * v), 0, 36).astype(int)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setparams((1, 2, RATE, 0, "NONE", ""))
        f.writeframes(_NOTES[note].tobytes())
    return out.getvalue()


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of a recording for each row of ``embeddings``; matches of the
    classes that hold a query (an id divisible by 50) among all classes."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    thresholds = all_quartiles(vectors, sonify, audio_col="embedding")
    prints = materialize(fingerprints(vectors, sonify, thresholds, id_col="vec_id", audio_col="embedding"), "audio-prints")
    known = prints.where("n_items > 0 and rec_id is not null")
    groups = materialize(
        known.groupBy("print").agg(
            F.min("rec_id").alias("rec_id"), F.count(F.lit(1)).alias("members"), F.max((F.pmod("rec_id", F.lit(EVERY)) == 0).cast("int")).alias("asked")
        ),
        "audio-classes",
    )
    matches = search(groups, groups.where("asked = 1"))
    lists = matches.groupBy(F.col("query_id").alias("class_id")).agg(
        F.array_sort(F.collect_list(F.struct("match_id", "frame_offset", "votes", "bit_errors", "bits"))).alias("matches")
    )
    classes = groups.select(F.col("print").alias("p"), F.col("rec_id").alias("class_id"), "members")
    told = prints.join(classes, F.col("print") == F.col("p"), "left").join(lists, "class_id", "left")
    asked = F.coalesce((F.pmod("rec_id", F.lit(EVERY)) == 0) & (F.col("n_items") > 0), F.lit(False))
    return told.select(
        F.col("rec_id").alias("vec_id"), "n_items", F.sha2("print", 256).alias("print_sha256"), "class_id",
        F.coalesce("members", F.lit(0)).alias("members"), asked.alias("is_query"),
        F.when(asked, F.coalesce("matches", F.array())).alias("matches"),
    )
