"""Removal of long byte strings that occur more than once, by suffix arrays.

Two places share a 400-byte string exactly if the suffixes that start there
agree in their first 400 bytes. Sorting all suffixes of a corpus would move it
many times over, so the suffixes are first dealt into bins in which all equal
ones meet, and each bin is sorted by the difference-cover algorithm.

1. Each 400-byte window is assigned to its anchor: the leftmost of its 150-byte
   grams with the least hash. Equal windows have equal anchors in equal places,
   so a window whose anchor gram occurs in one place only is not repeated. The
   windows of one anchor in a row form a run; only runs of repeated anchors stay.
2. Runs of equal bytes (told by 128-bit BLAKE2 digests) are collapsed. If they
   stand in several places, all their windows are repeated.
3. An anchor with many different runs (more than ``HOT_BYTES`` of them) is split:
   each run is cut by the anchor's place in the window into 2, 4, ... 256 cells, and
   the cell's windows are keyed by the bytes that all of them hold. Equal windows
   keep equal keys, keys that occur once are dropped, and cells of one place hold
   nothing but equal windows, so every group ends small.
4. Other runs that share a key but differ go to one bin, and the bin's suffix array
   is built by DC3 (mod-3 difference cover): sample triples are sorted and named,
   names that tie are sorted by recursion, the remaining suffixes are merged in,
   and neighbours in the array are compared over 400 bytes.
5. The bytes that repeated windows cover are removed from each document.

Anchors that stand in another document too are counted (``n_shared``). They tell of
shared passages that are too short to be removed: of 300 bytes, say, three in four.

Whole texts that several rows share are removed without any of this, and count
as one text for the others.

Defined results: a null text is empty; texts under 400 bytes keep all bytes;
rows are judged by text, so null or repeated ids do no harm, and repeated rows
of 400 bytes or more are copies of each other; texts of over ``PIECE`` bytes are cut to pieces that overlap; columns
named like an output column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table
from .text_hash import U, mix, powers

LENGTH = 400
GRAM = 150
#: Bytes of runs in a bin.
BIN_BYTES = 1 << 20
#: A group of runs of more bytes is split before it goes to a bin.
HOT_BYTES = 1 << 20
#: A text is looked at in pieces of so many bytes, which overlap by a window.
PIECE = 1 << 19
_PLACE = U((1 << 20) - 1)
RANGES = "array<struct<from:int,to:int>>"


# ---------------------------------------------------------------- suffix array


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (values of at least 1) in their order, by DC3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    # sort the sampled triples and name them
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    order, name = _names(t[sample], t[sample + 1], t[sample + 2])
    if name[order[-1]] < len(sample):
        order = suffix_array(name)  # recurse on the names
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    # the remaining suffixes, and their merge: each is placed by its rank among
    # its own kind and by how many sampled suffixes of either kind are smaller
    rest = np.arange(0, n, 3)
    wide = np.int64(len(sample) + 2)
    rest = rest[np.argsort(t[rest] * wide + rank[rest + 1], kind="stable")]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    below_one = np.searchsorted(t[one] * wide + rank[one + 1], t[rest] * wide + rank[rest + 1])
    span = np.int64(t.max() + 1)
    pair = lambda i: (t[i] * span + t[i + 1]) * wide + rank[i + 2]
    below_two = np.searchsorted(pair(two), pair(rest))
    at = np.arange(len(rest)) + below_one + below_two
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = rest, sampled
    return out


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the triples, and for each its name: its place among distinct ones from 1."""
    span = int(max(a.max(), b.max(), c.max())) + 1
    if span**3 < 1 << 62:
        key = (a * span + b) * span + c
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order]) != 0
    else:
        order = np.lexsort((c, a * span + b))
        new = (np.diff((a * span + b)[order]) != 0) | (np.diff(c[order]) != 0)
    name = np.empty(len(a), np.int64)
    name[order] = np.concatenate([[1], 1 + np.cumsum(new)])
    return order, name


def repeated_starts(runs: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of some distinct byte strings the starts in it whose ``length``
    bytes stand at another start of any of them."""
    array = SortedRuns(runs)
    group, order = array.groups(length)
    size = np.bincount(group)
    return array.by_run(order[size[group] > 1])


class SortedRuns:
    """The suffix array of some byte strings."""

    def __init__(self, runs: list[bytes]):
        self.raw = np.frombuffer(b"".join(r + b"\0" for r in runs) + bytes(LENGTH + 8), np.uint8)
        self.size = np.array([len(r) for r in runs])
        self.end = np.cumsum(self.size + 1)
        self.first = self.end - self.size - 1
        text = self.raw[: self.end[-1]].astype(np.int64) + 2
        text[self.end - 1] = 1  # a separator
        self.order = suffix_array(text)
        self.room = self.end - 1  # up to here reaches the run of each start
        self.run = np.repeat(np.arange(len(runs)), self.size + 1)

    def groups(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The starts with ``length`` bytes left in their run, in order, and for each the number of its group of equal ones."""
        order = self.order[self.order + length <= self.room[self.run[self.order]]]
        if not len(order):
            return np.zeros(0, np.int64), order
        words = _eights(self.raw)
        same = np.arange(len(order) - 1)
        left, right = order[:-1], order[1:]
        for k in [*range(0, length - 7, 8), length - 8]:  # neighbours that still agree, eight bytes at a time
            same = same[words[left[same] + k] == words[right[same] + k]]
            if not len(same):
                break
        new = np.ones(len(order), np.int64)
        new[same + 1] = 0
        return np.cumsum(new) - 1, order

    def by_run(self, starts: np.ndarray) -> list[np.ndarray]:
        starts = np.sort(starts)
        cut = np.searchsorted(starts, self.first[1:])
        return [x - f for x, f in zip(np.split(starts, cut), self.first, strict=True)]


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    n = len(raw) - 7
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= raw[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


# ---------------------------------------------------------------- anchors


def anchored_runs(raw: bytes) -> tuple[list, list, list, list]:
    """Anchor gram, digest of the run's bytes, first window and number of windows of each run."""
    g, s, n = [], [], []
    for at in range(0, max(0, len(raw) - LENGTH) + 1, PIECE):
        if len(raw) - at >= LENGTH:
            for out, part in zip((g, s, n), _runs(raw[at : at + PIECE + LENGTH - 1], at), strict=True):
                out += part.tolist()
    return g, [body(raw, f, k) for f, k in zip(s, n, strict=True)], s, n


def body(raw: bytes, s: int, n: int) -> bytes:
    """Digest of the bytes of ``n`` windows from ``s`` on."""
    return hashlib.blake2b(b"%d," % n + raw[s : s + n - 1 + LENGTH], digest_size=16).digest()


def _runs(raw: bytes, shift: int):
    a = np.frombuffer(raw, np.uint8)
    up, down = powers(len(a) + 1)
    total = np.zeros(len(a) + 1, U)
    np.cumsum((a.astype(U) + U(1)) * up[:-1], out=total[1:])
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[: len(a) - GRAM + 1])
    key = (gram & ~_PLACE) | np.arange(len(gram)).astype(U)
    width = LENGTH - GRAM + 1
    fill = -len(key) % width
    grid = np.concatenate([key, np.full(fill, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(a) - LENGTH + 1
    anchor = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return gram[anchor[first]].view(np.int64), first + shift, np.diff(np.concatenate([first, [n]]))


def split_run(raw: bytes, g: int, s: int, n: int, p: int, level: int) -> list[tuple[int, bytes, int, int, int]]:
    """The run of ``n`` windows from ``s`` on cut into the 2**level cells of the
    anchor's place in a window: key, body, s, n, p of each. ``p`` is where the
    anchor is in ``raw``, or -1 if its gram hash ``g`` is yet to be found."""
    if p < 0:
        near = np.frombuffer(raw, np.uint8, LENGTH, s)
        up, down = powers(LENGTH + 1)
        total = np.concatenate([np.zeros(1, U), np.cumsum((near.astype(U) + U(1)) * up[:LENGTH], dtype=U)])
        gram = mix((total[GRAM:] - total[:-GRAM]) * down[: LENGTH - GRAM + 1])
        p = s + int(np.flatnonzero(gram.view(np.int64) == g)[0])
    width, out = 256 >> level, []
    last = p - s  # the anchor's place in the first window; it falls by one with each
    while n > 0:
        low = last // width * width
        high = min(low + width - 1, LENGTH - GRAM)
        k = min(n, last - low + 1)
        key = b"%d,%d," % (level, low) + raw[p - low : p + LENGTH - high]
        digest = hashlib.blake2b(key, digest_size=8).digest()
        out.append((int.from_bytes(digest, "little", signed=True), body(raw, s, k), s, k, p))
        s, n, last = s + k, n - k, last - k
    return out


def ranges(starts: np.ndarray) -> list[dict]:
    """Windows in a row as (from, to), to exclusive."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return [{"from": int(f), "to": int(t) + 1} for f, t in zip(starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [-1]])], strict=True)]


def covered(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans that windows starting in (from, to) cover, joined where they touch."""
    out: list[list[int]] = []
    for f, t in sorted(windows):
        e = t - 1 + LENGTH
        if out and f <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([f, e])
    return [tuple(x) for x in out]


# ---------------------------------------------------------------- the operator


def _flat_runs(docs: DataFrame) -> DataFrame:
    kind = "g array<long>, b array<binary>, s array<int>, n array<int>"

    @F.pandas_udf(kind)
    def runs(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [anchored_runs(t.encode("utf-8", "surrogatepass")) for t in part]
            yield pd.DataFrame({c: [r[k] for r in rows] for k, c in enumerate("gbsn")})

    stored = materialize(docs.select("content", runs(F.col("text")).alias("r")).select("content", "r.*"), "suffix-runs")
    return stored.select("content", F.explode(F.arrays_zip("g", "b", "s", "n")).alias("r")).select("content", "r.*")


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            yield pd.DataFrame({
                "g": [w["g"] for w in wanted], "b": [w["b"] for w in wanted],
                "run": [raw[w["s"] : w["s"] + w["n"] - 1 + LENGTH] for w in wanted],
            })


def _splitter(level: int):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, text, wanted in zip(batch["content"], batch["text"], batch["wanted"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows = [(content, *x) for w in wanted for x in split_run(raw, w["g"], w["s"], w["n"], w["p"], level)]
                yield pd.DataFrame(rows, columns=["content", "g", "b", "s", "n", "p"])

    return split


def _repeated(flat: DataFrame) -> DataFrame:
    """The runs whose key stands in several places, and whether it stands in several texts (wide). ``flat`` has no equal rows."""
    place = F.xxhash64("content", "s")
    keys = flat.groupBy("g").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), (F.min("content") != F.max("content")).alias("wide"))
    return flat.join(materialize(keys.where("lo <> hi").select("g", "wide"), "suffix-keys"), "g")


def _bodies(runs: DataFrame) -> DataFrame:
    return runs.groupBy("g", "b").agg(F.min(F.struct("content", "s", "n")).alias("one"), F.count(F.lit(1)).alias("places"))


def split_hot(docs: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``runs`` with every group of more than HOT_BYTES split, and their bodies."""
    runs, parts = runs.withColumn("p", F.lit(-1)), []
    for level in range(1, 10):
        bodies = materialize(_bodies(runs), "suffix-bodies")
        hot = bodies.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("one.n").cast("long") + LENGTH).alias("bytes"))
        hot = materialize(hot.where((F.col("k") > 1) & (F.col("bytes") > HOT_BYTES)).select("g"), "suffix-hot")
        if level == 9 or hot.isEmpty():
            parts.append((runs, bodies))
            break
        parts.append((runs.join(hot, "g", "left_anti"), bodies.join(hot, "g", "left_anti")))
        wanted = runs.join(hot, "g", "left_semi").groupBy("content").agg(F.collect_list(F.struct("g", "s", "n", "p")).alias("wanted"))
        cells = docs.join(wanted, "content").select("content", "text", "wanted")
        cells = cells.mapInPandas(_splitter(level), "content binary, g long, b binary, s int, n int, p int")
        runs = materialize(_repeated(materialize(cells, "suffix-cells")), "suffix-repeated")
    together = lambda frames: reduce(DataFrame.unionByName, frames)
    return together([r.select("content", "g", "b", "s", "n") for r, _ in parts]), together([b for _, b in parts])


def _sort_bin(bin_: pd.DataFrame) -> pd.DataFrame:
    hits = repeated_starts(list(bin_["run"]))
    return pd.DataFrame({"g": bin_["g"], "b": bin_["b"], "windows": [ranges(h) for h in hits]})


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``docs``: text, content (distinct). Returns content, windows (the ranges of
    starts of repeated windows) and n_shared (anchors that other texts have too)."""
    runs = materialize(_repeated(_flat_runs(docs)), "suffix-repeated")
    shared = runs.groupBy("content").agg(F.count_if("wide").alias("n_shared"))
    runs, bodies = split_hot(docs, runs.select("content", "g", "b", "s", "n"))
    several = materialize(bodies.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g"), "suffix-several")
    sought = bodies.join(several, "g", "left_semi").select("g", "b", "one.*")
    total = sought.agg(F.coalesce(F.sum(F.col("n") + LENGTH), F.lit(0))).first()[0]
    n_bins = max(1, -(-total // BIN_BYTES))
    wanted = sought.groupBy("content").agg(F.collect_list(F.struct("g", "b", "s", "n")).alias("wanted"))
    cut = docs.join(wanted, "content").select("text", "wanted").mapInPandas(_cut, "g long, b binary, run binary")
    bins = cut.groupBy(F.pmod("g", F.lit(n_bins)).alias("bin"))
    sorted_ = bins.applyInPandas(lambda pdf: _sort_bin(pdf), f"g long, b binary, windows {RANGES}")
    sorted_ = materialize(sorted_.where(F.size("windows") > 0), "suffix-sorted")
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("one.n").alias("to")))
    found = bodies.join(sorted_, ["g", "b"], "left").select("g", "b", F.when(F.col("places") > 1, whole).otherwise(F.col("windows")).alias("windows"))
    found = materialize(found.where("windows is not null"), "suffix-found")
    moved = lambda w: F.struct((w["from"] + F.col("s")).alias("from"), (w["to"] + F.col("s")).alias("to"))
    out = runs.join(found, ["g", "b"]).select("content", F.transform("windows", moved).alias("windows"), F.lit(0).cast("long").alias("n_shared"))
    out = out.unionByName(shared.select("content", F.lit(None).cast(RANGES).alias("windows"), "n_shared"))
    return out.groupBy("content").agg(F.flatten(F.collect_list("windows")).alias("windows"), F.sum("n_shared").alias("n_shared"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (with doc_id, text) plus n_bytes, removed (byte spans), kept (binary) and n_shared."""
    kind = "array<struct<start:int,end:int>>"

    @F.pandas_udf(f"removed {kind}, kept binary")
    def keep(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, windows in parts:
            removed, kept = [], []
            for text, w in zip(texts, windows, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                spans = covered([(x["from"], x["to"]) for x in w]) if w is not None else []
                at, rest = 0, []
                for s, e in spans:
                    rest.append(raw[at:s])
                    at = e
                removed.append([{"start": s, "end": e} for s, e in spans])
                kept.append(b"".join([*rest, raw[at:]]))
            yield pd.DataFrame({"removed": removed, "kept": kept})

    docs = docs.drop("n_bytes", "removed", "kept", "n_shared")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("content"))
    long_ = keyed.where(F.octet_length("text") >= LENGTH).select("content", "text")
    copies = materialize(long_.groupBy("content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("content"), "suffix-copies")
    # equal texts meet in the tasks that read them first, so a text of many rows moves a few times only
    windows = repeated_windows(materialize(long_.groupBy("content").agg(F.first("text").alias("text")), "suffix-texts"))
    whole = copies.select("content", F.lit(None).cast(RANGES).alias("windows"), F.lit(1).cast("long").alias("n_shared"), F.lit(True).alias("copy"))
    told = materialize(windows.join(copies, "content", "left_anti").withColumn("copy", F.lit(False)).unionByName(whole), "suffix-told")
    joined = keyed.join(told, "content", "left")
    n = F.octet_length("text")
    all_of = F.array(F.struct(F.lit(0).alias("from"), (n - LENGTH + 1).cast("int").alias("to")))
    out = joined.select("row", "text", "n_shared", F.when(F.col("copy"), all_of).otherwise(F.col("windows")).alias("windows"))
    out = out.select("row", n.cast("long").alias("n_bytes"), keep("text", "windows").alias("k"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))
    return out.select("row.*", "n_bytes", "k.removed", "k.kept", "n_shared")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared"
    )
