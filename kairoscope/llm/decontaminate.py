"""Benchmark decontamination by BM25 over an inverted index of test items.

The test items are the indexed collection and training passages are the
queries: windows of 2S words, one each S words, with S at least the longest
item, so every item lies whole in a window. Scores are divided by the item's
score for its own text, which makes one threshold fit all items. A window goes
to block-max WAND only if its essential terms can reach the threshold: the
terms that most items share are set aside as long as, for no item, they could
make up ``SPARE`` of the threshold. WAND then finds every item whose score is
at least the threshold, skipping blocks of postings by their largest scores.
A retrieved item counts if the passage holds ``OVERLAP`` of the word 5-grams of
its question and of its answer.

An item's question is its text up to the first question mark or line break, or
else its first sentence; the rest is the answer. If either has fewer than five
words, both are the whole text.

The index goes to all tasks in blocks of items of ``INDEX_BYTES`` of text at
most; more items mean more blocks, each with a pass over the documents. Item
count, mean length, longest item and document frequencies are those of the whole
benchmark in every block, so results do not depend on the blocks.

Defined results: null and empty texts match nothing; empty items are never
retrieved; equal items are all reported; an empty benchmark gives no rows;
null ids are reported as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.5
GRAM = 5
SPARE = 0.6
STRIDE = 64
POSTINGS = 8
INDEX_BYTES = 8 << 20
_WORD = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    m = re.search(r"\?|\n", text) or re.search(r"[.!]\s", text)
    cut = m.end() if m else len(text)
    q, a = tokens(text[:cut]), tokens(text[cut:])
    return (q, a) if min(len(q), len(a)) >= GRAM else (tokens(text), tokens(text))


class Statistics:
    """What BM25 needs to know of the whole benchmark; parts of it add up."""

    def __init__(self, texts: Iterable[str | None] = ()):
        self.items = self.words = self.longest = 0
        self.df: Counter[str] = Counter()
        for words in map(tokens, filter(None, texts)):
            if words:
                self.items += 1
                self.words += len(words)
                self.longest = max(self.longest, len(words))
                self.df.update(set(words))


class Index:
    """Postings by term, in the order of items, with the largest score of each block.

    ``whole`` has the statistics of the benchmark that the items are a block of.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, whole: Statistics | None = None):
        whole = whole or Statistics(t for _, t in items)
        items = sorted(((i, t) for i, t in items if t and tokens(t)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.ids = [i for i, _ in items]
        self.threshold = threshold
        docs = [Counter(tokens(t)) for _, t in items]
        self.sides = [tuple(grams(side) for side in question_and_answer(t)) for _, t in items]
        lengths = [sum(d.values()) for d in docs]
        self.stride = max(STRIDE, whole.longest)
        mean = whole.words / max(1, whole.items)
        df = {t for d in docs for t in d}
        idf = {t: math.log(1 + (whole.items - whole.df[t] + 0.5) / (whole.df[t] + 0.5)) for t in df}
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        impact = [{self.terms[t]: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean)) for t, n in d.items()} for d, size in zip(docs, lengths, strict=True)]
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for i, scores in enumerate(impact):
            own = sum(scores.values())
            for t, s in scores.items():
                self.postings[t].append((i, s / own))
        self.highest = [max(s for _, s in p) for p in self.postings]
        self.blocks = [[(p[min(k + POSTINGS, len(p)) - 1][0], max(s for _, s in p[k : k + POSTINGS])) for k in range(0, len(p), POSTINGS)] for p in self.postings]
        self.essential, self.least = self._essential()
        self.starts = np.cumsum([0, *map(len, self.postings)])
        self.flat_items = np.array([i for p in self.postings for i, _ in p], np.int64)
        self.flat_scores = np.array([s for p in self.postings for _, s in p])

    def _essential(self) -> tuple[np.ndarray, float]:
        """For each term its largest score if it is essential (0: set aside), and the
        least that the essential terms of an item must add to its score."""
        room = [SPARE * self.threshold] * len(self.ids)
        bound = np.array([*self.highest, 0.0])
        for t in sorted(range(len(self.postings)), key=lambda t: (-len(self.postings[t]), t)):
            if all(s <= room[i] for i, s in self.postings[t]):
                for i, s in self.postings[t]:
                    room[i] -= s
                bound[t] = 0.0
        return bound, (1 - SPARE) * self.threshold - 1e-9

    def retrieve(self, terms: list[int]) -> dict[int, float]:
        """Block-max WAND: all items that score at least the threshold."""
        least = self.threshold - 1e-9
        cursors = [[self.postings[t][0][0], 0, t] for t in terms]  # item, place, term
        found: dict[int, float] = {}

        def advance(c: list, item: int) -> None:
            """To the first posting at or after an item, passing whole blocks."""
            p, blocks = self.postings[c[2]], self.blocks[c[2]]
            k = c[1] // POSTINGS
            while k < len(blocks) and blocks[k][0] < item:
                k += 1
            at = max(c[1], k * POSTINGS)
            while at < len(p) and p[at][0] < item:
                at += 1
            c[0], c[1] = (p[at][0], at) if at < len(p) else (1 << 60, at)

        while True:
            cursors = sorted(c for c in cursors if c[0] < 1 << 60)
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.highest[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            local, end = 0.0, 1 << 60
            for c in cursors[: pivot + 1]:
                blocks, k = self.blocks[c[2]], c[1] // POSTINGS
                while k < len(blocks) and blocks[k][0] < item:
                    k += 1
                if k < len(blocks):
                    local += blocks[k][1]
                    end = min(end, blocks[k][0])
            if local < least:
                beyond = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
                to = max(item + 1, min(end + 1, beyond))
                for c in cursors[: pivot + 1]:
                    advance(c, to)
            elif cursors[0][0] == item:
                score = sum(self.postings[c[2]][c[1]][1] for c in cursors if c[0] == item)
                if score >= least:
                    found[item] = score
                for c in cursors:
                    if c[0] == item:
                        advance(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    advance(c, item)

    def _windows(self, docs: list[list[str]]) -> dict[int, set[int]]:
        """document -> windows in which the essential terms of some item reach
        what its score needs of them; all documents at once."""
        get, s = self.terms.get, self.stride
        n_words = np.array([len(w) for w in docs])
        ids = np.fromiter((get(w, -1) for words in docs for w in words), np.int64, n_words.sum())
        doc = np.repeat(np.arange(len(docs)), n_words)
        at = np.arange(len(ids)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        some = self.essential[ids] > 0
        ids, doc, at = ids[some], doc[some], at[some]
        n_windows = np.maximum(1, -(-n_words // s) - 1)
        first = np.cumsum(n_windows) - n_windows
        last, before = at // s, at // s - 1
        window = np.concatenate([(first[doc] + last)[last < n_windows[doc]], (first[doc] + before)[before >= 0]])
        term = np.concatenate([ids[last < n_windows[doc]], ids[before >= 0]])
        window, term = np.divmod(np.unique(window * len(self.terms) + term), len(self.terms))
        width = self.starts[term + 1] - self.starts[term]
        which = np.repeat(self.starts[term] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        key, place = np.unique(np.repeat(window, width) * len(self.ids) + self.flat_items[which], return_inverse=True)
        reached = key[np.bincount(place, self.flat_scores[which], len(key)) >= self.least] // max(1, len(self.ids))
        found = defaultdict(set)
        for w in np.unique(reached):
            d = int(np.searchsorted(first, w, "right")) - 1
            found[d].add(int(w - first[d]) * s)
        return found

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float, float, float, int]]:
        """document, item, best score, question and answer overlap, first word of the passage."""
        if not self.ids:
            return
        docs = [tokens(t) for t in texts]
        for d, starts in self._windows(docs).items():
            words, found = docs[d], {}
            for s in sorted(starts):
                passage = words[s : s + 2 * self.stride]
                terms = sorted({self.terms[w] for w in passage if w in self.terms})
                held = None
                for item, score in self.retrieve(terms).items():
                    held = grams(passage) if held is None else held
                    q, a = (len(side & held) / len(side) for side in self.sides[item])
                    if min(q, a) >= OVERLAP and (item not in found or (min(q, a), score) > (min(found[item][1:3]), found[item][0])):
                        found[item] = (score, q, a, s)
            for item, hit in found.items():
                yield d, item, *hit


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, content binary"


def contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and test item that it holds. ``content`` is the
    MD5 of the document's text, which tells rows of one doc_id apart."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // INDEX_BYTES))
    spark, parts = docs.sparkSession, []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    whole = Statistics(r[0] for r in items.select("text").toLocalIterator()) if n_blocks > 1 else None
    for block in range(n_blocks):
        block_items = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in block_items.collect()], threshold, whole))

        def md5(text: str) -> bytes:
            return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()

        def look(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            book = index.value
            for batch in batches:
                docs, texts = list(batch["doc_id"].astype(object)), list(batch["text"])
                for s in range(0, len(texts), 256):
                    hits = [
                        (None if pd.isna(docs[s + d]) else int(docs[s + d]), book.ids[item], *hit, md5(texts[s + d]))
                        for d, item, *hit in book.search(texts[s : s + 256])
                    ]
                    if hits:
                        out = pd.DataFrame(hits, columns=SCHEMA.replace(",", "").split()[::2])
                        yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        parts.append(rows.mapInPandas(look, SCHEMA))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("content")
