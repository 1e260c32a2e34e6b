"""Collocations, exact deduplication and vector codes against brute force."""

import collections
import hashlib
import math
import os
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoscope.llm import collocations, common, exact_dedup, vector_codes
from kairoscope.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_registered_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{SF}/{table}'")
    cursor = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in cursor.description)
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=key)


# ---------------------------------------------------------------- collocations


def plain_collocations(rows, top, min_count=10, longest=3):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {k: a for k, a in f.items() if len(k) > 2 and a >= min_count}
    out = collections.defaultdict(list)
    for (lang, *w), a in found.items():
        inside = lambda o: any(list(o[i : i + len(w)]) == w for i in range(1, len(o) - len(w) + 1))  # noqa: E731, B023
        if any(o[0] == lang and len(o) > len(w) + 1 and 100 * b >= 50 * a and inside(o) for o, b in found.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


def phrase_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "CITY", "ÄRA", "été", "a", "b", "c", "x.", "y,", "-", "🙂"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) + rng.choice(["", "\n", "\t", "new york city"]), rng.choice(["en", "fr", None, "und"])) for _ in range(150)]
    return [*rows, *rows[:20], (None, "en"), ("", None), (".,;", "de"), ("one two " * 3000, "en"), ("word" * 5000, "en")]


@pytest.mark.parametrize("shard_words", [1, 60, 1 << 20])
def test_collocations_are_those_of_all_ngrams(spark, shard_words):
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, lang, "clash", 1) for t, lang in rows], "text string, lang string, bucket string, k1 long").repartition(3)
    got = collocations.collocations(docs, top=25, shard_words=shard_words, rank_rows=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == plain_collocations(rows, 25)


def test_no_documents_have_no_collocations(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_suffixes_are_sorted_by_doubling():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 300):
        ids = rng.integers(0, 4, n)
        for depth in (1, 2, 3, 4, 8):
            got = [tuple(ids[i : i + depth]) for i in collocations.suffix_order(ids, depth)]
            assert got == sorted(got)


def test_intervals_count_phrases():
    word, piece = np.array([5, 6, 5, 6, 5, 5, 6], np.uint64), np.array([0, 0, 0, 0, 0, 1, 1])
    got = {n: sorted((tuple(word[i : i + n].tolist()), c) for i, c in zip(at, count)) for n, at, count in collocations.phrase_counts(word, piece, 3)}
    assert got == {1: [((5,), 4), ((6,), 3)], 2: [((5, 6), 3), ((6, 5), 2)], 3: [((5, 6, 5), 2), ((6, 5, 6), 1)]}


def test_scores_are_exact_beyond_64_bits(spark):
    a, b = 999_999_999_999_999, 999_999_999_999_989
    frequent = spark.createDataFrame([("en", 1, 0, 0, a), ("en", 2, 0, 0, a - 1), ("en", 1, 2, 0, b)], "lang string, k1 long, k2 long, k3 long, a long")
    got = collocations._scored(frequent, 3, 2).collect()
    assert [(r["l"], r["r"], r["score"]) for r in got] == [(a, a - 1, 10**6 * b * b // (a * (a - 1)))]


def test_another_seed_gives_other_hashes():
    one, other = (collocations.tokens([b"Some words, SOME"], seed)[4][0] for seed in (0, 2))
    assert one[0] == one[2] != one[1] and not set(one.tolist()) & set(other.tolist())


# ---------------------------------------------------------------- exact deduplication


def plain_classes(rows, largest):
    classes = collections.defaultdict(list)
    for i, t in rows:
        classes[t or ""].append(i)
    out = collections.Counter()
    for t, ids in classes.items():
        known = [i for i in ids if i is not None]
        best = (max if largest else min)(known) if known else None
        out.update((i, t, best, len(ids)) for i in ids)
    return out


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("bits", [128, 2])
@pytest.mark.parametrize("heavy", [1000, 3])
def test_one_row_of_equal_texts_stays(spark, monkeypatch, keep, bits, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    monkeypatch.setattr(exact_dedup, "CHUNK", 7)
    rng = random.Random(bits)
    rows = [(i, rng.choice(["", None, "A", "a", "a ", "é", "é", "x" * 100_000, f"only {i}"])) for i in range(90)]
    rows += [(None, "a"), (None, "of none"), (None, "of none"), *[(7, "same")] * 30, (200, "a"), (200, "a"), (200, "b")]
    docs = spark.createDataFrame([(i, t, "clash", "kept") for i, t in rows], "doc_id long, text string, keep_id string, other string").repartition(3)
    digest = exact_dedup.content_hash if bits == 128 else lambda t: F.substring(F.md5(t), 1, 1)
    got = exact_dedup.exact_dedup(docs, keep=keep, digest=digest)
    assert set(got.columns) == {"doc_id", "text", "other", "keep_id", "group_size", "kept"}
    got = got.collect()
    assert collections.Counter((r["doc_id"], r["text"] or "", r["keep_id"], r["group_size"]) for r in got) == plain_classes(rows, keep == "largest")
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({t or "" for _, t in rows}) == len({r["text"] or "" for r in kept})
    assert all(r["doc_id"] == r["keep_id"] and r["other"] == "kept" for r in kept)


def test_no_rows_have_no_copies(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- vector codes


def plain_codes(rows):
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v]) for i, v in kept if len(v) == len(kept[0][1])]
    size = len(kept[0][1]) // 8
    books = [[v[p * size : (p + 1) * size] for _, v in kept[:16]] for p in range(8)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))

    def assign(p):
        parts = [v[p * size : (p + 1) * size] for _, v in kept]
        return parts, [min((far(x, e), j) for j, e in enumerate(books[p])) for x in parts]

    for _ in range(6):
        for p in range(8):
            parts, at = assign(p)
            for j in range(len(books[p])):
                mine = [x for x, (_, k) in zip(parts, at) if k == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [assign(p)[1] for p in range(8)]
    out = [(i, "".join(f"{last[p][r][1]:02x}" for p in range(8)), sum(last[p][r][0] for p in range(8))) for r, (i, _) in enumerate(kept)]
    return out, ",".join(str(x) for b in books for e in b for x in e)


def vector_rows(n, wide=1.0, seed=11):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, wide))) for _ in range(16)]) for i in range(n)]
    return rows


@pytest.mark.parametrize("rows", [vector_rows(60), vector_rows(5), vector_rows(40, 1e9), vector_rows(30, 1e30), [(i % 4, [0.25 * (i % 3)] * 16) for i in range(40)]], ids=["many", "few", "large", "huge", "ties"])
def test_codes_are_those_of_plain_search(spark, rows):
    odd = [(3, None), (4, []), (5, [float("nan")] * 16), (6, [None] + [0.0] * 15), (-1, [float("inf")] + [0.0] * 15), (1000, [1.0] * 8), (None, [0.5] * 16), (2, rows[0][1])]
    odd_rows = [*rows, *odd]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in odd_rows], "vec_id long, embedding array<float>, code string, more int").repartition(3)
    books = vector_codes.train(df)
    got = vector_codes.encode(df, books)
    assert set(got.columns) == {"vec_id", "embedding", "more", "code", "error"}
    want, text = plain_codes(odd_rows)
    assert vector_codes.codebooks_text(books) == text
    fits = lambda e: e if e < 1 << 63 else None
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got.collect()), key=key) == sorted(((i, c, fits(e)) for i, c, e in want), key=key)


def test_no_vectors_have_no_codebook(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert vector_codes.train(none) is None


def test_dimensions_go_by_variance():
    assert vector_codes.spread_order(np.array([[0, 5, 1, 5], [0, -5, 2, -5], [0, 0, 3, 0]])).tolist() == [1, 3, 2, 0]


def test_labels_sum_their_errors(spark, tmp_path):
    rows = [(i, v, None if i % 3 == 0 else i % 3) for i, v in vector_rows(50)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op13(spark, str(tmp_path)).collect()
    sums, text = collections.Counter(), plain_codes([r[:2] for r in rows])
    error = {i: e for i, _, e in text[0]}
    for i, _, label in rows:
        sums[label] += error[i]
    label_of = {i: label for i, _, label in rows}
    assert {(r["vec_id"], r["error"], r["label_error"]) for r in got} == {(i, e, sums[label_of[i]]) for i, e in error.items()}
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(text[1].encode()).hexdigest()}


# ---------------------------------------------------------------- components


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    from kairoscope.llm.dart_minhash import components

    rng = random.Random(seed)
    n = 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(120 + 90 * seed)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500 + i) for i in range(1, 30)] + [(7, 7)]
    label = {x: x for e in edges for x in e}
    while True:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
        if not moved:
            break
    got = components(spark.createDataFrame(edges, "a long, b long"), f"test-{seed}").collect()
    assert {r["id"]: r["label"] for r in got} == label and len(got) == len(label)
