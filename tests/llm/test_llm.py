"""The training-data operators on small fixtures, against brute force."""

import collections
import hashlib
import io
import random
import struct
import wave
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoscope.llm import audio, chat, dart_minhash, decontaminate, langid, mixing, pii, row_keys, sharding, suffix_dedup, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n, seed=1, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t)) for i, t in enumerate(texts(60))]
    rows += [(60, rows[0][1], "en", "a", 0), (61, None, None, None, None), (62, "", "en", "b", 0), (63, " \n ", "en", "b", 3)]
    rows += [(64, rows[1][1] + " one more", "en", "a", 0), (65, "tiny text", "en", "a", 9), (66, "tiny text", "en", "a", 9)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- sharding


def test_shards_are_level_and_gapless(spark, docs, none):
    out = sharding.external_shuffle(docs.withColumn("slot", F.lit("clash")), 8, bucket_rows=7).toPandas()
    assert sorted(out.doc_id) == list(range(67)) and set(out.columns) == {*docs.columns, "shard", "slot"}
    sizes = out.groupby("shard").slot.agg(list)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes)
    again = sharding.external_shuffle(docs.repartition(5), 8, bucket_rows=7).toPandas()
    assert dict(zip(out.doc_id, zip(out.shard, out.slot))) == dict(zip(again.doc_id, zip(again.shard, again.slot)))
    assert sharding.external_shuffle(none).count() == 0


def test_repeated_and_null_rows_are_sharded(spark, docs):
    many = docs.unionByName(docs).withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")))
    out = sharding.external_shuffle(many, 3)
    assert out.count() == 134 and out.select("shard", "slot").distinct().count() == 134


def test_any_number_of_equal_rows_is_spread(spark, tmp_path):
    same = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("s").alias("source"))
    rows = same.unionByName(spark.range(500).select("id", F.concat(F.lit("t "), "id").alias("text"), F.lit("s").alias("source")).withColumnRenamed("id", "doc_id"))
    keys = row_keys.keyed_rows(rows, 3, ["doc_id", "text"])
    assert keys.count() == 20_500 and keys.groupBy("key").count().agg(F.max("count")).first()[0] < 5
    assert sorted(keys.groupBy("row.doc_id").count().where("count > 1").collect()) == [(7, 20_001)]
    out = sharding.external_shuffle(rows, 4)
    sharding.write_shards(out, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    sizes = {r.shard: (r.n, r.lo, r.hi, r.d) for r in back.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d")).collect()}
    assert sizes == {k: (5125, 0, 5124, 5125) for k in range(4)}
    assert back.where("doc_id = 7").count() == 20_001
    plan = mixing.plan_mix(rows, 4)
    assert plan.count() == 20_500 and plan.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] == 3 * 20_000 + 2 * 500


def test_fisher_yates_follows_its_draws(spark):
    rows = spark.createDataFrame([(b, n) for b, n in ((0, 1), (1, 2), (2, 5), (3, 40))], "b_bucket long, b_rows long")
    got = rows.withColumn("p", F.expr(sharding.FISHER_YATES.format(seed=9))).withColumn(
        "j", F.expr("CASE WHEN b_rows > 1 THEN transform(sequence(b_rows, 2L, -1L), i -> 1 + pmod(xxhash64(9L, b_bucket, i), i)) END")
    )
    for r in got.collect():
        p = list(range(1, r.b_rows + 1))
        for i, j in zip(range(r.b_rows, 1, -1), r.j or []):
            p[i - 1], p[j - 1] = p[j - 1], p[i - 1]
        assert r.p == p


# ---------------------------------------------------------------- mixing


def test_mix_hits_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), None, f"s{min(i % 7, 3)}", 0) for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    plan = mixing.plan_mix(df, 4, block_rows=50).toPandas()
    size, source = {r[0]: len(r[1].split()) for r in rows}, {r[0]: r[3] for r in rows}
    total, weight = collections.Counter(), {"s0": 5, "s1": 2, "s2": 1, "s3": 5}
    for d, n in size.items():
        total[source[d]] += n
    target, open_, left = {}, dict(weight), sum(total.values())
    while True:
        level = left / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > 3 * total[s] + 1e-9]
        if not over:
            target |= {s: level * w for s, w in open_.items()}
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
            del open_[s]
    taken = collections.Counter()
    for d, c, n, t in zip(plan.doc_id, plan.copies, plan["size"], plan.target):
        assert n == size[d] and 0 <= c <= 3 and t == pytest.approx(target[source[d]])
        taken[source[d]] += n * c
    assert all(target[s] - 1 <= taken[s] + 1 <= target[s] + 1 for s in target)  # the smallest documents have one word
    units = sum(plan.copies)
    shards = collections.Counter(s for x in plan.shards for s in x)
    assert sum(shards.values()) == units and set(shards) <= set(range(4)) and max(shards.values()) < 2 * min(shards.values())


def test_each_source_misses_less_than_its_smallest_document_left_out(spark):
    rng = random.Random(9)
    sizes = [rng.choice([1, 2, 30, 700, 9000]) if i % 3 else int(rng.paretovariate(1.0)) + 5 for i in range(900)]
    rows = [(i, " ".join(["w"] * n), None, f"s{int(rng.paretovariate(0.7)) % 9}", 0) for i, n in enumerate(sizes)]
    rows += [(1000 + i, "same words here " * 40, None, "s1", 0) for i in range(300)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, DOCS), 4).toPandas()
    for _, part in plan.groupby("source"):
        missed = part.target.iloc[0] - (part["size"] * part.copies).sum()
        left_out = part[(part.copies == part.target.iloc[0] // part.source_size.iloc[0]) & (part.copies < 3)]["size"]
        assert 0 <= missed < (left_out.min() if len(left_out) else 1)
    assert (plan.copies == plan.shards.map(len)).all()


def test_quotas_are_exact(spark):
    quotas = spark.createDataFrame([(1, 10), (2, 0), (3, 7), (4, 23)], "m_rank int, m_units long")
    got = {r.m_rank: np.diff([0, *r.m_upto]) for r in mixing.split_quotas(quotas, 5, 1).collect()}
    assert {k: v.sum() for k, v in got.items()} == {1: 10, 2: 0, 3: 7, 4: 23}
    assert set(sum(got.values())) == {8} and all((v >= 0).all() for v in got.values())


def test_mix_of_odd_tables(spark, docs, none):
    assert mixing.plan_mix(none).count() == 0
    plan = mixing.plan_mix(docs.withColumn("size", F.lit("clash"))).toPandas()
    assert len(plan) == 67 and mixing.mix(docs).count() == plan.copies.sum()
    assert mixing.mix(docs.where("doc_id = 61")).count() == 0


# ---------------------------------------------------------------- near duplicates


def jaccard(a, b):
    def bag(t):
        w = t.split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    a, b = bag(a), bag(b)
    return sum((a & b).values()) / sum((a | b).values())


def brute_classes(rows, similar=0.8):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, t) in enumerate(rows):
        for j, u in rows[:k]:
            if t.split() and u.split() and jaccard(t, u) >= similar:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i, _ in rows}


def near_rows():
    rng = random.Random(3)
    base = texts(40, 7, 80)
    rows = list(enumerate(base))
    for k in range(30):
        words = base[k % 6].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "edited" + str(rng.random())
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, "the same line again " * 30 + str(k)) for k in range(12)] + [(300, "short one"), (301, "short one"), (302, "")]
    return rows


def test_near_duplicates_are_found(spark):
    rows = near_rows()
    df = spark.createDataFrame([*rows, (None, "null id"), (303, None)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(df).collect()}
    assert got.pop(None) is None and got.pop(303) == 303
    assert got == brute_classes(rows)


def test_links_away_from_the_centres_are_found(spark, monkeypatch):
    """One bucket of everything: the second round forms every pair that a link of two classes needs."""
    monkeypatch.setattr(dart_minhash, "PART", 7)
    rng, rows = random.Random(12), []
    for base in texts(3, 51, 60):
        words = base.split()
        for _ in range(12):  # a chain: each text is like the next, few are like a centre
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(60)] = f"w{rng.random()}"
    centres = [0, 5, 17, 30]
    near = [(min(i, c), max(i, c)) for c in centres for i, _ in rows if i != c]
    scored = sorted({(a, b, jaccard(rows[a][1], rows[b][1])) for a, b in near})
    label = {i: i for i, _ in rows}
    for a, b, j in scored:
        if j >= 0.8:
            lo, hi = sorted((label[a], label[b]))
            label = {i: lo if c == hi else c for i, c in label.items()}
    verified = spark.createDataFrame(scored, "a long, b long, j double")
    large = spark.createDataFrame([(i, 0, 1, len(rows), centres) for i, _ in rows], "id long, band int, h long, n long, centres array<long>")
    labels = spark.createDataFrame(list(label.items()), "id long, label long")
    weights = dart_minhash.shared_weights(spark.createDataFrame(rows, "id long, text string"))
    bags = [collections.Counter(tuple(t.split()[i : i + 5]) for i in range(56)) for _, t in rows]
    held = collections.Counter(s for b in bags for s in b)
    assert {(r.id, r.total, r.shared) for r in weights.collect()} == {(i, 56, sum(c for s, c in b.items() if held[s] > 1)) for i, b in enumerate(bags)}
    mixed = dart_minhash.mixed_members(large, labels).join(weights, "id")
    got = {(r.a, r.b) for r in dart_minhash.cross_pairs(mixed, verified, 0.8).collect()}
    links = {(i, k) for k, u in rows for i, t in rows[:k] if label[i] != label[k] and jaccard(t, u) >= 0.8}
    assert links and links <= got and len(got) < sum(label[i] != label[k] for k, _ in rows for i, _ in rows[:k])
    assert dart_minhash.mixed_members(large, labels.withColumn("label", F.lit(0).cast("long"))).count() == 0


def test_large_buckets_give_exact_classes(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "SMALL", 1)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(df).collect()} == brute_classes(rows)


def test_no_documents_no_classes(none):
    assert dart_minhash.near_duplicates(none).count() == 0


def test_texts_of_one_id_keep_their_links(spark):
    """Texts are told apart by content: repeated and null ids lose no link."""
    a, b, c = texts(3, 9)
    near = " ".join([*b.split()[:-1], "changed"])
    df = spark.createDataFrame([(1, a), (1, b), (5, near), (None, near), (7, c), (None, c + " more"), (None, "alone here")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in dart_minhash.near_duplicates(df).collect())
    assert got == sorted([("1", "1", 0), ("1", "1", 1), ("5", "1", 1), ("None", "1", 1), ("7", "7", 1), ("None", "7", 1), ("None", "None", 0)])


def test_one_row_of_each_class_stays(spark):
    a, b, c = texts(3, 9)
    near = " ".join([*b.split()[:-1], "changed"])
    rows = [(1, a, "s"), (1, b, "s"), (5, near, "s"), (None, near, "s"), (7, c, "s"), (7, c, "t"), (7, c, "t"), (8, None, "s"), (8, " ", "s"), (None, a + " x", "s"), (None, "alone here", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("content", F.lit("clash")).withColumn("id", F.lit(3))
    kept = dart_minhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted([("1", a), ("1", b), ("7", c), ("8", "None"), ("8", " "), ("None", "alone here")])
    assert dart_minhash.one_of_each(df.limit(0)).count() == 0


def test_recall_against_all_pairs(spark):
    """Every pair of at least 0.8 of the whole table is in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs).collect()}
    assert got == {**{i: i for i in got}, **brute_classes([(r.doc_id, r.text) for r in docs.collect() if r.text and r.text.split()])}


def test_signatures_estimate_weighted_similarity():
    a, b = "x y z " * 40 + texts(1, 4, 150)[0], "x y z " * 20 + texts(1, 4, 150)[0]
    _, sig = dart_minhash.signatures([a.encode(), b.encode()])
    assert (sig[0] == sig[1]).mean() == pytest.approx(jaccard(a, b), abs=0.15)
    assert dart_minhash.similarity([a.encode()], [b.encode()])[0] == pytest.approx(jaccard(a, b))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    got = {r.id: r.label for r in dart_minhash.components(edges, "test").collect()}
    assert {got[i] for i in range(51)} == {0} and got[101] == 100


# ---------------------------------------------------------------- suffix arrays


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 10, 100, 101, 102, 500):
        for k in (1, 2, 30):
            s = rng.integers(1, k + 1, n)
            assert list(suffix_dedup.suffix_array(s)) == sorted(range(n), key=lambda i: tuple(s[i:]))


def brute_repeats(rows):
    seen, raw = collections.Counter(), [(t or "").encode() for t in rows]
    for b in raw:
        seen.update(b[s : s + 400] for s in range(len(b) - 399))
    out = []
    for b in raw:
        mark = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 399):
            if seen[b[s : s + 400]] > 1:
                mark[s] += 1
                mark[s + 400] -= 1
        gone = mark.cumsum()[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def repeat_rows():
    t = texts(12, 11, 250)
    shared = texts(1, 12, 90)[0]
    rows = [*t, t[0], t[1][:300] + shared + t[2][100:700], "é" + shared + t[3], shared[:399], shared[:400], "ab" * 900, "a" * 1200, None, "", t[4][10:] + t[4][5:]]
    return rows + ["line of text that repeats itself\n" * 40, "x" + "line of text that repeats itself\n" * 30, "\0" * 500 + t[5]]


def test_repeats_are_removed(spark, none):
    rows = repeat_rows()
    df = spark.createDataFrame([(i if i % 4 else None, t) for i, t in enumerate(rows)], "doc_id long, text string").withColumn("kept", F.lit(1))
    got = suffix_dedup.remove_repeats(df).collect()
    removed = lambda r: sum(s.end - s.start for s in r.removed)
    mine = [(r.n_bytes, removed(r), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got]
    assert sorted(mine) == sorted(brute_repeats(rows))
    # what is removed for another text's sake is shared, and what is shared has 150 bytes in common
    grams = [{(t or "").encode()[s : s + 150] for s in range(len((t or "").encode()) - 149)} for t in rows]
    for r in got:
        own = [k for k, t in enumerate(rows) if t == r.text]
        others = any(grams[own[0]] & grams[k] for k in range(len(rows)) if rows[k] != r.text) or len(own) > 1
        assert not r.n_shared or others
    assert sum(r.n_shared > 0 for r in got) >= 5
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot_bytes", [0, 2500])
def test_hot_anchors_are_split(spark, monkeypatch, hot_bytes):
    """One passage in many surroundings that are partly shared themselves."""
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot_bytes)
    passage, other = texts(2, 61, 40)
    around = texts(40, 62, 40)
    rows = [around[i % 7] + passage[:230] + around[i % 11] for i in range(30)] + [around[i] + passage[:230] + other for i in range(40)]
    rows += ["ab" * 300 + around[3], around[4] + "ab" * 300, around[5] + "ab" * 260 + "c", *repeat_rows()]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_repeats(rows))]


def test_cells_of_a_run_cover_it():
    raw = texts(1, 63, 400)[0].encode()
    for g, _, s, n in zip(*suffix_dedup.anchored_runs(raw), strict=True):
        for level in range(1, 9):
            cells = suffix_dedup.split_run(raw, int(g), int(s), int(n), -1, level)
            assert [w for c in cells for w in range(c[2], c[2] + c[3])] == list(range(s, s + n))
            assert max(c[3] for c in cells) <= 256 >> level


# ---------------------------------------------------------------- PII


def test_base_spans():
    text = "a@b.co x.y+z@m-1.org. 1.2.3.4 999.1.1.1 1.2.3.4.5 card 4111 1111 1111 1111 and +1 (555) 123-4567 +12, 5 4111 1111 1111 1111"
    got = [(k, text[s:e]) for k, s, e in pii.base_spans(text)]
    assert got == [
        ("email", "a@b.co"), ("email", "x.y+z@m-1.org"), ("ip", "1.2.3.4"), ("ip", "1.2.3.4"),
        ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567"),
    ]
    assert pii.base_spans("") == [] and pii.base_spans("@@ @.") == []


def test_base_spans_match_plain_patterns():
    import re

    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("ab1234567890.@-+_% ()é") for _ in range(rng.randint(0, 60)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) < 256 for p in m[0].split("."))]
        assert [s for s in pii.base_spans(t) if s[0] in ("email", "ip")] == want


def test_distant_repeats_are_labelled(spark, none):
    cards = [f"pay 4111 1111 1111 1111 now {w}" for w in texts(30, 2, 20)]
    phones = [f"call +1 (555) 123-45{k:02d} soon {w}" for k, w in enumerate(texts(40, 3, 20))]
    plain = [f"item {k} of 12 in 2024 {w}" for k, w in enumerate(texts(40, 4, 20))]
    model = pii.SkipChain.fit(cards + phones + plain)
    text = "call +1 (555) 867-5309 today. " + texts(1, 5, 40)[0] + " again 5558675309 there"
    base, spans = pii.find(model, [text])[0]
    assert base == pii.base_spans(text) and set(base) <= set(spans)
    assert [text[s:e] for k, s, e in spans if (k, s, e) not in base] == ["5558675309"]
    assert pii.find(model, [None, "", plain[0]]) == [([], [])] * 3
    assert pii.find(None, [text])[0] == (base, base)
    assert pii.detect(none.select("doc_id", "text"), pii.train(none)).count() == 0


def pii_model():
    cards = [f"pay 4111 1111 1111 1111 now {w}" for w in texts(30, 2, 20)]
    phones = [f"call +1 (555) 123-45{k:02d} soon {w}" for k, w in enumerate(texts(40, 3, 20))]
    return pii.SkipChain.fit(cards + phones + [f"item {k} of 12 in 2024 {w}" for k, w in enumerate(texts(40, 4, 20))])


def test_numbers_are_found_in_documents_without_base_spans():
    model, words = pii_model(), texts(1, 5, 20)[0]
    alone, beside = f"call (555) 867-5309 soon {words}", f"mail a@b.co or call (555) 867-5309 soon {words}"
    for text in (alone, beside):
        base, spans = pii.find(model, [text])[0]
        assert [text[s:e] for k, s, e in spans if (k, s, e) not in base] == ["(555) 867-5309"]
    assert pii.find(model, [f"item 3 of 12 in 2024 {words}"]) == [([], [])]


def test_planted_repeats_are_caught_and_plain_numbers_left(spark):
    """The model of a corpus finds repeats in other forms, and nothing in documents of years, amounts and counts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model, rng, caught = pii.train(docs), random.Random(8), 0
    for k, words in enumerate(texts(60, 14, 30)):
        n = f"{rng.randrange(200, 999)}555{rng.randrange(1000, 9999)}"
        form = (n, f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}")[k % 4]
        text = f"reach me at +1 ({n[:3]}) {n[3:6]}-{n[6:]} or so {words} again {form} there"
        base, spans = pii.find(model, [text])[0]
        caught += [text[s:e] for kind, s, e in spans if (kind, s, e) not in base] == [form]
    assert caught >= 54
    plain = [f"in {rng.randrange(1900, 2030)} some {rng.randrange(1, 10**rng.randrange(1, 9))} of {rng.randrange(1, 99)}.{rng.randrange(10)} % {w}" for w in texts(200, 15, 20)]
    assert sum(bool(spans) for _, spans in pii.find(model, plain)) == 0


def test_odd_tables_of_personal_data(spark):
    rows = [(1, "mail a@b.co " * 3), (1, "mail a@b.co " * 3), (None, "x" * 400_000 + " 10.0.0.1 " + "7 " * 50_000), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("base", "spans", "crf_out")})
    got = pii.detect(df, None)
    assert sorted((str(r.doc_id), len(r.base)) for r in got.collect()) == [("1", 3), ("1", 3), ("3", 0), ("4", 0), ("None", 1)]
    assert got.columns == ["doc_id", "text", "crf_out", "base", "spans"]


def test_repeats_are_labelled_at_any_distance():
    model = pii_model()
    for form, shown in (("555.867.5309", True), ("5558675309", True)):
        for n in (1, 50):
            text = "call +1 (555) 867-5309 today. " + " ".join(f"{w} again {form} there" for w in texts(n, 5, 6))
            d = pii.Document(text)
            p = model.marginals([d])[d.known == 0]
            if n == 1:
                alone = p[0]
            assert len(p) == n and np.allclose(p, alone, atol=1e-3)
            assert len(pii.find(model, [text])[0][1]) == 1 + n * shown
    # messages of a row of tokens reach its end, and do not depend on the other documents
    row = pii.Document("+1 (555) 867-5309 " + "555-1234 " * 60)
    many = [row, pii.Document("item 3 of 12 in 2024"), pii.Document("call (555) 867-5309 or 555.867.5309 or (555)8675309")]
    assert np.allclose(model.marginals(many), np.concatenate([model.marginals([d]) for d in many]), atol=1e-9)


# ---------------------------------------------------------------- WARC


def test_zip_is_read_by_others_and_theirs_by_ours():
    members = [("a.txt", b"hello"), ("b/c.bin", bytes(range(256)) * 10)]
    raw = warc.zip_stored(members)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert [(n, z.read(n)) for n in z.namelist()] == members and z.testzip() is None
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("s", b"stored")
        z.writestr("d", b"deflated" * 50, zipfile.ZIP_DEFLATED)
    for data in (raw, other.getvalue() + b""):
        package = warc.ZipPackage(lambda at, n, data=data: data[at : at + n], len(data))
        name = next(iter(package.members))
        assert package.read(name, 1, 3) == {"a.txt": b"ell", "s": b"tor"}[name]
    with pytest.raises(ValueError):
        package.read("d")
    with pytest.raises(ValueError):
        warc.ZipPackage(lambda at, n: b"x" * n, 100)


def test_pages_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, "other é"), (4, "u", None), (5, "u", ""), (5, "u", ""), (None, "u", "same"), (6, "u", "z" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.read_packages(warc.write_packages(warc.with_revisits(df))).collect()
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    d = lambda t: warc.digest(t.encode())
    want = [
        (0, 4, d("same"), "revisit", 2), (1, 4, d("same"), "revisit", 2), (2, 4, d("same"), "response", None), (3, 8, d("other é"), "response", None),
        (4, 0, d(""), "revisit", 5), (5, 0, d(""), "response", None), (5, 0, d(""), "response", None), (6, 100_000, d("z" * 100_000), "response", None),
    ]
    assert got == sorted(want)
    assert warc.read_packages(warc.write_packages(warc.with_revisits(df.limit(0)))).count() == 0


def test_later_records_are_found_by_range():
    entries = [(i, *reversed(warc.warc_record(i, "u", f"page {i}".encode(), None))) for i in range(5)]
    raw = warc._build([(i, sha, member) for i, sha, member in entries])
    read = []
    package = warc.ZipPackage(lambda at, n: read.append(n) or raw[at : at + n], len(raw))
    import json

    place = json.loads(package.read(warc.INDEX).decode().splitlines()[3][20:])
    assert warc.parse_record(package.read(warc.ARCHIVE, place["offset"], place["length"]))["payload"] == b"page 3"
    assert read[-1] == place["length"]


# ---------------------------------------------------------------- decontamination


def brute_scores(items, passage):
    index = decontaminate.Index(items, threshold=0.0)
    out = collections.Counter()
    for t in {index.terms[w] for w in decontaminate.tokens(passage) if w in index.terms}:
        for i, s in index.postings[t]:
            out[i] += s
    return out


def test_wand_finds_all_above_threshold():
    rng = random.Random(8)
    items = list(enumerate(texts(80, 21, 30)))
    for threshold in (0.2, 0.4, 0.6):
        index = decontaminate.Index(items, threshold)
        for _ in range(40):
            words = rng.choice(items)[1].split()[: rng.randint(3, 30)] + rng.choice(items)[1].split()[: rng.randint(0, 30)]
            terms = sorted({index.terms[w] for w in words if w in index.terms})
            want = {i: s for i, s in brute_scores(items, " ".join(words)).items() if s >= threshold - 1e-9}
            assert index.retrieve(terms) == pytest.approx(want)


def test_leaks_are_found_and_clean_documents_left(spark, none):
    items = list(enumerate(texts(50, 31, 30)))
    clean = texts(80, 33, 300)
    rows = list(enumerate(clean)) + [(100 + i, clean[i] + " " + items[i][1].upper() + ". " + clean[i + 1]) for i in range(20)] + [(200, None), (201, ""), (None, items[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(100 + i, i) for i in range(20)} | {(None, 3)}
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(none, bench).count() == 0


def test_blocks_of_the_index_do_not_change_results(spark, monkeypatch):
    items = [(i, t if i else t + " " + t + " " + t) for i, t in enumerate(texts(30, 31, 30))]
    clean = texts(31, 33, 200)
    rows = [(i, clean[i] + " " + " ".join(t.split()[: 18 + i % 12]) + " " + clean[i + 1]) for i, t in items]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted(tuple(r) for r in decontaminate.contaminated(df, bench).collect())
    whole = found()
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", sum(len(t) for _, t in items) // 4)
    assert len(whole) >= 10 and [r[:2] for r in found()] == [r[:2] for r in whole]
    assert [r[2:] for r in found()] == [pytest.approx(r[2:]) for r in whole]


# ---------------------------------------------------------------- language ID


def test_languages_are_learned(spark, docs, none):
    rng = random.Random(6)
    make = lambda v: " ".join(rng.choice(v) for _ in range(50))
    kinds = {"xx": ["the", "and", "thing", "over"], "yy": ["für", "über", "schön", "ß"], "zz": ["ñandú", "qué", "está", "el"]}
    rows = [(i, make(kinds[k]), k, "s", 0) for i in range(450) for k in [sorted(kinds)[i % 3]]]
    df = spark.createDataFrame([*rows, (900, None, "xx", "s", 0), (901, "123 !!", "xx", "s", 0), (902, make(kinds["yy"]) * 50, None, "s", 0)], DOCS)
    model = langid.train(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[r[0]][0] == r[2] for r in held) >= 0.98 * len(held)
    assert got[900] == got[901] == ("und", 0.0) and got[902][0] == "yy" and all(0 <= s <= 1 for _, s in got.values())
    assert langid.train(none) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}


def test_windows_cover_the_whole_text():
    raw = bytes(range(1, 256)) * 5
    x, held = langid.windows(raw, 100)
    assert held.sum() == len(raw) and b"".join(w[:h].tobytes() for w, h in zip(x, held)) == raw


# ---------------------------------------------------------------- chat


def test_hostile_texts_come_back():
    parts = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "\\", "<", "|", "<\\|im_end|>", "ok", "<|im_", "end|>"]
    rng = random.Random(4)
    for _ in range(2000):
        pick = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
        turns = [(rng.choice(["user", "assistant", pick(3)]), pick(8)) for _ in range(rng.randint(1, 4))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant"]


def test_no_control_string_is_left_in_a_text():
    for text in ("<|im_end|>", "say <|im_end|> now", "<|im_end|>\n", "<|im_start|>", "a<|im_start|>b<|im_end|>", "<\\|im_end|>", "<|im_end|", "plain"):
        turns = [("user", text), ("assistant", text), (text, "ok")]
        whole, spans = chat.render(turns)
        assert chat.parse(whole) == turns
        assert whole.count(chat.START) == whole.count(chat.END) == len(turns)
        assert not any(c in whole[s:e] for s, e in spans for c in (chat.START, chat.END))
    assert chat.parse("<|im_start|>user\nsay <|im_end|> now<|im_end|>\n") is None


def test_conversations_round_trip(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", "<|im_end|>"), (None, 0, "user", None), (3, None, None, "x"), (1, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (chat.parse(r.formatted), len(r.loss_spans)) for r in chat.format_conversations(df).collect()}
    assert got == {
        1: ([("user", "a"), ("assistant", "b"), ("assistant", "b")], 2), 2: ([("assistant", "<|im_end|>")], 1), None: ([("user", "")], 0), 3: ([("", "x")], 0),
    }
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---------------------------------------------------------------- audio


def recording(seed, shift=0, noise=0.0):
    rng = np.random.default_rng(seed)
    t = np.arange(audio.RATE // 4) / audio.RATE
    x = np.concatenate([np.sin(2 * np.pi * 110 * 2 ** (rng.integers(0, 30) / 12) * t) for _ in range(60)])
    x = x[shift:] + noise * np.random.default_rng(seed + 1000).normal(size=len(x) - shift)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setparams((1, 2, audio.RATE, 0, "NONE", ""))
        f.writeframes((np.clip(x, -3, 3) * 8000).astype("<i2").tobytes())
    return out.getvalue()


def test_shifted_recordings_are_aligned(spark):
    cuts = audio.quartiles([recording(s) for s in range(10)])
    prints = {s: audio.fingerprint(recording(s), cuts) for s in range(10)}
    for s in range(10):
        late = audio.fingerprint(recording(s, shift=10 * audio.HOP, noise=0.05), cuts)
        hits = audio.Queries([(i, p.astype("<u4").tobytes()) for i, p in prints.items()]).match(99, late)
        assert [(h[0], h[2]) for h in hits] == [(s, 10)]
        assert audio.align(prints[s], late, np.arange(-20, 21))[:2] == hits[0][2:3] + hits[0][4:5]


def test_recall_against_all_offsets():
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.125, (25, 64))
    near = np.concatenate([base + rng.normal(0, sigma, base.shape) for sigma in (0.01, 0.02, 0.03, 0.04)])
    cuts = audio.quartiles([audio.sonify(v) for v in base])
    prints = [audio.fingerprint(audio.sonify(v), cuts) for v in base]
    queries = audio.Queries([(i, p.astype("<u4").tobytes()) for i, p in enumerate(prints)])
    want, got, hard = set(), set(), set()
    for j, v in enumerate(near):
        p = audio.fingerprint(audio.sonify(v), cuts)
        got |= {(h[0], j) for h in queries.match(1000 + j, p)}
        for i, q in enumerate(prints):
            if best := audio.align(q, p, np.arange(1 - len(p), len(q))):
                want.add((i, j))
                if best[1] >= 0.2 * best[2]:
                    hard.add((i, j))
    assert got <= want and len(hard) >= 10
    assert len(got) >= 0.9 * len(want) and len(got & hard) >= 0.9 * len(hard)


def test_broken_audio_has_no_fingerprint(spark):
    cuts = audio.quartiles([])
    for raw in (None, b"", b"RIFFxxxx", struct.pack("<4sI4s", b"RIFF", 4, b"WAVE")):
        assert len(audio.fingerprint(raw, cuts)) == 0
    rows = spark.createDataFrame([(1, recording(1)), (2, None), (None, recording(1))], "id long, wav binary")
    got = audio.fingerprints(rows, lambda x: None if x is None else bytes(x), cuts, id_col="id", audio_col="wav").collect()
    assert [bool(r.n_items) for r in got] == [True, False, True]


def test_thresholds_are_the_quartiles_of_all_recordings(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.02 if i % 3 else 0.3, 20).tolist()) for i in range(600)]
    rows += [(600 + i, rows[7][1]) for i in range(40)]
    rows += [(700, None), (701, []), (702, [0.1] * 3), (703, [float("nan"), float("inf"), None] * 8), (None, rows[3][1]), (5, rows[4][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors = [None if r.embedding is None else [np.nan if x is None else x for x in r.embedding] for r in df.collect()]
    cuts = audio.quartiles([audio.sonify(v) for v in vectors])
    assert len(rows) > 2 * 256 and (cuts[:, 0] < cuts[:, 2]).sum() >= 14
    want = [(i if i is None else int(i), hashlib.sha256(audio.fingerprint(audio.sonify(v), cuts).astype("<u4").tobytes()).hexdigest()) for (i, _), v in zip(rows, vectors, strict=True)]
    got = [(r.vec_id, r.print_sha256) for r in audio.op1(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert np.array_equal(audio.all_quartiles(df, audio.sonify, audio_col="embedding"), cuts)
    assert not audio.all_quartiles(df.limit(0), audio.sonify, audio_col="embedding").any()


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(texts(200, 41, 80))]
    items = texts(5, 43, 40)
    rows += [(1000 + i, rows[i][1], "en", "s0", 0) for i in range(10)] + [(2000, rows[5][1] + " " + items[0], "en", "s1", 0), (2001, "12 34", "en", "s1", 0), (2002, None, None, None, None)]
    for name, data, kind in (("documents", rows, DOCS), ("benchmark", list(enumerate(items)), "item_id long, text string")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage-{name}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
        if name != "sharding":
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert kept["language"] == {r[0] for r in rows} - {2001, 2002}
    assert kept["near_duplicates"] == kept["language"] - {1000 + i for i in range(10)}
    assert kept["decontamination"] == kept["near_duplicates"] - {2000}
    assert kept["mixing"] <= kept["decontamination"] and kept["sharding"] == kept["mixing"]


def test_documents_stay_where_no_row_has_a_label(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t, None, "s", len(t)) for i, t in enumerate(texts(20, 51, 30))] + [(100, "12 34", None, "s", 5), (101, None, None, "s", None), (102, "été", None, "s", 3), (None, "b", None, "s", 1)]
    got = corpus_pipeline.language(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, [*range(20), 102, None]))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
