"""Small literal cases: boundaries, ties, nulls and golden values."""

import datetime as dt
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kairoscope import params as P
from kairoscope.functions import scalars as S
from kairoscope.functions import scores as C
from kairoscope.operators import asof as A
from kairoscope.operators import sets as T
from kairoscope.operators import simulate as M
from kairoscope.operators import stats as X
from kairoscope.operators import windows as N
from kairoscope.sources import sinks as K
from kairoscope.streaming import ingest as G

D = dt.date


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def series(spark, rows):
    return spark.createDataFrame(rows, "d date, v double")


def test_primitives(spark):
    got = one(spark, S.clamp(F.lit(-5.0)), S.lin_map(F.lit(0.0), -100, 100), S.lin_map(F.lit(0.05), 0.10, 0), S.clamp(F.lit(None).cast("double")))
    assert tuple(got) == (0.0, 50.0, 50.0, None)


def test_sma_needs_all_rows(spark):
    df = series(spark, [(D(2024, 1, i), float(i)) for i in range(1, 5)])
    got = [r.m for r in df.select("d", N.sma("v", 2, []).alias("m")).orderBy("d").collect()]
    assert got == [None, 1.5, 2.5, 3.5]


def test_asof_boundaries(spark):
    data = series(spark, [(D(2024, 1, 1), 10.0), (D(2024, 1, 8), 20.0)])
    probe = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 8),), (D(2023, 12, 31),), (None,)], "d date")
    at = lambda df, c: {r.d: r[c] for r in df.collect()}
    assert at(A.asof_last(probe, data, keys=[], carry=["v"]), "asof_v") == {D(2024, 1, 5): 10, D(2024, 1, 8): 20, D(2023, 12, 31): None, None: None}
    assert at(A.asof_last(probe, data, keys=[], carry=["v"], strict=True), "asof_v")[D(2024, 1, 8)] == 10
    assert at(A.asof_first(probe, data, keys=[], carry=["v"]), "next_v")[D(2024, 1, 8)] == 20
    assert at(A.asof_first(probe, data, keys=[], carry=["v"], strict=True), "next_v")[D(2024, 1, 8)] is None


def test_strict_dates(spark):
    rows = spark.createDataFrame([("2024-02-29",), ("2024-02-30",), ("2024-2-01",), (None,)], "t string")
    assert [r.x for r in rows.select(S.strict_date("t").alias("x")).collect()] == [D(2024, 2, 29), None, None, None]
    rows = spark.createDataFrame([("2024-01-05T18:00:00Z",), ("2024-02-30T12:00:00Z",), ("2024-01-05 18:00:00",)], "t string")
    assert [r.x is not None for r in rows.select(S.strict_instant("t").alias("x")).collect()] == [True, False, False]


def test_business_days(spark):
    for a, b, n in ((D(2024, 1, 5), D(2024, 1, 8), 1), (D(2024, 1, 6), D(2024, 1, 7), 0), (D(2024, 1, 1), D(2024, 1, 15), 10), (D(2024, 1, 8), D(2024, 1, 8), 0)):
        assert one(spark, S.business_days(F.lit(a), F.lit(b)))[0] == n


def test_bands_and_hysteresis(spark):
    rows = series(spark, [(D(2024, 1, i + 1), v) for i, v in enumerate((50.0, 56.0, 55.0, 45.0, 44.9, 50.0, None))])
    got = [r.x for r in rows.select("d", N.hysteresis(C.band("v"), []).alias("x")).orderBy("d").collect()]
    assert got == ["NEUTRAL", "BULLISH", "BULLISH", "BULLISH", "BEARISH", "BEARISH", "BEARISH"]


def test_golden_score(spark):
    f = {"trend": 63.4, "impulse": 80, "credit": 91.45300970873788, "funding": 100, "rates": 48, "dollar": 0, "reserve": 71.8, "curve": 51.791666666666664, "vol": 88.9}
    assert one(spark, C.weighted_score({k: F.lit(float(v)) for k, v in f.items()}))[0] == pytest.approx(54.46193058252426, abs=1e-9)


def test_execution_bound(spark):
    prices = spark.createDataFrame([(D(2024, 1, 5), 100.0), (D(2024, 1, 8), 102.0), (D(2024, 1, 9), 101.0)], "d date, close double")
    at = lambda h, m, s: dt.datetime(2024, 1, 5, h, m, s)
    rows = [(1, at(12, 0, 0), at(16, 59, 59), 70.0, 1.0), (2, at(13, 0, 0), at(17, 0, 0), 70.0, 0.5), (3, at(14, 0, 0), at(21, 0, 0), 40.0, 0.25), (4, at(9, 0, 0), dt.datetime(2024, 1, 9, 18), 1.0, 0.0)]
    signals = spark.createDataFrame(rows, "idx long, decision_at timestamp, tradable_at timestamp, score double, target_exposure double")
    got = {r.idx: (r.exec_d, r.status, r.old_exposure) for r in M.schedule(signals, prices, keys=[]).collect()}
    assert got[1] == (D(2024, 1, 5), "EXECUTED", 0.0)
    assert got[2][1] == "SUPERSEDED" and got[3] == (D(2024, 1, 8), "EXECUTED", 1.0) and got[4][1] == "UNEXECUTED"


def test_constant_series_have_correlation_zero(spark):
    df = spark.createDataFrame([("a", 1.0, float(i)) for i in range(5)] + [("b", float(i), float(-i)) for i in range(5)], "k string, x double, y double")
    got = {r.k: r.ic for r in X.spearman(df, "x", "y", ["k"]).collect()}
    assert got == {"a": 0.0, "b": pytest.approx(-1.0)}


def test_typed_rates(spark):
    rows = [(60, 0.10, "BULLISH"), (40, -0.10, "BEARISH"), (70, -0.05, "NEUTRAL"), (30, 0.05, "BULLISH"), (50, 0.02, "NEUTRAL"), (55, 0.0, "BEARISH"), (80, 0.03, "BULLISH")]
    df = spark.createDataFrame([(float(s), f, v) for s, f, v in rows], "score double, fwd double, verdict string")
    got = df.agg(X.direction_rate("score", "fwd").alias("d"), X.verdict_rate("verdict", "fwd").alias("v")).first()
    assert (got.d.n, got.d.value) == (5, 0.6)
    assert (got.v.n, got.v.value, got.v.status) == (4, None, "INSUFFICIENT_SAMPLE")


def test_purge(spark):
    df = spark.createDataFrame([(D(2024, 7, 1),), (D(2024, 4, 1),), (D(2024, 3, 31),)], "outcome_d date")
    got = [r.split for r in T.purge(df, F.lit(D(2024, 7, 1))).collect()]
    assert got == ["PURGED", "EMBARGOED", "KEPT"]


def test_normal_functions_against_python(spark):
    for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.999):
        z, back = one(spark, S.probit(F.lit(p)), S.normal_cdf(S.probit(F.lit(p))))
        assert back == pytest.approx(p, abs=1e-6)
        assert 0.5 * (1 + math.erf(z / math.sqrt(2))) == pytest.approx(p, abs=1e-6)


def loop_mulberry32(seed, n):
    mask, a, out = 0xFFFFFFFF, seed, []
    for _ in range(n):
        a = (a + 0x6D2B79F5) & mask
        t = ((a ^ (a >> 15)) * (a | 1)) & mask
        t = ((t + (((t ^ (t >> 7)) * (t | 61)) & mask)) & mask) ^ t
        out.append((t ^ (t >> 14)) / 4294967296)
    return out


def loop_lcg(seed, n):
    out, x = [], seed
    for _ in range(n):
        x = (1664525 * x + 1013904223) & 0xFFFFFFFF
        out.append(x / 4294967296)
    return out


def test_generators(spark):
    got = [tuple(r) for r in spark.range(3000).select(M.mulberry32(12345, F.col("id")), M.lcg(11011, F.col("id"))).collect()]
    assert [g[0] for g in got] == loop_mulberry32(12345, 3000)
    assert [g[1] for g in got] == loop_lcg(11011, 3000)
    assert got[0][0] == 0.9797282677609473


def test_block_bootstrap(spark):
    draws = loop_mulberry32(7, 60)
    rows = spark.range(10).select(F.col("id").alias("idx"))
    got = sorted((r.iter, r.idx) for r in M.block_bootstrap(rows, n=10, block=4, iterations=3, draw=lambda k: M.mulberry32(7, k), first=5).collect())
    want, k = [], 5
    for b in range(3):
        out = []
        while len(out) < 10:
            start = int(draws[k] * 10)
            k += 1
            out += [(start + i) % 10 for i in range(4)]
        want += [(b, i) for i in out[:10]]
    assert got == sorted(want)


def test_dominance_count(spark, monkeypatch):
    monkeypatch.setattr(N, "RANK_BLOCK", 7)
    rows = [(k, D(2020, 1, 1) + dt.timedelta(i), None if i % 13 == 5 else float((i * i * 7) % 23)) for k in ("a", "b", None) for i in range(60 if k != "b" else 3)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    got = {(r.k, r.d): (r.n, r.s, r.m) for r in N.add_prior_mid_rank(N.expanding_share(N.earlier_at_most(df, "v", ["k"], name="n"), "v", ["k"], name="s"), "v", ["k"], 5, name="m").collect()}
    assert len(got) == len(rows)
    for k, d, v in rows:
        past = [x for j, e, x in rows if j == k and e < d]
        known = [x for x in past if x is not None]
        if v is None:
            assert got[k, d] == (None, None, None)
            continue
        n = sum(x <= v for x in known)
        mid = (sum(x < v for x in known) + 0.5 * sum(x == v for x in known)) / len(known) * 100 if len(known) >= 5 else None
        assert got[k, d] == (n, pytest.approx((n + 1) / (len(past) + 1)), None if mid is None else pytest.approx(mid))


def test_future_rows_change_nothing(spark):
    rows = [(D(2020, 1, 1) + dt.timedelta(7 * i), float((i * 37) % 101)) for i in range(120)]
    def run(rs):
        df = N.add_prior_mid_rank(series(spark, rs), "v", [], 52, name="p")
        return {r.d: (r.m, r.p) for r in df.select("d", N.prior_mad("v", []).alias("m"), "p").collect()}
    short, long_ = run(rows[:80]), run(rows)
    assert all(long_[d] == x for d, x in short.items())


def test_content_hash_ignores_order(spark):
    df = spark.range(100).select("id", (F.col("id") * 3).alias("x"))
    assert K.content_hash(df).first() == K.content_hash(df.orderBy(F.col("id").desc()).repartition(7)).first()
    assert K.content_hash(df).first() != K.content_hash(df.where("id > 0")).first()


def test_staged_commit(spark, tmp_path):
    root = str(tmp_path)
    first = K.activate(spark, root, K.stage(spark.createDataFrame([(1, 1.0)], "k int, v double"), root), ["k"], "v", None)
    second = K.activate(spark, root, K.stage(spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"), root), ["k"], "v", first)
    assert sorted(tuple(r) for r in spark.read.parquet(second).collect()) == [(1, 1.0), (2, 2.0)]
    with pytest.raises(K.CommitError):
        K.activate(spark, root, K.stage(spark.createDataFrame([(2, 3.0)], "k int, v double"), root), ["k"], "v", second)


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k long, v double"
    for part in ([(1, 1.0), (2, 2.0)], [(2, 9.0), (3, 3.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    like = spark.createDataFrame([], schema)
    for _ in range(2):
        G.ingest_once(G.read_stream(spark, source, like, 1), target, str(tmp_path / "ck"), ["k"])
    rows = spark.read.parquet(f"{target}/batch=*").collect()
    assert sorted(r.k for r in rows) == [1, 2, 3]


def test_a_replayed_batch_keeps_its_rows(spark, tmp_path):
    target, schema = str(tmp_path / "out"), "k long, v double"
    first, second = spark.createDataFrame([(1, 1.0), (2, 2.0)], schema), spark.createDataFrame([(2, 9.0), (3, 3.0)], schema)
    for number, batch in ((0, first), (0, first), (1, second), (1, second), (2, second)):
        G.write_batch(batch, number, target, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(target).collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_parameters_cannot_drift():
    assert len(P.SERIES) == 18 and sum(P.WEIGHTS.values()) == pytest.approx(1.0)
    assert P.digest() == "5ce25092efb8781e7b3ad9fd145427aca454254765350b6a45fd99d948b772d4"


def test_empty_tables(spark):
    empty = series(spark, [])
    assert A.asof_last(empty, empty, keys=[], carry=["v"]).count() == 0
    assert N.expanding_share(empty, "v", []).count() == 0
    assert T.earliest_exit_set(empty.withColumn("outcome_d", F.col("d")), []).count() == 0
    assert Row is not None
