"""Streams with keyed state give what the batch queries give, across a restart and with rows that come twice."""

import pytest

from kairoscope.plans import keyed
from kairoscope.plans.harness import QUERIES
from kairoscope.streaming import stateful

SF = "/root/testdata/sf0.001"
STREAMS = {
    "judged_events": stateful.judged_stream,
    "limited_events": lambda events: stateful.limited_stream(events, limit=keyed.LIMIT, seconds=keyed.SECONDS),
}


@pytest.mark.parametrize("name", sorted(STREAMS))
def test_stream_equals_batch_across_a_restart(spark, tmp_path, name):
    stateful.use_keyed_state(spark)
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").toPandas()
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    schema = spark.read.parquet(f"{SF}/events.parquet").schema

    def arrive(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        STREAMS[name](stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    third = len(events) // 3
    arrive(events[:third].sample(frac=1.0, random_state=1))
    run()
    arrive(events[third : 2 * third])
    arrive(events[third - 50 : third])  # come twice
    run()  # a new query on the old checkpoint
    arrive(events[2 * third :])
    run()
    got, want = spark.read.parquet(out), QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
