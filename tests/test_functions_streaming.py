from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from floeline.functions.cron import duration_ns, fire, next_fire, parsed
from floeline.functions.scalars import backoff_ns, labels_match, seal, short_label, unseal
from floeline.streaming import events as streams

DATA = "/root/testdata/sf0.001"


def at(*when: int) -> int:
    return int(datetime(*when, tzinfo=UTC).timestamp()) * 10**9


@pytest.mark.parametrize(
    ("spec", "after", "want"),
    [
        ("* * * * *", at(2024, 1, 1, 0, 0), at(2024, 1, 1, 0, 1)),
        ("*/15 * * * *", at(2024, 1, 1, 0, 50), at(2024, 1, 1, 1, 0)),
        ("30 6 * * *", at(2024, 1, 1, 6, 30), at(2024, 1, 2, 6, 30)),
        ("0 0 29 2 *", at(2024, 3, 1), at(2028, 2, 29)),
        ("0 12 1 * mon", at(2024, 1, 2), at(2024, 1, 8, 12)),
        ("0 9-17/4 * jan-mar 1-5", at(2024, 3, 29, 18), at(2025, 1, 1, 9)),
        ("5/20 * * * *", at(2024, 1, 1, 0, 26), at(2024, 1, 1, 0, 45)),
        ("@weekly", at(2024, 1, 1), at(2024, 1, 7)),
        ("@every 1h30m", at(2024, 1, 1), at(2024, 1, 1, 1, 30)),
        ("0 0 31 2 *", at(2024, 1, 1), 0),
    ],
)
def test_next_fire(spec, after, want):
    assert next_fire(spec, after) == want


@pytest.mark.parametrize("spec", ["", "* * * *", "60 * * * *", "* * * * 7", "5-1 * * * *", "@every 0s", "@every 1x"])
def test_bad_schedules_are_refused(spec):
    with pytest.raises(ValueError):
        parsed(spec)


def test_durations():
    assert duration_ns("1.5s") == 1_500_000_000
    assert duration_ns("250ms") == 250_000_000


def test_due_schedules_fire_once(spark):
    now = at(2024, 1, 1, 12)
    rows = [("late", "@hourly", at(2024, 1, 1, 3)), ("now", "@every 5s", now), ("later", "@hourly", now + 1), ("unset", "@daily", 0)]
    got = fire(spark.createDataFrame(rows, "name string, spec string, next_at long"), now).collect()
    assert sorted(map(tuple, got)) == [("late", at(2024, 1, 1, 3), at(2024, 1, 1, 13)), ("now", now, now + 5 * 10**9)]


def test_backoff_is_capped(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 7, 60)], "n int")
    assert [r[0] for r in df.select(backoff_ns("n")).collect()] == [500_000_000, 500_000_000, 1_000_000_000, 2_000_000_000, 30_000_000_000, 30_000_000_000]


def test_sealed_payloads(spark):
    key = bytes(range(32))
    df = spark.createDataFrame([("hello",), ("",), (None,)], "p string").withColumn("s", seal("p", key))
    rows = df.select("p", F.length("s").alias("n"), unseal("s", key).alias("back"), unseal("s", bytes(32)).alias("wrong")).collect()
    assert [tuple(r) for r in rows] == [("hello", 34, "hello", None), ("", 29, "", None), (None, None, None, None)]
    with pytest.raises(ValueError):
        seal("p", b"short")


def test_labels(spark):
    df = spark.createDataFrame([("",), ("gpu",), ("gpu,linux",)], "labels string")
    assert [r[0] for r in df.select(labels_match("labels", ["gpu"])).collect()] == [True, True, False]
    assert [r[0] for r in df.select(labels_match("labels", [])).collect()] == [True, False, False]
    assert spark.range(1).select(short_label(F.lit("abcdef"), 4)).first()[0] == "abc…"


def test_waits_meet_events_of_their_time(spark, tmp_path):
    day = lambda d, h=0: datetime(2024, 1, d, h)
    spark.createDataFrame([("s1", "pay", day(1), day(3)), ("s2", "pay", day(2, 12), day(3)), ("s3", "ship", day(1), day(2))], "step_id string, name string, registered timestamp, deadline timestamp").write.parquet(f"{tmp_path}/waits")
    spark.createDataFrame([(1, "pay", "{}", day(2)), (2, "ship", "{}", day(2))], "seq long, name string, payload string, at timestamp").write.parquet(f"{tmp_path}/events")
    read = lambda name: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}").schema).parquet(f"{tmp_path}/{name}")
    got = streams.drained(streams.resolved_waits(read("events"), read("waits")), "waits").collect()
    assert [(r.step_id, r.name) for r in got] == [("s1", "pay")]


def test_windows_count_every_event(spark):
    events = streams.emitted_stream(spark, f"{DATA}/events.parquet")
    query = streams.counts_by_window(events).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()
