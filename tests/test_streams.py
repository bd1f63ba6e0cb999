"""Scorers and fusion as streams: row by row what the batch queries give."""

import math
import time

import pytest
from pyspark.sql import functions as F

from tidewatch import queries
from tidewatch.config import Fusion
from tidewatch.operators import buckets, drift, fusion, rate
from tidewatch.sources import sinks
from tidewatch.streaming import jobs, scorers

S, HALF = queries.SECONDS, queries.HALFLIFE


@pytest.fixture(scope="module")
def by_day(spark, sf, tmp_path_factory):
    """Telemetry in files of three days each, in the order of time, and the same as a table."""
    path = str(tmp_path_factory.mktemp("tele"))
    rows = queries.tele(spark, sf).persist()
    for day in range(0, 31, 3):
        part = rows.filter(F.floor((F.col("t") - queries.START) / 86400 / 3) == day // 3)
        part.coalesce(1).write.mode("append").parquet(f"{path}/rows")
    return f"{path}/rows", rows


@pytest.fixture(autouse=True)
def stores(spark):
    scorers.keep_state(spark)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def finished(df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(600)
    return df.sparkSession.table(name)


def rows_of(df, *names):
    return sorted(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())


def test_rate_scores_on_a_stream(spark, by_day):
    path, table = by_day
    z = scorers.z_scores(scorers.features(scorers.clocked(stream(spark, path, table.schema)), S))
    got = finished(rate.score(z), "rate_stream")
    want = rate.score(rate.z_scores(buckets.features(buckets.grains(table, S))))
    open_ = got.agg(F.max("bucket")).first()[0]
    names = ("bucket", "entity_type", "entity_id", "event_count", "score", "alert_type", "is_anomalous", "warming_up", "n")
    assert rows_of(got, *names) == rows_of(want.filter(F.col("bucket") <= open_), *names)
    assert want.filter(F.col("bucket") > open_).select("bucket").distinct().count() == 1  # the last bucket is still open


def test_drift_on_a_stream(spark, by_day):
    path, table = by_day
    payers = scorers.payer_buckets(scorers.clocked(stream(spark, path, table.schema)), S, queries.DRIFT.event_cap)
    got = finished(scorers.charts(payers, 3, queries.DRIFT), "drift_stream")
    whole = drift.charts(drift.grid(buckets.payer_buckets(table, S, queries.DRIFT.event_cap), queries.DRIFT), queries.DRIFT)
    last = got.agg(F.max("bucket")).first()[0]
    names = [c for c in drift.COLUMNS if c not in ("since_volume", "since_amount")]
    assert rows_of(got, *names) == rows_of(whole.filter(F.col("bucket") <= last), *names)
    assert rows_of(drift.assess(got, queries.DRIFT).filter("is_anomalous"), "bucket", "payer", "score") != []


@pytest.fixture(scope="module")
def hits(spark, sf, tmp_path_factory):
    """Gated score documents, a file for each few days."""
    path = str(tmp_path_factory.mktemp("hits")) + "/rows"
    docs = queries.score_docs(spark, sf).select("entity_type", "entity_id", "model", "t", "score", "is_anomalous", "event_count", "reasons").persist()
    for part in range(0, 31, 4):
        docs.filter(F.floor((F.col("t") - queries.START - 1) / 86400 / 4) == part // 4).coalesce(1).write.mode("append").parquet(path)
    return path, docs


def test_levels_on_a_stream_are_those_of_the_batch(spark, hits, tmp_path):
    path, docs = hits
    rows = fusion.hits(fusion.gate(scorers.clocked(stream(spark, path, docs.schema))))
    ticks = scorers.entity_ticks(rows, queries.START, queries.TICK, HALF, prune=0.0)
    out = str(tmp_path / "levels")
    write = scorers.write_levels(spark, out, queries.START, queries.TICK)
    seen = []

    def twice(batch, number):
        seen.append(number)
        write(batch, number)
        write(batch, number)  # a batch that runs again changes nothing

    q = ticks.writeStream.foreachBatch(twice).trigger(availableNow=True).start()
    assert q.awaitTermination(900)
    got = spark.read.parquet(out)
    end = got.agg(F.max("tick")).first()[0]
    contributed = fusion.contributions(fusion.gate(docs), halflife=HALF)
    st = fusion.entity_states(fusion.at_ticks(contributed, queries.START, queries.TICK, end, HALF))
    want = fusion.levels(spark, fusion.picture(st), queries.START, queries.TICK, end)
    names = ("tick", "global_score", "level", "previous", "lit_entities", "corroboration")
    assert rows_of(got, *names) == rows_of(want, *names) and got.count() > 300 and len(seen) > 4
    assert {r["level"] for r in got.collect()} >= {"normal", "elevated"}


def test_faded_entities_leave_the_state(spark, tmp_path):
    """Claims decay by timers alone; below .01 the entity goes, and a later hit starts from nothing."""
    schema = "entity_type string, entity_id string, model string, t long, score double, is_anomalous boolean, event_count long, reasons array<string>"
    times = [("a", 0, 1.0), ("b", 100, 0.5), ("c", 2000, 0.5), ("a", 4000, 0.4), ("z", 6000, 1.0), ("z", 8000, 1.0)]
    zero = 60_000
    for e, t, s in times:
        spark.createDataFrame([("payer", e, "rate", zero + t, s, True, 50, ["x"])], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    rows = fusion.hits(fusion.gate(scorers.clocked(stream(spark, str(tmp_path / "rows"), spark.read.parquet(str(tmp_path / "rows")).schema))))
    ticks = scorers.entity_ticks(rows, zero, 60, 120.0)
    q = ticks.writeStream.outputMode("append").format("memory").queryName("faded").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    got = {(r["entity_id"], r["tick"] - zero): r["entity_score"] for r in spark.table("faded").collect()}
    w = Fusion().weights["rate"]
    life = lambda claim: 120 * math.log2(claim / 0.01)
    assert max(t for e, t in got if e == "a" and t < 4000) == 60 * math.floor(life(w) / 60)
    assert got["a", 4020] == pytest.approx(w * 0.4 * 2 ** (-20 / 120)) and got["b", 120] == pytest.approx(w * 0.5 * 2 ** (-20 / 120))
    assert not any(e == "c" and t > 2000 + life(w * 0.5) for e, t in got) and kept <= 1


def test_a_stream_goes_on_from_a_batch(spark, by_day, tmp_path):
    """Baselines of a batch run over the first half are the initial state of a stream over the second."""
    _, table = by_day
    feats = buckets.features(buckets.grains(table, S))
    first, then = feats.filter(F.col("bucket") < queries.MIDDLE), table.filter(F.col("t") >= queries.MIDDLE)
    for i, (a, b) in enumerate([(0, 5), (5, 40)]):
        then.filter(F.floor((F.col("t") - queries.MIDDLE) / 86400).between(a, b - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    z = scorers.z_scores(scorers.features(scorers.clocked(stream(spark, str(tmp_path / "rows"), table.schema)), S), initial=rate.baselines(first, final=True))
    got = finished(z, "resumed_stream")
    last = got.agg(F.max("bucket")).first()[0]
    names = ("bucket", "entity_type", "entity_id", "n", "event_count_z", "mean_payload_z", "error_ratio_z")
    want = rate.z_scores(feats).filter((F.col("bucket") >= queries.MIDDLE) & (F.col("bucket") <= last))
    assert rows_of(got, *names) == rows_of(want, *names)


def test_a_failed_writer_leaves_one_copy(spark, by_day, tmp_path):
    """The second writer fails once, after the first has written: the batch comes again and nothing is there twice."""
    path, table = by_day
    failed = []

    def second(batch, number):
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("the topic is away")
        sinks.daily_batches(str(tmp_path / "copy"))(batch, number)

    def start():
        rows = stream(spark, path, table.schema).select("t", "event_id", "rep")
        writers = sinks.fan_out(sinks.daily_batches(str(tmp_path / "store")), second)
        return rows.writeStream.foreachBatch(writers).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="topic is away"):
        start().awaitTermination(300)
    assert start().awaitTermination(300)
    for name in ("store", "copy"):
        assert rows_of(spark.read.parquet(str(tmp_path / name)), "t", "event_id", "rep") == rows_of(table, "t", "event_id", "rep")
    assert failed == [1]


def test_late_rows_are_counted(spark, tmp_path):
    for t in (600, 1200, 1800, 100, 2400):  # the fourth is late
        spark.createDataFrame([(t, "a", 10, False)], "t long, payer_id string, payload_bytes long, error boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    late = jobs.LateRows()
    spark.streams.addListener(late)
    try:
        feats = scorers.features(scorers.clocked(stream(spark, str(tmp_path / "rows"), spark.read.parquet(str(tmp_path / "rows")).schema)), 60)
        q = feats.writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        for _ in range(100):
            if late.counts.get(str(q.id)):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(late)
    assert late.counts[str(q.id)] == 2  # in the grain of all and in the payer's
    assert sorted(r["bucket"] for r in spark.table("late").filter("entity_type = 'global'").collect()) == [600, 1200, 1800]
