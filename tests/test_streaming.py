"""Streams over several files, so state crosses micro-batches."""

from pyspark.sql import functions as F

from metroframe.streaming import feeds as ST
from metroframe.streaming import state as SS


def source(spark, tmp_path, batches, schema):
    """One file per micro-batch, in order."""
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i:02d}"))
        time.sleep(1.05)  # file sources order by modification time
    s = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(s).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def test_latest_appears_stays_and_leaves(spark, tmp_path):
    batches = [[(1, 0, 1.0), (2, 0, 5.0)], [(1, 3, 2.0)], [(1, 9, 3.0)], [(3, 30, 1.0)], [(3, 31, 1.0)]]
    stream = source(spark, tmp_path, batches, "k long, sec long, v double").select("k", F.timestamp_seconds(F.col("sec") + 1000).alias("ts"), "v")
    got = {(r.k, r.event_ms // 1000 - 1000, r.change) for r in ST.run_available(SS.snapshot_stream_diff(stream, "k", 8.0)).collect()}
    assert {(1, 0, "appear"), (2, 0, "appear"), (1, 3, "stay"), (1, 9, "stay"), (2, 8, "leave"), (1, 17, "leave"), (3, 30, "appear")} <= got


def test_keys_retire_and_return_however_rows_are_dealt(spark, tmp_path):
    """The same changes from one, three and seven micro-batches."""
    import random

    rnd = random.Random(2)
    rows = sorted({(rnd.randrange(4), rnd.randrange(0, 400)) for _ in range(60)}, key=lambda r: (r[1], r[0])) + [(9, 1000)]
    want = set()
    for k in range(4):
        times = [s for key, s in rows if key == k]
        for was, s, nxt in zip([None, *times], times, [*times[1:], None]):
            want.add((k, s, "appear" if was is None or s - was > 20 else "stay"))
            if nxt is None or nxt - s > 20:
                want.add((k, s + 20, "leave"))
    want.add((9, 1000, "appear"))
    for n in (1, 3, 7):
        cuts = [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]
        stream = source(spark, tmp_path / str(n), cuts, "k long, sec long").select("k", F.timestamp_seconds(F.col("sec") + 1000).alias("ts"))
        got = [(r.k, r.event_ms // 1000 - 1000, r.change) for r in ST.run_available(SS.snapshot_stream_diff(stream, "k", 20.0)).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_settled_commits(spark, tmp_path):
    batches = [[(0, i, v) for i, v in enumerate([1.0, 1.1, 0.9])], [(0, 3, 1.05), (0, 4, 1.0)], [(0, 5 + i, 9.0) for i in range(5)]]
    out = ST.run_available(SS.settled_grid(source(spark, tmp_path, batches, "cell long, seq long, value double"), ["cell"]))
    assert [(r.seq, r.value) for r in out.orderBy("seq").collect()] == [(3, 1.05), (9, 9.0)]


def test_bad_batch_keeps_last_good(spark, tmp_path):
    path = str(tmp_path / "good")
    sink = ST.last_good(lambda b: b.where("v > 0"), path)
    sink(spark.createDataFrame([(1, 2.0)], "k int, v double"), 0)
    sink(spark.createDataFrame([(1, -2.0)], "k int, v double"), 1)
    rows = ST.read_last_good(spark, path).collect()
    assert [(r.k, r.v, r.stale) for r in rows] == [(1, 2.0, True)]

    def broken(batch):
        raise ValueError("bad payload")

    ST.last_good(broken, path)(spark.createDataFrame([(1, 3.0)], "k int, v double"), 2)
    assert ST.read_last_good(spark, path).first().error == "bad payload"


def test_track_stream_equals_batch(spark):
    from metroframe.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    a, b = QUERIES["track_stream"](spark, sf), QUERIES["associate_tracks"](spark, sf)
    assert a.exceptAll(b).isEmpty() and a.count() == b.count() > 0


def test_flow_windows_are_whole(spark, tmp_path):
    """A window split between micro-batches gives the flows of the whole window."""
    rows = [("c", 0, f, d, 2, 0.1 + 0.05 * (f % 10) + d * 0.3, 0.2 + 0.02 * (f % 10), f) for f in range(40) for d in (0, 1)]
    cols = "camera string, quad int, frame long, det_id long, cls int, u double, v double, sec long"
    batches = [rows[i : i + 17] for i in range(0, len(rows), 17)] + [[("z", 0, 999, 0, 2, 0.5, 0.5, 999)]]
    stream = source(spark, tmp_path, batches, cols).withColumn("ts", F.timestamp_seconds(F.col("sec") + 1200)).drop("sec")
    # rows at the watermark itself count as late, and frames here are split between batches
    q = ST.flow_window_stream(stream, str(tmp_path / "out"), 12, late="2 seconds").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out" / "flows")).where("camera = 'c'")
    whole = ST.flow_window(spark.createDataFrame(rows, cols).withColumn("ts", F.timestamp_seconds(F.col("sec") + 1200)), 12)
    pick = lambda df: sorted((r.window_start, r.side, r["count"], round(r.speed, 9)) for r in df.collect())
    assert pick(got) == pick(whole) and whole.count() > 0
