import random

from pyspark.sql import functions as F

from verdigris.streaming import sessions as S

TURNS = "session_id string, turn long, score double, isSidechain boolean"


def feed(spark, path, n, rows, schema=TURNS):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{n:03d}")


def stream(spark, path, schema=TURNS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def test_buffers_keep_the_newest(spark, tmp_path):
    for k in range(4):
        feed(spark, tmp_path, k, [(s, k * 10 + i, 0.0, i % 5 == 0) for s in "ab" for i in range(10)])
    got = S.drain(S.buffered(S.arrivals(stream(spark, tmp_path)), 12, None), str(tmp_path))
    for s in "ab":
        rows = sorted(map(tuple, got.where(F.col("session_id") == s).select("seen", "kept", "oldest", "newest").collect()))
        turns = [k * 10 + i for k in range(4) for i in range(10) if i % 5]
        assert rows == [(8 * k, min(8 * k, 12), turns[max(0, 8 * k - 12)], turns[8 * k - 1]) for k in range(1, 5)]
    assert got.where("arrived_at is null").count() == 0


def test_a_restart_gives_no_second_target(spark, tmp_path):
    feed(spark, tmp_path, 0, [("a", i, 0.0, False) for i in range(5)] + [("b", 0, 0.0, False)])
    run = lambda: sorted(map(tuple, S.drain(S.due_turns(stream(spark, tmp_path).select("session_id", "turn"), None), str(tmp_path)).collect()))
    assert run() == [("a", 5, 3)]
    assert run() == [("a", 5, 3)]  # nothing new after a restart
    feed(spark, tmp_path, 1, [("a", 4, 0.0, False), ("b", 1, 0.0, False)])  # a turn comes again
    assert run() == [("a", 5, 3), ("b", 2, 0)]
    feed(spark, tmp_path, 2, [("a", 5, 0.0, False)])
    assert run() == [("a", 5, 3), ("a", 6, 4), ("b", 2, 0)]


def test_suppression_over_batches_and_restarts_is_that_of_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"s{i % 3}", i // 3, rng.choice([0.1, 0.7, 0.9, float("nan")]), False) for i in range(150)]
    run = lambda: S.drain(S.suppressed_stream(stream(spark, tmp_path), 0.6, None), str(tmp_path))
    for k in range(3):
        feed(spark, tmp_path, 2 * k, rows[50 * k : 50 * k + 50])
        feed(spark, tmp_path, 2 * k + 1, [(s, t, 0.9, False) for s, t, _, _ in rows[50 * k : 50 * k + 50]])  # evaluated once
        got = run()
    df = spark.createDataFrame(rows, TURNS)
    want = sorted((r.session_id, r.turn) for r in S.suppressed(df, 0.6).collect())
    assert sorted((r.session_id, r.turn) for r in got.collect()) == want and len(want) > 6
    twice = df.union(df.withColumn("score", F.lit(float("nan"))))
    assert sorted((r.session_id, r.turn) for r in S.suppressed(twice, 0.6).collect()) == want


def test_bursts_by_event_time_do_not_depend_on_batches(spark, tmp_path):
    rng, at, rows = random.Random(3), 1_700_000_000_000, []
    for _ in range(200):
        at += rng.choice([100, 900, 1900, 2000, 2600, 9000])
        rows.append((rng.choice("ab"), at))
    schema = "session_id string, ms long"
    ask = lambda p: S.debounced_by_event(stream(spark, p, schema).select("session_id", F.timestamp_millis("ms").alias("ts")), 2000)
    feed(spark, tmp_path / "one", 0, rows, schema)
    for k in range(8):
        feed(spark, tmp_path / "many", k, rows[25 * k : 25 * k + 25], schema)
    got = [sorted(map(tuple, S.drain(ask(tmp_path / p), str(tmp_path / p)).collect())) for p in ("one", "many")]
    want = []
    for s in "ab":
        mine = [t for x, t in rows if x == s]
        n = 0
        for t, nxt in zip(mine, [*mine[1:], None]):
            n += 1
            if (nxt if nxt is not None else at) - t >= 2000:
                want.append((s, n, t))
                n = 0
    assert got[0] == got[1] == sorted(want)
