"""Deliveries with timers, replays and late causes: restarts, late rows and bounded state."""

import random

from pyspark.sql import functions as F

from graphloom.streaming import outbox as O

REPORT = "delivery_id long, at long, report_id long, status int, wait long"


def test_deliveries_go_on_after_a_restart_and_are_forgotten(spark, tmp_path):
    rng = random.Random(3)
    start = 1_700_000_000_000
    rows = [(i % 30, start + i * 60_000, i, rng.choice([200, 503, 429, 404, 500, 408]), rng.choice([None, 5, 10_000, 10**9])) for i in range(200)]
    rows += [(77, start + 200 * 60_000 + i, 1000 + i, 503, 10) for i in range(100)]  # more reports than attempts
    rows += [(None, start, 2000, 200, None), (5, None, 2001, 200, None), (5, start, 2002, None, None)]
    late = [(900, start + 40 * 86_400_000, 3000, 503, 1000)]
    source, held = str(tmp_path / "in"), []
    for part in (rows[:90], rows[90:], late, [(901, late[0][1] + 7_200_000, 3001, 200, None)]):
        spark.createDataFrame(part, REPORT).coalesce(1).write.mode("append").parquet(source)
        said = O.deliver_available(spark.readStream.schema(REPORT).parquet(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        held.append(said["held"])
    got = spark.read.parquet(str(tmp_path / "out"))
    table = spark.createDataFrame([r for r in rows + late if None not in r[:2] and r[3] is not None] + [(901, late[0][1] + 7_200_000, 3001, 200, None)], REPORT)
    want = sorted(map(tuple, O.folded_states(table).collect()))
    assert sorted(map(tuple, O.latest_states(got).collect())) == want and len(want) == 33
    assert {r.state for r in got.filter("delivery_id = 77").collect()} == {"dead"}
    # What was still pending fell due once, and a day later nothing is held of what was closed.
    pending = {r[0] for r in want if r[2] == "pending"}
    assert {r.delivery_id for r in got.filter("state = 'due'").collect()} == pending
    assert held[-1] < held[1]


def test_replays_are_dropped_and_late_rows_counted(spark, tmp_path):
    schema = "principal string, key string, ts timestamp"
    at = lambda minute: f"2024-01-01 0{minute // 60}:{minute % 60:02d}:00"
    frame = lambda rows: spark.createDataFrame(rows, "principal string, key string, t string").select("principal", "key", F.to_timestamp("t").alias("ts"))
    source = str(tmp_path / "in")
    batches = [[("p", "k", at(0)), ("p", "k", at(1)), ("p", None, at(1)), ("p", None, at(1)), (None, "k", at(2))], [("p", "k", at(5)), ("q", "k", at(200)), ("q", "k", at(201))], [("p", "late", at(3)), ("r", "k", at(202))]]
    late = 0
    for rows in batches:
        frame(rows).coalesce(1).write.mode("append").parquet(source)
        late += O.run(O.once(spark.readStream.schema(schema).parquet(source), ["principal", "key"], "ts", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))["late"]
    got = sorted((tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    assert got == sorted([("p", "k"), ("p", None), ("p", None), (None, "k"), ("q", "k"), ("r", "k")], key=repr) and late == 1


def test_causes_that_come_later(spark, tmp_path):
    schema = "event_id long, causation long, correlation long, hop int, ts timestamp"
    source = str(tmp_path / "in")
    frame = lambda rows: spark.createDataFrame(rows, "event_id long, causation long, correlation long, hop int, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    batches = [[(2, 1, 7, 1, "2024-01-01 00:05:00"), (3, None, 7, 0, "2024-01-01 00:00:00"), (4, None, 7, 2, "2024-01-01 00:00:00"), (9, 99, 7, 1, "2024-01-01 00:06:00")], [(1, None, 7, 0, "2024-01-01 00:01:00"), (5, 2, 7, 1, "2024-01-01 00:07:00")], [(50, None, 1, 0, "2024-01-03 00:00:00")], [(51, None, 1, 0, "2024-01-05 00:00:00")]]
    for rows in batches:
        frame(rows).coalesce(1).write.mode("append").parquet(source)
        streams = [spark.readStream.schema(schema).parquet(source) for _ in range(2)]
        O.run(O.with_causes(*streams, "1 hour"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r.event_id: r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {2: "ok", 3: "ok", 4: "wrong", 1: "ok", 5: "wrong", 9: "unknown", 50: "ok", 51: "ok"}
