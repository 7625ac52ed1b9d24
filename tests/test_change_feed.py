import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkloom.functions.timestamps import moment_micros
from linkloom.operators import change_feed
from linkloom.operators.change_feed import DeltaTable, current_links

SCHEMA = "seq bigint, requirementId string, proposedSymbolId string, symbolId string, kind string, timestamp string, receivedAt timestamp, note string, `__deleted` string, moment string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute(rows):
    last = {}
    for seq, req, prop, sym, kind, ts, *_ in rows:
        req = (req or "").strip().upper() or None
        prop = (prop or "").strip().replace("\\", "/") or None
        kind = (kind or "").strip().lower()
        if not req or not prop or kind not in ("accept", "reject", "redirect") or ts is None:
            continue
        try:
            moment = datetime.fromisoformat(ts.strip().replace("Z", "+00:00"))
        except ValueError:
            continue
        moment = moment.timestamp() if moment.tzinfo else (moment - datetime(1970, 1, 1)).total_seconds()
        key, order = (req, prop), (moment, seq)
        if key not in last or order > last[key][0]:
            last[key] = (order, kind, (sym or "").strip().replace("\\", "/") or None, seq)
    return sorted(((k[0], k[1], sym, seq) for k, (_, kind, sym, seq) in last.items() if kind != "reject"), key=str)


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_random_feed_equals_brute_force(spark, batches):
    rng = random.Random(batches)
    base = datetime(2025, 1, 1)
    rows = []
    for seq in range(400):
        hot = rng.random() < 0.35
        req = rng.choice([" req-1", "REQ-1 "]) if hot else f"REQ-{rng.randint(2, 30)}"
        ts = rng.choice([(base + timedelta(seconds=rng.randint(0, 50))).isoformat() + "Z", "pending", "2025-02-30T00:00:00Z", None, (base + timedelta(seconds=rng.randint(0, 50))).isoformat() + "+02:00"])
        row = (seq, rng.choice([req, req, req, None, "  "]), rng.choice(["ts:a\\b#x:function", "ts:a/b#x:function", "y", None]), rng.choice(["s", "t ", None, ""]), rng.choice(["accept", "Reject ", "REDIRECT", "undo", None]), ts)
        for _ in range(rng.choice([1, 1, 2])):
            rows.append((*row, rng.choice([base + timedelta(hours=rng.randint(0, 99)), None]), "n", "x", "y"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(current_links(df, batches)) == brute(rows)


def test_empty_feed(spark):
    assert current_links(spark.createDataFrame([], SCHEMA)).collect() == []


def test_late_change_does_not_revive_a_deleted_link(spark, tmp_path):
    table = DeltaTable(spark, f"file://{tmp_path}/t", ["k"], ["o"], ["v"])
    schema = "k string, o bigint, v string, `__deleted` boolean"
    table.apply(spark.createDataFrame([("a", 5, "x", True), ("b", 1, "y", False)], schema))
    table.apply(spark.createDataFrame([("a", 3, "z", False), ("b", 2, "w", False), ("b", 2, "w", False)], schema))
    assert rows_of(table.read()) == [("b", 2, "w")]
    again = DeltaTable(spark, f"file://{tmp_path}/t", ["k"], ["o"], ["v"])
    again.apply(spark.createDataFrame([("a", 9, "n", False), ("b", 2, "w", False)], schema))
    assert again.batches == 3
    assert rows_of(again.read()) == [("a", 9, "n"), ("b", 2, "w")]


def test_reads_in_groups_of_files(spark, tmp_path, monkeypatch):
    """Bitmaps beyond the bound go out in groups of files; files without one are read as they are."""
    table = DeltaTable(spark, f"file://{tmp_path}/t", ["k"], ["o"], ["v"])
    rows = spark.range(0, 3000, 1, 6).select(F.col("id").alias("k"), F.lit(1).alias("o"), F.lit("a").alias("v"), F.lit(False).alias("__deleted"))
    table.apply(rows)
    table.apply(rows.filter("k < 900").withColumn("o", F.lit(2)).withColumn("v", F.lit("b")))
    table.apply(rows.filter("k < 100").withColumn("o", F.lit(3)).withColumn("__deleted", F.lit(True)))
    whole = rows_of(table.read())
    monkeypatch.setattr(change_feed, "BITMAP_BYTES", 1)
    assert rows_of(table.read()) == whole and len(whole) == 2900
    assert "Exchange hashpartitioning" not in table.read()._jdf.queryExecution().executedPlan().toString()


def test_many_rows_in_one_file_use_several_bitmaps(spark, tmp_path):
    table = DeltaTable(spark, f"file://{tmp_path}/t", ["k"], ["o"], ["v"])
    first = spark.range(0, 70_000, 1, 1).select(F.col("id").alias("k"), F.lit(1).alias("o"), F.lit("a").alias("v"), F.lit(False).alias("__deleted"))
    table.apply(first.coalesce(1))
    table.apply(first.filter("k % 7 = 0").withColumn("o", F.lit(2)).withColumn("v", F.lit("b")))
    found = dict(table.read().groupBy("v").count().collect())
    assert found == {"a": 60_000, "b": 10_000}


@pytest.mark.parametrize(
    ("text", "micros"),
    [
        ("1970-01-01T00:00:01Z", 1_000_000), ("1970-01-01 00:00:01.5", 1_500_000), ("1970-01-01T02:00:00+02:00", 0), ("1969-12-31T20:30:00-0330", 0),
        ("1970-01-01T00:00:00.1234567Z", 123_456), ("1970-01-01T05:00+05", 0), ("2025-02-30T00:00:00Z", None), ("2026-13-41T25:00:00Z", None), ("0000-00-00", None), ("last week", None), ("", None), (None, None),
    ],
)
def test_moments(spark, text, micros):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(moment_micros(F.col("t"))).first()[0] == micros


def test_stream_of_decisions(spark, tmp_path):
    from linkloom.streaming.decision_stream import LinkStream

    columns = "seq bigint, requirementId string, proposedSymbolId string, symbolId string, kind string, timestamp string, receivedAt timestamp"
    source, links = str(tmp_path / "in"), LinkStream(spark, f"file://{tmp_path}/links")
    batches = [[(1, "r", "s", "s", "accept", "2025-01-01T00:00:00Z", None)], [(3, "r", "s", "t", "redirect", "2025-01-03T00:00:00Z", None)], [(2, "r", "s", "s", "reject", "2025-01-02T00:00:00Z", None)]]
    for rows in batches:
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(columns).parquet(source)
        links.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert rows_of(links.links()) == [("R", "s", "t", 3)]
