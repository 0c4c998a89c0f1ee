from __future__ import annotations

import json

from pyspark.sql import functions as F

from ledgerlens.operators import folds
from ledgerlens.sources import readers, sinks
from ledgerlens.streaming import bars as stream


def test_csv_bars(spark, tmp_path):
    p = tmp_path / "bars.csv"
    p.write_text("﻿date,open,high,low,close,vol\n2024-01-02,1,2,0.5,1.5,100\n2024-01-02,1,2,0.5,1.6,100\n2024-01-03,bad,2,1,1,5\nnot a day,1,2,1,1,5\n2024-01-04,1,3,1,2,7\n", encoding="utf-8")
    got = readers.read_bars_csv(spark, str(p), symbol="X").orderBy("dt").collect()
    assert [(str(r.dt), r.close, r.volume) for r in got] == [("2024-01-02", 1.6, 100.0), ("2024-01-04", 2.0, 7.0)]
    assert readers.read_bars_csv(spark, str(p), symbol="X", limit=1).count() == 1


def test_json_bars_items_and_notes(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"symbol": "S", "date": ["2024-01-02", "2024-01-03"], "open": [1, 2], "high": [2, 3], "low": [1, 1], "close": [1.5, 2.5], "volume": [5, 6], "amount": [None, 1]}))
    assert readers.read_bars_json(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "i.jsonl").write_text('{"title": "t", "likes": 3, "extra": {"k": "v"}}\nnot json\n')
    items = readers.read_items(spark, str(tmp_path / "i.jsonl")).collect()
    assert items[0].extra == {"k": "v"} and items[1].title is None
    (tmp_path / "n.md").write_text('---\n{"stock": "A"}\n---\nBody text\n')
    (note,) = readers.read_notes(spark, str(tmp_path / "n.md")).collect()
    assert note.meta == {"stock": "A"} and note.body.strip() == "Body text"
    assert readers.newest(spark, str(tmp_path), "*.md").first().path.endswith("n.md")


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sinks.changed(sinks.with_hash(old), sinks.with_hash(old.unionByName(new))).count() == 2
    md = sinks.markdown(old.withColumn("g", F.lit(1)).withColumn("t", F.lit("Title")), "g", "t", "v", "k").first().markdown
    assert md == "# Title\n- a\n- b"
    sinks.write_sidecar(new, str(tmp_path / "s"))
    sinks.write_bars(old.withColumnRenamed("k", "symbol"), str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2 and spark.read.parquet(str(tmp_path / "b")).count() == 2


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, timestamp_seconds(1704067200 + id * 97) AS ts, id % 5 AS user_id, concat('e', id % 2) AS event_type, CAST(id % 13 AS DOUBLE) AS value, '' AS props FROM range(400)")
    for k in range(3):
        rows.where(F.floor(F.col("event_id") / 150) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.event_bars(live).writeStream.format("memory").queryName("live_bars").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    a, b = spark.table("live_bars"), stream.event_bars(rows)
    assert a.count() == b.count() > 10 and a.exceptAll(b).count() == 0


def test_state_goes_on_across_batches(spark, tmp_path):
    bars = spark.sql("SELECT 'A' AS symbol, timestamp_seconds(id * 3600) AS start, CAST(10 + (id * 7) % 5 AS DOUBLE) AS close FROM range(20)")
    for k in range(2):
        bars.where(F.floor(F.unix_timestamp("start") / 36000) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.track_stage(live).writeStream.format("memory").queryName("stages").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("stages").orderBy("bars").collect()
    ema = None
    for (c,) in bars.orderBy("start").select("close").collect():
        ema = c if ema is None else 2 / 13 * c + 11 / 13 * ema
    assert [r.bars for r in got] == [10, 20] and abs(got[-1].ema - ema) < 1e-9


def test_folds_cover_everything(spark):
    text = ("A sentence here. " * 30 + "\n") * 5
    cuts = folds.chunks_of(text, 300)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(a[1] == b[0] and a[1] - a[0] <= 300 for a, b in zip(cuts, cuts[1:], strict=False))
    assert folds.batches_of([100, 100, 5000, 10], 400) == [0, 0, 1, 2]
    assert all(len(b) <= 260 for b in folds.blocks_of(text, 260)) and "".join(folds.blocks_of(text, 260)).replace(" ", "") == text.replace(" ", "").replace("\n", "")
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert folds.chunk_pack(df).count() == len(folds.chunks_of(text, 2000))
    assert {r.doc_id for r in folds.prose_blocks(df).collect()} == {1}
