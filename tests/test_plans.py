"""Composite pipelines and streaming forms on small literals."""

from pyspark.sql import functions as F

from versewise.plans import lyrics, scores
from versewise.streaming import streams


def test_normalise_lyrics(spark):
    text = "[Verse 1]\nHello  there (oh yeah) , friend\n> don`t go\n(ooh)\n\nWritten by:  A  B\n...\n1, 2\n(x)\n"
    lines, dropped, credits = lyrics.normalise_lyrics(spark.createDataFrame([("r", text), ("s", "(alone)\nword")], "recording_id string, text string"))
    got = [(r.line_id, r.text, r.background, r.second_voice, r.source_line, r.start_utf16) for r in lines.where("recording_id = 'r'").orderBy("line_id").collect()]
    assert got == [(0, "Hello there, friend", "oh yeah", False, 2, 0), (1, "don’t go", "ooh", True, 3, 20), (2, "1, 2", "x", False, 8, 29)]
    assert {(r.recording_id, r.source_line, r.reason) for r in dropped.collect()} == {("r", 1, "section label"), ("r", 7, "no letters"), ("s", 1, "background vocals without a preceding line")}
    assert [(r.recording_id, r.names) for r in credits.collect()] == [("r", "A B")]


def test_scores(spark):
    kind = "recording_id string, line_id int, text string, begin_us long, end_us long"
    ref = spark.createDataFrame([("r", 1, "a line", 0, 1000000), ("r", 2, "a line", 5000000, 6000000), ("r", 3, "ooh", 7000000, 8000000), ("r", 4, "x", 9000000, 9500000)], kind)
    est = spark.createDataFrame([("r", 1, "a line", 5000000, 5500000), ("r", 2, "a line", 5200000, 6100000), ("r", 3, "ooh", None, None), ("r", 4, "y", 9000000, 9500000)], kind)
    pairs, bad = scores.positional_join(est, ref)
    assert [(r.row, r.rule_id) for r in bad.collect()] == [("4", "text_mismatch")]
    assert [r.line_id for r in scores.wrong_repeats(pairs).collect()] == [1]
    s = scores.full_song_score(pairs).first()
    assert (s.lines, s.placed, s.overlapping, s.wrong_repeats) == (3, 2, 1, 1)
    q = {r.group: r for r in scores.qualification(pairs).collect()}
    assert (q["all"].lines, q["all"].vocables, q["all"].right, q["all"].wrong) == (2, 1, 1, 1)


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", k, f"t{s}", float(s)) for s, k in ((1, "a"), (3, "a"), (2, "b"), (40, "a"), (55, "b"))]
    df = spark.createDataFrame(rows, "ts string, k string, text string, value double").withColumn("ts", F.to_timestamp("ts"))
    for i in range(5):
        df.where(F.col("text") == rows[i][2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def drain(out, name):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    runs = drain(streams.session_runs(stream(), "ts", "k", "10 seconds", "1 second"), "runs")
    assert ("a", 2) in {(r.k, r.n) for r in runs}
    hops = drain(streams.hopping_counts(stream(), "ts", "k", "10 seconds", "10 seconds", "1 second"), "hops")
    assert {(r.k, r.n) for r in hops} >= {("a", 2), ("b", 1)}
    focus = drain(streams.live_focus(stream(), "k", "ts", "text", 5, "1 second"), "focus")
    assert {(r.text, r.state) for r in focus} >= {("t1", "focused"), ("t40", "focused")}
    q = df.where("k = 'a'").select(F.to_date("ts").alias("day"), F.col("ts").alias("observed_at"), F.col("value").alias("count"))
    step = streams.daily_upsert(str(tmp_path / "daily"))
    step(q.where("count < 10"), 0)
    step(q.where("count > 10"), 1)
    assert spark.read.parquet(str(tmp_path / "daily" / "version=1")).first()["count"] == 40.0
    late = streams.split_late(str(tmp_path / "late"), "ts", 10)
    late(df.where("text = 't40'"), 0)
    late(df.where("text in ('t1', 't55')"), 1)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "late" / "late")).collect()] == ["t1"]
