"""Operators of any group size, streams, scans and frozen records against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from versewise.functions import text as tx
from versewise.operators import intervals as iv, labels, quality, selection, series, stats
from versewise.sources import lyrics, records, sinks
from versewise.streaming import replay as rp, streams


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_values_at_ranks_equal_sorting(spark, most):
    rnd = random.Random(most)
    rows = [(k, None if rnd.random() < 0.05 else float(rnd.choice([1, 1, 1, rnd.randrange(400)]))) for k in ("a", "b", None) for _ in range({"a": 500, "b": 3, None: 60}[k])]
    got = selection.values_at(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", lambda n: [F.lit(0), n - 1, F.floor(n / 3), n], most=most, parts=5).collect()
    for r in got:
        mine = sorted(v for k, v in rows if k == r.k and v is not None)
        assert r.n == len(mine) and r.at == [mine[0], mine[-1], mine[len(mine) // 3], None]
    found = {r.k: (r.p, r.m) for r in selection.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p": 0.95, "m": 0.5}, most=most, parts=4).collect()}
    for k in ("a", "b", None):
        mine = [v for q, v in rows if q == k and v is not None]
        assert np.allclose(found[k], np.percentile(mine, [95, 50]))


def test_error_summaries_narrow_large_groups(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 1009 - 500).cast("double").alias("e"))
    whole, cut = (stats.error_summaries(rows, ["k"], "e", most=m, parts=8).orderBy("k").collect() for m in (10**6, 20))
    assert whole == cut
    assert stats.floor_rank_summary(rows, ["k"], "e", most=20, parts=8).orderBy("k").collect() == stats.floor_rank_summary(rows, ["k"], "e").orderBy("k").collect()
    assert stats.nearest_rank_summary(rows, ["k"], "e", most=20, parts=8).orderBy("k").collect() == stats.nearest_rank_summary(rows, ["k"], "e").orderBy("k").collect()


def test_joins_of_intervals_of_very_unlike_widths(spark):
    rnd = random.Random(2)
    make = lambda n, seed: [(i, b, b + rnd.choice([1, 5, 40, 900, 10**6])) for i in range(n) for b in [rnd.randrange(-1000, 10**6)]] + [(n, -5000, 2 * 10**6)]
    a, b = make(120, 1), make(90, 2)
    kind = "k string, id int, begin long, end long"
    frame = lambda rows: spark.createDataFrame([("x", *r) for r in rows], kind)
    got = sorted((r.l_id, r.r_id) for r in iv.overlap_join(frame(a), frame(b), "k", 4).collect())
    assert got == sorted((p, q) for p, b0, e0 in a for q, b1, e1 in b if max(b0, b1) < min(e0, e1))
    points = [(i, rnd.randrange(-6000, 10**6)) for i in range(200)]
    held = sorted((r.p, r.id) for r in iv.points_in_intervals(spark.createDataFrame([("x", *p) for p in points], "k string, p int, t long"), frame(b), "k", 4).collect())
    assert held == sorted((p, q) for p, t in points for q, b0, e0 in b if b0 <= t < e0)
    levels = iv._levels(frame(a), F.col("end") - F.col("begin"), 4)
    dealt = iv._dealt(frame(a), "begin", "end", F.array(iv._level(F.col("end") - F.col("begin"), 4)), 4)
    assert len(levels) <= 7 and dealt.count() <= 2 * len(a)


def test_greedy_matching_in_rounds(spark):
    rnd = random.Random(3)
    left, right = ([(k, i, rnd.randrange(600)) for k in "ab" for i in range(60)] for _ in range(2))
    # a chain: each left event waits for the one before it
    left += [("c", i, 10 * i) for i in range(12)]
    right += [("c", i, 10 * i + 4) for i in range(12)]
    kind = "k string, id int, t long"
    got = sorted((r.k, r.l_id, r.r_id) for r in iv.greedy_nearest(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), "k", 7).collect())
    want, used = [], set()
    for k, i, t in sorted(left, key=lambda r: (r[0], r[2], r[1])):
        near = sorted((abs(t - u), u, j) for q, j, u in right if q == k and abs(t - u) <= 7 and (q, j) not in used)
        if near:
            used.add((k, near[0][2]))
            want.append((k, i, near[0][2]))
    assert got == sorted(want)


def test_stable_runs_over_many_cells(spark):
    rnd, rows = random.Random(5), []
    for k, n in enumerate([900, 300, 1, 700]):
        t, v = 0, 0.0
        for i in range(n):
            t += rnd.choice([1, 1, 2, 9, 40]) if k < 3 else 1
            v = v + rnd.uniform(-3, 3) if k < 3 else 5.0 if i < 500 else float(i % 7)
            rows.append((k, t, None if rnd.random() < 0.01 and k < 3 else v))
    want = []
    for k in range(4):
        run: list = []
        for at, v in [*((t, v) for q, t, v in rows if q == k), (10**9, None)]:
            if run and (v is None or max(v, *(x for _, x in run)) - min(v, *(x for _, x in run)) > 8 or at - run[-1][0] > 30):
                if run[-1][0] - run[0][0] >= 3:
                    want.append((k, run[0][0], run[-1][0], len(run)))
                run = []
            if v is not None:
                run.append((at, v))
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = series.stable_intervals(spark.createDataFrame(rows, "k int, t long, v double"), "k", "t", "v", 8.0, 3, 30)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_words_of_a_line_of_fifty_thousand(spark):
    text = "naïve don't 40th, x9 " * 10_000 + "é"
    row = spark.createDataFrame([(text,), (None,)], "x string").select(tx.words_of(F.col("x")).alias("w"), tx.word_ranges(F.col("x")).alias("r"), tx.word_places(F.col("x")).alias("p")).collect()
    assert row[0].w[:4] == ["naïve", "don't", "40th", "x"] and len(row[0].w) == 40_001 and row[1].w is None
    assert all(text[p.begin : p.begin + p.size] == p.word for p in row[0].p) and row[0].r[-1].start_utf16 == len(text) - 1


def _arrivals(spark):
    e = spark.createDataFrame([(i, i % 3, 3600 * (i % 40) + i, i // 40) for i in range(160)], "event_id long, user_id long, t long, step int")
    return e.select("*", F.timestamp_micros(F.col("t") * 1_000_000).alias("ts"), F.lit(1.0).alias("value"))


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = _arrivals(spark).where("step < 3")
    build = lambda s: streams.hopping_counts(s, "ts", "user_id", "2 hours", "1 hour", "1 hour")
    whole = {tuple(r) for r in rp.replayed(rows, "step", "test", build).collect()}
    folder, start = f"file://{tmp_path}/s", lambda s: rp.to_files(build(s), f"file://{tmp_path}/s")
    rp.replay(rows.where("step < 2"), "step", folder, start)
    batches = len(list((tmp_path / "s" / "checkpoint" / "commits").glob("[0-9]*")))
    rp.replay(rows.where("step = 2"), "step", folder, start)
    rp.take_new(spark, folder, rows.drop("step").schema, start)  # nothing new: nothing twice
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()} == whole and whole
    assert len(list((tmp_path / "s" / "checkpoint" / "commits").glob("[0-9]*"))) > batches
    assert spark.read.parquet(f"{folder}/out").count() == len(whole)


def test_a_batch_of_days_that_comes_again_changes_nothing(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "day int, observed_at int, count int")
    apply = sinks.replace_days(f"file://{tmp_path}/days")
    apply(rows((1, 1, 5), (2, 1, 6)), 0)
    for _ in range(2):
        apply(rows((2, 2, 7), (2, 3, 8), (3, 2, 1)), 1)
    assert sorted((r.day, r.observed_at, r["count"]) for r in spark.read.parquet(f"file://{tmp_path}/days").collect()) == [(1, 1, 5), (2, 3, 8), (3, 2, 1)]


def test_ttml_keeps_the_order_of_spans_and_breaks(spark, tmp_path):
    head = '<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttm="http://www.w3.org/ns/ttml#metadata">'
    (tmp_path / "a.ttml").write_text(head + '<body begin="0.1s" dur="9s"><div begin="0.025s"><p begin="0s" dur="1.875s">Ink &amp; pen.<br/>Room.</p><p begin="1.875s" end="2.375s"/><p begin="3s" end="5s"><span begin="0s" end="0.5s">AV </span><span begin="0.5s" dur="0.5s">😀x</span><br/><span begin="1s" end="2s">low</span><span ttm:role="x-bg">ooh</span></p></div></body></tt>')
    (tmp_path / "b.ttml").write_text(head + '<body><div><p begin="0s" end="3s">a<span begin="0s" end="1s">b</span></p><p begin="1s" end="0.5s">c</p><p begin="9s" end="10s"><span begin="0s" end="2s">d</span></p></div></body></tt>')
    (tmp_path / "c.ttml").write_text("<tt><body>")
    (tmp_path / "d.ttml").write_text('<!DOCTYPE tt [<!ENTITY x "y">]><tt/>')
    rows = {(r.recording_id, r.entry_idx): r for r in lyrics.read_ttml(spark, str(tmp_path)).collect()}
    a = [rows["a", i] for i in range(3)]
    assert [(r.begin_us, r.end_us, r.text, r.supplied_breaks, r.fault) for r in a] == [(125000, 2000000, "Ink & pen.\nRoom.", True, None), (2000000, 2500000, "", False, None), (3125000, 5125000, "AV 😀x\nlow", True, None)]
    assert [(s.start_utf16, s.length_utf16, s.begin_us, s.end_us) for s in a[2].segments] == [(0, 3, 3125000, 3625000), (3, 3, 3625000, 4125000), (7, 3, 4125000, 5125000)]
    assert (a[2].background.text, a[2].background.begin_us, a[2].background.end_us, a[2].background.explicit) == ("ooh", 3125000, 5125000, False)
    assert [rows["b", i].fault for i in range(3)] == ["unsupported_text", "interval", "span_interval"]
    assert sorted(r.recording_id for r in lyrics.unreadable_ttml(spark, str(tmp_path)).collect()) == ["c", "d"]


def test_bridged_units_follow_the_pace(spark):
    kind = "recording_id string, line_id int, unit int, syllables int, begin_us long, end_us long"
    rows = [("r", 1, 0, 1, None, None), ("r", 1, 1, 2, 1_000_000, 1_150_000), ("r", 1, 2, 1, None, None), ("r", 1, 3, 3, None, None), ("r", 1, 4, 1, 2_000_000, 2_150_000), ("r", 1, 5, 1, 2_400_000, 2_600_000), ("r", 1, 6, 2, None, None), ("s", 1, 0, 4, None, None)]
    got = [(r.unit_begin, r.unit_end) for r in labels.bridge_units(spark.createDataFrame(rows, kind)).orderBy("recording_id", "unit").collect()]
    assert got == [(850_000, 1_000_000), (1_000_000, 1_150_000), (1_150_000, 2_000_000), (2_000_000, 2_000_000), (2_000_000, 2_400_000), (2_400_000, 2_600_000), (2_600_000, 2_900_000), (0, 0)]


def test_units_out_of_order_or_across_lines_leave_lines_open(spark):
    lines = spark.createDataFrame([("r", 1, "abc"), ("r", 2, "de"), ("r", 3, ""), ("s", 1, "xy"), ("t", 1, "ab")], "recording_id string, line_id int, alignment_text string")
    units = spark.createDataFrame([("r", 1, "a", 0, 10), ("r", 2, "bcd", 10, 20), ("r", 3, "e", 30, 40), ("s", 1, "x", 5, 9), ("s", 2, "y", 8, 12)], "recording_id string, unit int, text string, begin_us long, end_us long")
    got = {(r.recording_id, r.line_id): (r.begin_us, r.unresolved) for r in labels.units_to_lines(units, lines).collect()}
    assert got == {("r", 1): (None, "unaligned"), ("r", 2): (None, "unaligned"), ("r", 3): (None, "unaligned"), ("s", 1): (None, "units_out_of_order"), ("t", 1): (None, "text_mismatch")}


def test_long_vowel_ranges(spark):
    p = spark.createDataFrame([("r", 0, "ああー、カード"), ("r", 1, "スーパー!"), ("s", 0, "ラー"), ("t", 0, "ラーa"), ("u", 0, "あーカー")], "recording_id string, paragraph int, text string")
    u = spark.createDataFrame([("r", 0, "ああー"), ("r", 1, "カド"), ("r", 2, "スパー"), ("s", 0, "ラー"), ("t", 0, "ラb"), ("u", 0, "あカ")], "recording_id string, unit int, text string")
    got = sorted(map(tuple, quality.long_vowel_suggestions(p, u).collect()))
    assert got == [("r", 0, 4, 3, "カード"), ("r", 1, 0, 4, "スーパー")]


def test_segment_evidence_is_a_chain(spark):
    token = "tokens array<struct<begin_ms: long, end_ms: long>>"
    s = spark.createDataFrame([("r", 0, 0, "a", 100, 400, [(100, 200), (None, 300)]), ("r", 0, 1, "(b)", 50, 200, [(10, 200)]), ("r", 0, 2, "", 500, 600, []), ("r", 0, 3, "c\x01", 700, 800, []), ("r", 0, 4, "d", 900, 5000, [(900, 5000)]), ("r", 1, 0, "e", 0, 10, [])], f"recording_id string, window int, segment int, text string, begin_ms long, end_ms long, {token}")
    w = spark.createDataFrame([("r", 0, 0, 1_000_000), ("r", 1, 500_000, 1_500_000)], "recording_id string, window int, begin_us long, end_us long")
    got = {(r.window, r.segment): (r.reason, len(r.uncertainty), r.token_issues) for r in records.projected_segments(s, w).collect()}
    assert got[0, 0] == (None, 0, {"missing": 1}) and got[0, 1] == ("segment_timing_ambiguous", 1, {"outside_segment": 1})
    assert [got[0, i][0] for i in (2, 3, 4)] == ["empty_recognition", "unsupported_text_control", "segment_timing_out_of_window"] and got[0, 4][2] == {"out_of_window": 1} and got[1, 0] == (None, 0, {})


def test_frozen_records_are_refused_with_a_violation(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", True, 0.5), (2, "a", False, 0.9), (3, "b", True, 0.7)], "id int, k string, m boolean, score double")
    sinks.write_frozen(sinks.frozen_record(rows, stats.fit_features(rows, ["k"], ["score"], "m"), ["id", "score"]), f"file://{tmp_path}/f")
    record = sinks.read_frozen(spark, f"file://{tmp_path}/f", "k string, feature string, threshold double")
    assert {(r.k, r.threshold) for r in record.collect()} == {("a", 0.7), ("b", 1.0)}
    assert sinks.frozen_violations(rows.repartition(3), record, ["id", "score"]).collect() == []
    bad = sinks.frozen_violations(rows.where("id < 3"), record, ["id", "score"]).collect()
    assert [r.rule_id for r in bad] == ["fitted_on_other_rows"] and sinks.require_fitted(rows.where("id < 3"), record, ["id", "score"]).count() == 0
    assert [r.row for r in sinks.frozen_violations(rows, record.where("false"), ["id", "score"]).collect()] == ["none"]


def test_held_out_spacing_equals_refitting(spark):
    rnd = np.random.default_rng(1)
    rows = [(k, float(x), float(2 * x + k + rnd.normal())) for k in range(4) for x in rnd.normal(size=20)] + [(9, 1.0, 5.0)]
    got = {r.k: r for r in stats.held_out_spacing(spark.createDataFrame(rows, "k int, x double, y double"), "k", "x", "y").collect()}
    fit = {k: np.polyfit(*zip(*((x, y) for q, x, y in rows if q == k)), 1)[0] for k in range(4)}
    for k in (0, 1, 2, 3, 9):
        x, y = (np.array(v) for v in zip(*((x, y) for q, x, y in rows if q == k)))
        scale = np.mean([s for q, s in fit.items() if q != k])
        r = y - scale * x - (y - scale * x).mean()
        assert np.allclose([got[k].scale, got[k].rmse, got[k].worst], [scale, np.sqrt((r * r).mean()), np.abs(r).max()])
    alone = stats.held_out_spacing(spark.createDataFrame(rows[:20], "k int, x double, y double"), "k", "x", "y").first()
    assert alone.scale is None and alone.rmse is None


ANNOTATION = "recording_id string, source_id string, audio_sha256 string, annotator string, reviewer string, language string, sample_rate_hz long, source_total_samples long, source_start_sample long, source_end_sample long, duration_us long, resolution_us long, review_status string, initial_passes array<string>, sha256 string"
BANDS = "recording_id string, seq int, kind string, onset_earliest_us long, onset_latest_us long, offset_earliest_us long, offset_latest_us long, censored_onset boolean, censored_offset boolean"


def test_annotation_records_and_their_unknown_complement(spark):
    good = ("r", "s", "a" * 64, "p", None, "en", 48_000, 96_000, 0, 48_000, 1_000_000, 10, "independent_pass", None, "x")
    bad = ("b", " ", "zz", None, None, "fr", 0, 10, 5, 4, 7, 99, "reviewed", ["h"], "y")
    records_ = spark.createDataFrame([good, bad], ANNOTATION)
    rows = spark.createDataFrame([("r", 1, "lead_singing", 0, 10, 100, 120, True, False), ("r", 2, "humming", 200, 250, 250, 300, False, False), ("r", 3, "sung_ad_lib", 300, 310, 400, 400, False, False), ("r", 4, "silence", 400, None, None, 500, None, None), ("r", 5, "breath", 500, None, None, 600, None, None), ("b", 1, "noise", 0, 0, 1, 2, False, False), ("b", 2, "humming", 1, 5, 4, 9, True, False), ("b", 3, "silence", 9, None, None, 9, None, None)], BANDS)
    faults = sorted((r.recording_id, r.row, r.rule_id) for r in quality.annotation_record_violations(records_, rows).collect())
    assert faults == sorted([("b", "record", x) for x in ("identity", "audio_digest", "language", "sample_rate", "excerpt", "duration", "resolution", "reviewer", "initial_passes")] + [("b", "1", "unknown_kind"), ("b", "2", "band_order"), ("b", "2", "censored_edge"), ("b", "2", "envelope_order"), ("b", "2", "outside_excerpt"), ("b", "3", "empty_interval"), ("b", "3", "outside_excerpt")])
    unknown, counts = quality.annotation_summary(records_.where("recording_id = 'r'"), rows.where("recording_id = 'r'"))
    assert sorted((r.begin, r.end) for r in unknown.collect()) == [(0, 10), (100, 310), (500, 1_000_000)]
    assert [tuple(r) for r in counts.collect()] == [("r", 1, 1, 0)]


def test_reviews_name_two_independent_passes(spark):
    make = lambda name, who, status, passes, sha, language="en", reviewer=None: (name, "s", "a", who, reviewer, language, 1, 9, 0, 9, 9, 1, status, passes, sha)
    rows = [make("p1", "a", "independent_pass", None, "h1"), make("p2", "b", "independent_pass", None, "h2"), make("p3", "a", "independent_pass", None, "h3", "ja")]
    rows += [make("good", "a", "reviewed", ["h1", "h2"], "r1", reviewer="b"), make("gone", "a", "reviewed", ["h1", "h9"], "r2", reviewer="b"), make("odd", "a", "reviewed", ["h1", "h3"], "r3", reviewer="b")]
    digests = spark.createDataFrame([("p1", "x"), ("p2", "y"), ("p3", "x")], "recording_id string, digest string")
    table = spark.createDataFrame(rows, ANNOTATION)
    found = lambda seen: sorted((r.recording_id, r.rule_id) for r in quality.review_violations(table, digests, spark.createDataFrame(seen, "recording_id string")).collect())
    rest = [("gone", "missing_pass"), ("gone", "not_the_declared_people"), ("odd", "different_identity"), ("odd", "not_the_declared_people")]
    assert found([("good",)]) == rest and found([("odd",)]) == sorted([*rest, ("good", "disagreement_missing")])
