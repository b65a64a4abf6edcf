"""Queries in conditions that larger tables bring: groups cut into batches, long lines, many small groups."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from test_queries import DIR, TABLES, rows
from versewise import plans
from versewise.operators import labels, match, quality, selection
from versewise.streaming import replay, streams

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def equal_to_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, DIR), duck.execute(plans.SQL[name])
    columns = [c[0] for c in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_focus_of_a_key_whose_rows_come_in_several_batches_in_any_order(spark):
    at = lambda s: F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col(s) * 1_000_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        back = spark.range(40).select(F.lit(0).alias("step"), F.lit("k").alias("key"), at("id").alias("ts"), F.concat(F.lit("x"), F.col("id")).alias("text")).orderBy(F.desc("ts")).coalesce(1)
        tie = spark.range(1).select(F.lit(1).alias("step"), F.lit("k").alias("key"), (at("id") + F.expr("interval 39 seconds")).alias("ts"), F.lit("a").alias("text"))
        late = spark.range(1).select(F.lit(2).alias("step"), F.lit("other").alias("key"), (at("id") + F.expr("interval 90 seconds")).alias("ts"), F.lit("z").alias("text"))
        out = replay.replayed(back.union(tie).union(late).coalesce(1), "step", "focus", lambda s: streams.live_focus(s, "key", "ts", "text", 5, "60 seconds")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.text for r in out if r.key == "k" and r.state == "focused") == sorted(["a", *[f"x{i}" for i in range(40)]])
    assert all(r.text == "x39" for r in out if r.key == "k" and r.state == "expired")


def test_pieces_of_a_path_share_tasks_and_batches(spark):
    """Each piece is chosen by itself wherever it is dealt, and a piece goes on in the next batch."""
    r = [(k, o, 10 * o + i, 100 * o + 20 * i, 100 * o + 20 * i + 60, float((o * 7 + i * 3 + k) % 5) / 5) for k in range(7) for o in range(9) for i in range(3)]
    frame = spark.createDataFrame(r, "k long, occurrence long, id long, begin long, end long, utility double")
    plan = match.chronological_path(frame, "k")
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()  # a call of pandas a piece takes its time
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {(x.k, x.occurrence): (x.candidate, x.margin) for x in match.chronological_path(frame, "k").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k in range(7):
        groups = [sorted((i, b, e, u) for kk, oo, i, b, e, u in r if (kk, oo) == (k, o)) for o in range(9)]
        for o, found in enumerate(match.timeline_choice(groups)):
            want[k, o] = found
    assert {x: v[0] for x, v in got.items()} == {x: v[0] for x, v in want.items()}
    assert all(abs((v[1] or 0) - (want[x][1] or 0)) < 1e-9 for x, v in got.items())


def shuffled(spark, work):
    """Bytes that a job writes to shuffles."""
    def total():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    out = work()
    return out, total() - before


def test_marks_of_a_long_line_do_not_carry_its_text(spark):
    line = "".join(chr(0x30A2 + i * 37 % 40) + "ー" for i in range(3000)) + "。あ"
    p, u = (spark.createDataFrame([("r", 0, t)], f"recording_id string, {n} int, text string") for n, t in (("paragraph", line), ("unit", line.replace("ー", ""))))
    out, size = shuffled(spark, lambda: [tuple(r) for r in quality.long_vowel_suggestions(p, u).collect()])
    assert out == [("r", 0, 0, 6000, line[:6000])] and size < 2_000_000



def _frames(spark, p, u):
    return (spark.createDataFrame(rows, f"recording_id string, {n} int, text string").repartition(5, "text") for n, rows in (("paragraph", p), ("unit", u)))


def test_texts_are_not_shuffled_for_their_marks(spark):
    rnd = random.Random(5)
    p = [(f"r{i % 40}", i, "".join(chr(rnd.randrange(0x3041, 0x3090)) for _ in range(1000)) + " アー") for i in range(400)]
    u = [(r, i, t.replace("ー", "") if i % 3 else t) for r, i, t in p]
    paragraphs, units = _frames(spark, p, u)
    paragraphs, units = paragraphs.checkpoint(), units.checkpoint()
    out, size = shuffled(spark, lambda: sorted(map(tuple, quality.long_vowel_suggestions(paragraphs, units).collect())))
    assert out == sorted((r, i, 1001, 2, "アー") for r, i, _ in p if i % 3) and size < 200_000  # of 2.4 MB of text


def test_long_vowels_of_rows_that_come_twice(spark):
    got = lambda p, u: sorted(map(tuple, quality.long_vowel_suggestions(*_frames(spark, p, u)).collect()))
    assert got([("r", 1, "アーカ")] * 2 + [(None, 1, "アー")], [("r", 1, "アカ")] * 2 + [(None, 1, "ア")]) == [("r", 1, 0, 3, "アーカ")]
    assert got([("r", 1, "イー"), ("r", 1, "アー"), ("r", None, "アー")], [("r", 7, "アアイー")]) == [("r", 1, 0, 2, "アー")]  # a line without a place gets none
    assert got([("r", 1, "イー"), ("r", 1, "アー")], [("r", 7, "アイ")]) == []  # of two texts of one place the ranges overlap
    assert got([("r", 1, "イー"), ("r", 1, "アー")], [("r", 7, "アイー")]) == [("r", 1, 0, 2, "アー")]


def _suggested(p, u):
    """As ``long_vowel_suggestions``, letter by letter."""
    out = []
    bare = lambda t: re.sub(r"[、。!,.?\s]", "", t or "").lower()
    for k in sorted({r for r, *_ in p if r}):
        rows = sorted((i, bare(t), t or "") for r, i, t in p if r == k)
        spoken = [t for _, t in sorted((i, bare(t)) for r, i, t in u if r == k)]
        want, got = "".join(t for _, t, _ in rows), "".join(spoken)
        a, b = re.split("[^ー]", want), re.split("[^ー]", got)
        if not spoken or want.replace("ー", "") != got.replace("ー", "") or any(len(x) < len(y) for x, y in zip(a, b)):
            continue
        gap, seen, ranges = 0, 0, set()
        for i, _, text in rows:
            for n, c in enumerate(text):
                if c == "ー":
                    seen += 1
                    if seen > len(b[gap]):
                        script = "[\u30A1-\u30FAー]*" if n and "\u30A1" <= text[n - 1] <= "\u30FA" else "[\u3041-\u3096ー]*"
                        x, z = re.search(f"({script})$", text[:n]).start(), n + re.match(script, text[n:]).end()
                        utf16 = lambda t: len(t.encode("utf-16-le")) // 2
                        ranges.add((k, i, utf16(text[:x]), utf16(text[x:z]), text[x:z]))
                elif bare(c):
                    gap, seen = gap + 1, 0
        ranges = sorted(ranges)
        if not any(x[1] == y[1] and x[2] + x[3] > y[2] for x, y in zip(ranges, ranges[1:])):
            out += ranges
    return out


def test_long_vowels_letter_by_letter(spark):
    """Lines and units of unlike lengths, letters beyond 16 bits, rows of a key in several batches, other letters, marks too many."""
    rnd = random.Random(9)
    p, u = [], []
    for k in range(120):
        lines = ["".join(rnd.choice("アカあかーーー、 x𠀀Q" if k % 3 else "アカバーー ") for _ in range(rnd.choice([0, 1, 7, 400]))) for _ in range(rnd.randrange(6))]
        heard = "".join(c for c in "".join(lines) if c not in "、 " and (c != "ー" or rnd.random() < (0.9 if k % 2 else 0.99)))
        heard = heard + "ー" * (k % 11 == 0) if k % 7 else heard[::-1]
        cuts = sorted(rnd.randrange(len(heard) + 1) for _ in range(rnd.randrange(5)))
        p += [(f"r{k}", i, t) for i, t in enumerate(lines)]
        u += [(f"r{k}", i, heard[a:b]) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(heard)]))]
    p, u = p + [("none", 1, "アー"), ("r1", 99, None)], u + [("r1", 99, None)]
    want = _suggested(p, u)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(map(tuple, quality.long_vowel_suggestions(*_frames(spark, p, u)).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(want) and len(want) > 50


def test_units_meet_lines_without_buckets(spark):
    sizes = [3 + i % 5 for i in range(300)]
    text, ends = "ab" * 700, [sum(sizes[: i + 1]) for i in range(300)]
    text = text[: ends[-1]]
    units = spark.createDataFrame([("r", i, text[e - n : e], 10 * i, 10 * i + 9) for i, (n, e) in enumerate(zip(sizes, ends))] + [("r", 300, "", 3000, 3005)], "recording_id string, unit int, text string, begin_us long, end_us long")
    cuts = [0, *range(7, len(text), 7), len(text)]
    lines = spark.createDataFrame([("r", i, text[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))], "recording_id string, line_id int, alignment_text string")
    frame = labels.units_to_lines(units, lines)
    assert "_bucket" not in frame._jdf.queryExecution().toString()
    begins = {e - n: i for i, (n, e) in enumerate(zip(sizes, ends))}
    ended = {e: i for i, e in enumerate(ends)}
    want = {i: (10 * begins[a], 10 * ended[b] + 9) if a in begins and b in ended else (None, None) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {r.line_id: (r.begin_us, r.end_us) for r in frame.collect()} == want and any(v[0] is not None for v in want.values())


def test_order_statistics_compute_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 3001).cast("double").alias("v")).mapInPandas(counted, "k long, v double")
    got = {r.k: r.at for r in selection.values_at(rows, ["k"], "v", lambda n: [F.lit(0), n - 1], most=100, parts=4).collect()}
    want = {k: [float(f(i * 7919 % 3001 for i in range(k, 3000, 3))) for f in (min, max)] for k in range(3)}
    assert got == want and seen.value == 3000
