"""Small literal examples and brute-force comparisons of the library's operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from versewise.functions import numbers, text as tx, times
from versewise.operators import align, intervals as iv, match, quality, series


def column(spark, f, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x")).alias("y")).collect()]


def test_spoken_numbers(spark):
    want = {"1999": "nineteen ninety-nine", "1905": "nineteen oh five", "2000": "two thousand", "12:00": "twelve o'clock", "3:05": "three oh five", "22nd": "twenty-second", "'90s": "nineties", "1980s": "nineteen eighties", "1,234": "one thousand two hundred thirty-four", "007": None, "2th": None, "25:00": None}
    assert column(spark, numbers.spoken, *want) == list(want.values())
    line = spark.createDataFrame([("In 1999 we had 3.5 of 99",)], "text string")
    assert numbers.expand_numbers(line).first().expanded == "In nineteen ninety-nine we had 3.5 of ninety-nine"


def test_times(spark):
    assert column(spark, times.ttml_time, "00:01:02.5", "1.5s", "20ms", "2m", "1x", None) == [62500000, 1500000, 20000, 120000000, None, None]
    assert column(spark, times.lrc_time, "01:02.5", "00:00.05", "1:2", "03:04") == [62500, 50, None, 184000]
    assert column(spark, times.seconds_to_us, "1.0000005", "1.0000015", "2") == [1000000, 1000002, 2000000]
    assert column(spark, tx.stamp, 12500000, 3000000, 0, None, kind="long") == ["12.5s", "3s", "0s", None]


def test_text(spark):
    row = spark.createDataFrame([("a😀é don't (yeah  oh) stop 40th, 3:00 x9!",)], "x string").select(tx.word_ranges(F.col("x")).alias("w"), tx.main_text(F.col("x")).alias("m"), tx.backing(F.col("x")).alias("b"), tx.utf16_length(F.col("x")).alias("n")).first()
    assert [(w.word, w.start_utf16) for w in row.w] == [("a", 0), ("é", 3), ("don't", 5), ("yeah", 12), ("oh", 18), ("stop", 22), ("40th", 27), ("3:00", 33), ("x", 38)]
    assert (row.m, row.b, row.n) == ("a😀é don't stop 40th, 3:00 x9!", ["yeah oh"], 41)
    assert column(spark, tx.compose, "é", "plain", None, "가", kind="string") == ["é", "plain", None, "가"]
    assert column(spark, tx.is_vocable, "oh ooh la la", "oh no", "", "123") == [True, False, False, False]
    assert column(spark, tx.unify_apostrophes, "don‘t ‘90s ‘so’ it`s") == ["don’t ’90s ‘so’ it’s"]
    assert column(spark, tx.canonical, "Hello, World!", "a=b", "") == ["helloworld", None, ""]


def spans(spark, rows):
    return spark.createDataFrame(rows or [], "k string, begin long, end long")


@pytest.mark.parametrize("seed", range(3))
def test_interval_algebra_against_points(spark, seed):
    rnd = random.Random(seed)
    make = lambda: [(k, b, b + rnd.randint(1, 6)) for k in "ab" for b in rnd.choices(range(30), k=5)]
    a, b = make(), make()
    points = lambda rows: {(k, t) for k, x, y in rows for t in range(x, y)}
    A, B = points(a), points(b)
    la, lb = spans(spark, a), spans(spark, b)
    read = lambda df: [(r.k, r.begin, r.end) for r in df.collect()]
    for df, want in ((iv.merge_intervals(la, "k"), A), (iv.difference(la, lb, "k"), A - B), (iv.intersection(la, lb, "k"), A & B)):
        got = read(df)
        assert points(got) == want
        assert all(x[2] < y[1] for x, y in itertools.pairwise(sorted(got)) if x[0] == y[0])  # apart and merged
    pairs = {(x, y) for x in a for y in b if x[0] == y[0] and min(x[2], y[2]) > max(x[1], y[1])}
    joined = iv.overlap_join(la, lb, "k", 4)
    assert {((r.k, r.l_begin, r.l_end), (r.k, r.r_begin, r.r_end)) for r in joined.collect()} == pairs


def test_touching_merge_but_do_not_overlap(spark):
    rows = spans(spark, [("a", 0, 2), ("a", 2, 4)])
    assert [(r.begin, r.end) for r in iv.merge_intervals(rows, "k").collect()] == [(0, 4)]
    assert iv.overlap_join(rows.limit(1), spans(spark, [("a", 2, 4)]), "k", 10).count() == 0
    assert iv.merge_intervals(spans(spark, []), "k").count() == 0


def test_fill_unresolved(spark):
    rows = [("a", 1, None, None), ("a", 2, 10_000_000, 11_000_000), ("a", 3, None, None), ("a", 4, None, None), ("a", 5, 12_000_001, 13_000_000), ("a", 6, None, None), ("b", 1, None, None)]
    df = spark.createDataFrame([(*r, 20_000_000) for r in rows], "k string, line int, b long, e long, d long")
    got = {(r.k, r.line): (r.fill_begin, r.fill_end) for r in align.fill_unresolved(df, "k", "line", "b", "e", "d").collect()}
    assert got[("a", 1)] == (7_500_001, 10_000_000)
    assert (got[("a", 3)], got[("a", 4)]) == ((11_000_001, 11_500_000), (11_500_001, 12_000_000))
    assert got[("a", 6)] == (13_000_001, 15_500_000)
    assert got[("a", 2)] == (None, None)
    assert got[("b", 1)] == (17_500_001, 20_000_000)  # a run of everything stands at the end


def test_neighbours_do_not_chain(spark):
    df = spark.createDataFrame([("a", i, i == 1, 1.0, 0.1) for i in range(1, 5)], "k string, line int, base boolean, rate double, sim double")
    got = [r.accepted for r in align.neighbour_acceptance(df, "k", "line", "base", "rate", "sim").orderBy("line").collect()]
    assert got == [True, True, False, False]


def test_boundary_run_moves_to_nearest_component(spark):
    rows = spark.createDataFrame([("a", 1, None, None, 30_000_000), ("a", 2, 20_000_000, 21_000_000, 30_000_000)], "k string, line int, b long, e long, d long")
    filled = align.fill_unresolved(rows, "k", "line", "b", "e", "d")
    comp = spans(spark, [("a", 1_000_000, 9_000_000), ("a", 10_000_000, 14_000_000)])
    got = align.relocate_boundary_runs(filled, comp, "k", "line", "b", "e", "d").where("line = 1").first()
    assert got.fill_begin == 10_000_001 and got.fill_end - got.fill_begin == 2_499_999
    short = spans(spark, [("a", 1_000_000, 9_000_000), ("a", 10_000_000, 11_000_000)])  # the nearest is too short: stays
    assert align.relocate_boundary_runs(filled, short, "k", "line", "b", "e", "d").where("line = 1").first().shift == 0


def test_clamp_words(spark):
    df = spark.createDataFrame([([(5, 8), (7, 9), (12, 15)], 4, 14), ([(5, 20), (6, 21)], 4, 14)], "w array<struct<begin_us:long,end_us:long>>, a long, b long")
    got = [r[0] for r in df.select(align.clamp_words(F.col("w"), F.col("a"), F.col("b"))).collect()]
    assert [tuple(x) for x in got[0]] == [(4, 8), (8, 9), (12, 14)]
    assert got[1] is None


def test_refined_estimates(spark):
    frames = spark.createDataFrame([("r", i, -60.0 if i < 52 or i > 110 else 0.0) for i in range(200)], "recording_id string, frame_idx long, level_db double")
    rows = spark.createDataFrame([("r", 1, 1_000_000, 2_000_000, True, 100.0), ("r", 2, 3_000_000, 3_500_000, True, 100.0)], "recording_id string, line_id int, begin_us long, end_us long, accepted boolean, rate double")
    got = {r.line_id: r for r in align.refine_estimates(rows, frames).collect()}
    assert (got[1].estimate_begin, got[1].estimate_end, got[1].onset_trim, got[1].offset_extension) == (1_040_000, 2_220_000, 40_000, 220_000)
    assert got[2].estimate_begin is None and got[2].refine_flags == ["no_vocal_activity"]


def every_path(groups):
    """(total, choices) of all ways to take at most one candidate a group, in time order."""
    for choice in itertools.product(*[[None, *g] for g in groups]):
        end, total = 0, 0.0
        for c in choice:
            if c is not None:
                if c[1] < end:
                    break
                end, total = c[2], total + c[3]
        else:
            yield total, choice


@pytest.mark.parametrize("seed", range(30))
def test_path_against_brute_force(seed):
    rnd = random.Random(seed)
    groups = [[(f"{i}{j}", b := rnd.randint(0, 20), b + rnd.randint(1, 6), rnd.randint(0, 99) / 100 + j / 1e4 + i / 1e6) for j in range(rnd.randint(0, 3))] for i in range(5)]
    best, choice = max(every_path(groups), key=lambda x: x[0])
    got = match.timeline_choice(groups)
    assert sum(c[3] for g, (id_, _) in zip(groups, got) for c in g if c[0] == id_) == pytest.approx(best)
    assert [id_ for id_, _ in got] == [c and c[0] for c in choice]
    for i, c in enumerate(choice):
        if c:
            near = lambda o, c=c: 2 * max(0, min(o[2], c[2]) - max(o[1], c[1])) >= min(o[2] - o[1], c[2] - c[1])
            other = max(t for t, way in every_path([[o for o in g if k != i or not near(o)] for k, g in enumerate(groups)]))
            assert got[i][1] == pytest.approx(best - other)


def test_path_cuts_keys_and_names_unresolved_occurrences(spark):
    rows = [("r", 1, "a", 0, 10, 0.9), ("r", 1, "b", 2, 9, 0.8), ("r", 2, "c", 5, 12, 0.3), ("r", 3, "d", 20, 30, 0.5), ("r", 5, "e", 40, 50, 0.01)]
    df = spark.createDataFrame(rows, "k string, occurrence long, id string, begin long, end long, utility double")
    every = spark.createDataFrame([("r", i) for i in range(1, 6)], "k string, occurrence long")
    got = [(r.occurrence, r.candidate, r.state) for r in match.chronological_path(df, "k", 0.02, every).orderBy("occurrence").collect()]
    assert got == [(1, "a", "supported"), (2, None, "skipped"), (3, "d", "supported"), (4, None, "unresolved"), (5, "e", "ambiguous")]


def test_line_candidates_find_edited_lines(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    stream = [rnd.choice(vocab) for _ in range(400)]
    lines = []
    for i in range(30):
        n, at = rnd.randint(2, 12), rnd.randint(0, 380)
        words = stream[at : at + n]
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        lines.append((i, words))
    tokens = spark.createDataFrame([("s", p, w) for p, w in enumerate(stream)], "stream string, pos long, word string")
    got = {r.line_id for r in match.line_candidates(spark.createDataFrame(lines, "line_id int, words array<string>"), tokens).collect()}
    want = {i for i, words in lines if any(m >= min(2, len(words)) and e <= 0.3 * len(words) for _, _, e, m in match._semi_global(words, stream))}
    assert got == want


def test_near_duplicate_suppression(spark):
    rows = spark.createDataFrame([("r", "a", 0.9, 0, 10_000_000), ("r", "b", 0.8, 300_000, 10_200_000), ("r", "c", 0.7, 900_000, 10_200_000)], "k string, id string, score double, b long, e long")
    got = {r.id: r.duplicate_of for r in match.suppress_near_duplicates(rows, ["k"], "id", "score", "b", "e").collect()}
    assert got == {"a": None, "b": "a", "c": None}


def test_rank_filter_replicates_edges(spark):
    values = [random.Random(1).random() for _ in range(80)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    got = [r.filtered for r in series.rank_filter(df, "k", "i", "v").orderBy("i").collect()]
    assert got == [sorted(values[min(79, max(0, i + j))] for j in range(-28, 28))[28] for i in range(80)]


def test_stable_intervals(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.0, 1.1), ("a", 2.0, 1.3), ("a", 3.0, 9.0), ("a", 4.0, 9.1), ("a", 9.0, 9.1), ("a", 10.0, None)]
    got = series.stable_intervals(spark.createDataFrame(rows, "k string, t double, v double"), "k", "t", "v", 0.2, 1.0, 2.0)
    assert [(r.first, r.last, r.n) for r in got.orderBy("first").collect()] == [(0.0, 1.0, 2), (3.0, 4.0, 2)]


def test_results_do_not_depend_on_row_order(spark):
    rnd = random.Random(8)
    rows = [("u%d" % rnd.randint(0, 3), rnd.randint(0, 50), i) for i in range(120)]
    a = spark.createDataFrame(rows, "k string, t long, id long")
    b = spark.createDataFrame(rows[::-1], "k string, t long, id long").repartition(7)
    run = lambda df: sorted(map(tuple, iv.asof_join(df.where("id % 2 = 0"), df.where("id % 2 = 1").select("k", "t", F.col("id").alias("r")), "k", "t", ["r"], ties=["r"]).collect()), key=str)
    assert run(a) == run(b)


def test_violations(spark):
    rows = spark.createDataFrame([("r", 1, 0, 10, 100), ("r", 2, 5, 8, 100), ("r", 3, 20, 120, 100), ("r", 4, 15, 15, 100)], "recording_id string, line int, b long, e long, d long")
    got = {(r.row, r.rule_id) for r in quality.timed_line_violations(rows, "recording_id", "line", "b", "e", "d").collect()}
    assert got == {("2", "overlap"), ("3", "out_of_bounds"), ("4", "empty_interval"), ("4", "not_monotonic"), ("4", "overlap")}
