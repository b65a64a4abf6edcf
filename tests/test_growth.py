"""Findings on growth: what a step shuffles, sorts or calls must not grow faster than its input."""

import random
import re

from pyspark.sql import functions as F

from versewise import plans
from versewise.operators import schedule, series


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_grid_steps_are_made_after_the_window(spark):
    """only entries are sorted; two spans of a key, a key without entries, a null key, ties and steps before all entries."""
    rnd = random.Random(3)
    entries = [(k, rnd.randrange(0, 100), i) for i in range(60) for k in (1, None, 3)] + [(1, None, 99), (3, 20, 100), (3, 20, 101)]
    spans = [(1, 5, 47), (1, 60, 90), (2, 0, 10), (None, 0, 100), (3, -7, 30)]
    e = spark.createDataFrame([(k, t, i, None if t is None else t + 9) for k, t, i in entries], "k int, at long, id long, stop long")
    s = spark.createDataFrame(spans, "k int, begin long, end long")
    rows = schedule.sample_grid(e, s, "k", 5, "at", ["id", "stop"], "stop", ("id",))
    want = []
    for k, b, end in spans:
        for g in range(b, end + 1, 5):
            last = max(((t, i) for q, t, i in entries if q == k and t is not None and t <= g), default=None)
            want.append((k, g, *(last if last and g < last[0] + 9 else (None, None))))
    assert sorted(map(str, (tuple(r)[:4] for r in rows.collect()))) == sorted(map(str, want))
    assert _plan(rows).index("Generate") < _plan(rows).index("Window")


def test_runs_of_whole_keys_need_no_call_a_key(spark):
    """keys that lie in one range are scanned in a stream of batches, whatever their number."""
    rnd = random.Random(8)
    rows = [(k if k else None, t, rnd.choice([1.0, 2.0, 9.0, float("nan"), None]) if rnd.random() < 0.3 else 1.5) for k in range(400) for t in range(0, 60, 2)]
    want = []
    for k in {r[0] for r in rows}:
        run = []
        for t, v in [*sorted((t, v) for q, t, v in rows if q == k), (10**6, None)]:
            gone = v is None or v != v
            if run and (gone or max(v, *(x for _, x in run)) - min(v, *(x for _, x in run)) > 4 or t - run[-1][0] > 30):
                if run[-1][0] - run[0][0] >= 3:
                    want.append((k, run[0][0], run[-1][0], len(run)))
                run = []
            if not gone:
                run.append((t, v))
    got = series.stable_intervals(spark.createDataFrame(rows, "k int, t long, v double"), "k", "t", "v", 4.0, 3, 30)
    assert "MapInArrow" in _plan(got)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_shifts_of_lines_need_no_join(spark, tmp_path):
    """both times of a line come from one aggregation; a line without a supplier is a line too."""
    rows = [(1, 1, 1, 7, "A", "F", 3.0, 10.0, 0.02), (1, 2, 1, 7, "A", "F", 2.0, 10.0, 0.01), (1, 3, 1, 8, "A", "F", 9.0, 10.0, 0.0), (2, 1, 1, None, "A", "F", 4.0, 10.0, 0.01)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = plans.QUERIES["paragraph_shifts"](spark, str(tmp_path))
    assert "Join" not in _plan(got)
    assert {(r.l_orderkey, r.l_suppkey): (r.common, r.own) for r in got.collect()} == {(1, 7): (5.5, -3.5), (1, 8): (5.5, 3.5), (2, None): (3.0, 0.0)}


def test_candidates_shuffle_documents_only_by_their_number(spark, tmp_path):
    """tokens, pairs and stretches stay in the task that holds their document; nothing is dealt by line or by place."""
    spark.createDataFrame([(1, "one two three four five. of and of")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(5, "x one two tree four five y of and of z"), (6, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("line_candidates", "fuzzy_containment"):
        rows = plans.QUERIES[name](spark, str(tmp_path))
        if name == "line_candidates":
            assert sorted(map(tuple, rows.collect())) == [("1:0", 5, 1, 6, 1, 4), ("1:1", 5, 7, 10, 0, 3)]
            dealt = re.findall(r"hashpartitioning\(([^#]*)#", rows._jdf.queryExecution().executedPlan().toString())
            assert dealt and set(dealt) == {"stream"} and "Window" not in _plan(rows)
        else:
            assert sorted(r.line_id for r in rows.collect()) == ["1:0", "1:1"]


def test_candidates_in_tokens_with_gaps(spark):
    from versewise.operators import match

    tokens = [("s", p, w) for p, w in [*enumerate("a b c d e".split(), 10), *enumerate("f a b x".split(), 20), *enumerate("d e f".split(), 25)]]
    lines = [(1, "a b c d".split()), (2, "e f a b".split()), (3, "x d e f".split()), (4, ["e", "f"]), (5, "b x d e".split())]
    got = match.line_candidates(spark.createDataFrame(lines, "line_id int, words array<string>"), spark.createDataFrame(tokens, "stream string, pos long, word string")).collect()
    assert {(r.line_id, r.start, r.end, r.edits) for r in got} == {(1, 10, 14, 0), (2, 20, 23, 1), (3, 25, 28, 1), (4, 26, 28, 0), (5, 11, 15, 1)}
