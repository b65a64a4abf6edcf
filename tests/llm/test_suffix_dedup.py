"""Repeated strings against a table of all strings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from versewise.llm import suffix_dedup as sd


def _texts(seed: int) -> list:
    rnd = random.Random(seed)
    words = lambda n: " ".join(rnd.choice(["alpha", "beta", "gämma", "δ", "x", "quick"]) + str(rnd.randrange(50)) for _ in range(n))
    passages = [words(60) for _ in range(3)]
    texts = []
    for k in range(40):
        t = words(rnd.randrange(0, 80))
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            t += p[a : rnd.randrange(a, len(p) + 1)] + words(rnd.randrange(0, 9))
        texts.append(t + " " * rnd.randrange(0, 200) * (k % 9 == 0) + "ab" * rnd.randrange(0, 200) * (k % 11 == 0))
    return texts + texts[:5] + ["", None, passages[0][:64], "a" * 64, "b" * 65, "\n" * 500]


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_and_kept_bytes_equal_a_table_of_all_strings(spark, seed):
    texts = _texts(seed)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, k1 int").repartition(3)
    out = sd.dedup_repeats(docs, length=64).withColumn("kept", sd.kept_bytes(F.coalesce("text", F.lit("")), F.col("spans"))).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts))) and all(r.k1 == 1 for r in out)
    plain = sd.plain_repeats([(t or "").encode() for t in texts], 64)
    assert sum(map(len, plain)) > 20
    for r in out:
        assert [(s.start, s.end) for s in r.spans] == plain[r.doc_id]
        b, cuts = (r.text or "").encode(), plain[r.doc_id]
        assert bytes(r.kept) == b"".join(b[x:y] for x, y in zip([0] + [e for _, e in cuts], [s for s, _ in cuts] + [len(b)]))


def test_an_empty_table_and_one_without_repeats_have_no_spans(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sd.dedup_repeats(none).collect() == []
    one = spark.createDataFrame([(1, " ".join(map(str, range(400)))), (1, "short"), (None, None)], "doc_id long, text string")
    assert [len(r.spans) for r in sd.dedup_repeats(one).collect()] == [0, 0, 0]


def test_a_repeated_row_is_removed_whole_and_a_long_text_is_no_trouble(spark):
    long = np.random.default_rng(3).integers(97, 123, 2_500_000).astype(np.uint8).tobytes().decode()
    rows = [(1, "same " * 100)] * 3 + [(2, long), (3, "start " + long[1_048_000:1_049_000] + " end")]
    out = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in sd.dedup_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: [(0, 500)], 2: [(1_048_000, 1_049_000)], 3: [(6, 1006)]}


def test_anchors_depend_on_the_text_alone_across_tiles(monkeypatch):
    monkeypatch.setattr(sd, "TILE", 1 << 10)
    monkeypatch.setattr(sd, "_powers", {})
    data = np.frombuffer(np.random.default_rng(1).integers(97, 101, 9000).astype(np.uint8).tobytes() + b"z" * 900, np.uint8)
    ends = np.full(len(data), len(data))
    cut = sd.anchor_runs(data, ends, 192)
    monkeypatch.setattr(sd, "TILE", 1 << 20)
    monkeypatch.setattr(sd, "_powers", {})
    for a, b in zip(cut, sd.anchor_runs(data, ends, 192)):
        assert (a == b).all()
    place, first, last = cut
    assert first[0] == 0 and (first[1:] == last[:-1] + 1).all() and (place - first < 192).all() and (place >= last).all()


@pytest.mark.parametrize("seed", [5, 6])
def test_ranks_of_suffixes_equal_sorting_them(spark, seed):
    rnd = random.Random(seed)
    strings = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 30))] for _ in range(30)] + [[1] * 40, [1] * 40, [0]]
    rows = [(g, [(i, s, 1, 1) for i, s in enumerate(x)]) for g, x in enumerate(strings)]
    table = spark.createDataFrame(rows, "g long, x array<struct<i: int, s: long, step: int, cover: int>>")
    got = {(r.g, r.i): r["rank"] for r in sd.suffix_ranks(table, 1 << 20).collect()}
    every = sorted(x[i:] for x in strings for i in range(len(x)))
    less = {}
    for n, x in enumerate(every):
        less.setdefault(tuple(x), n)
    assert got == {(g, i): less[tuple(x[i:])] for g, x in enumerate(strings) for i in range(len(x))}


def test_a_run_of_equal_keys_over_several_ranges(spark, tmp_path):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, 5).otherwise(F.col("id") % 7 * 2).cast("long").alias("a"), (F.col("id") % 2).cast("int").alias("group"), F.col("id").alias("g"))
    out = sd.sorted_runs(rows, ["a", "g"], ["a"], f"file://{tmp_path}/t", 2).collect()
    everything = rows.collect()
    for key in {r.a for r in everything}:
        mine = [r for r in out if r.a == key]
        assert {(r.less0, r.less1) for r in mine} == {tuple(sum(x.a < key and x.group == g for x in everything) for g in (0, 1))}
        assert sum(r.head for r in mine) == 1 and all(r.same == (len(mine) > 1) for r in mine)


def test_strings_of_short_periods_are_found_beside_others(spark):
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    units = [word(p) for p in (1, 2, 3, 5, 7, 7, 11, 13)]
    texts = [word(rnd.randrange(260)) + "".join((u := rnd.choice(units)) * (rnd.randrange(300, 700) // len(u)) + word(rnd.randrange(90)) for _ in range(rnd.randrange(1, 3))) for _ in range(60)]
    out = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in sd.dedup_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == dict(enumerate(sd.plain_repeats([t.encode() for t in texts])))
