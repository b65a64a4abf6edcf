"""Queries over whole tables and whole texts, against brute force on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from versewise import plans


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_levenshtein_disagreement_compares_whole_texts(spark, tmp_path):
    rnd = random.Random(1)
    long = "".join(rnd.choices("abcdef", k=450))
    turns = {1: [long, long[:300] + "".join(rnd.choices("xyz", k=90)) + long[390:]], 2: ["Größe, 日本", "grösse 日本語"], 3: ["a 😀 b", "A B"], 4: ["?!", "--"]}
    rows = [(c, t, "user", text) for c, texts in turns.items() for t, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    bare = lambda s: "".join(c for c in s if not c.isspace() and (ord(c) > 127 or c.isalnum())).lower()
    want = {}
    for c, (b, a) in turns.items():
        a, b = bare(a), bare(b)
        want[c, 1] = distance(a, b) / max(len(a), len(b), 1)
    got = {(r.conv_id, r.turn): r.disagreement for r in plans.QUERIES["levenshtein_disagreement"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6) and want[1, 1] > 0.1


def test_focus_grid_covers_the_month(spark, tmp_path):
    rows = [(1, 7, "a", "2024-01-02 00:30:00", 1.0), (2, 7, "b", "2024-01-20 05:10:00", 1.0), (3, 7, "b", "2024-01-31 22:00:00", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string, value double").withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.t - 1_704_067_200_000_000) // 3_600_000_000: r.event_id for r in plans.QUERIES["focus_grid"](spark, str(tmp_path)).collect()}
    at = {1: 24.5, 2: 19 * 24 + 5 + 1 / 6, 3: 30 * 24 + 22}
    assert got == {h: next((i for i, t in at.items() if t <= h < t + 12), None) for h in range(31 * 24 + 1)}


def test_line_candidates_hold_short_sentences(spark, tmp_path):
    from versewise.operators import match

    rnd = random.Random(4)
    vocab = ["the", "of", "and", *(f"{a}{b}" for a in "bcdfg" for b in "aeiou")]
    docs = [[rnd.choice(vocab) for _ in range(150)] for _ in range(6)] + [["la"] * 7, ["one"]]
    items = {7: ["the", "la la", "of and the", "one", ""] + [" ".join(d[5 : 5 + n]) for n, d in enumerate(docs[:6], 2)], 8: ["ba of ba", "the x of and", "zz"] + ["nowhere at all"] * 998 + ["bu"]}
    spark.createDataFrame([(k, ".".join(v)) for k, v in items.items()], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for k, sentences in items.items():
        for i, s in enumerate(sentences):
            w = s.split()
            for j, d in enumerate(docs):
                found = [(b, e, x, m) for e, b, x, m in match._semi_global(w, d) if w and m >= min(2, len(w)) and x <= 0.3 * len(w) and b < e]
                kept = []
                for c in sorted(found, key=lambda c: (c[2] - c[3], c[2], c[0], c[1])):
                    if not any(c[0] < o[1] and o[0] < c[1] for o in kept):
                        kept.append(c)
                want |= {(f"{k}:{i}", j, *c) for c in kept}
    rows = plans.QUERIES["line_candidates"](spark, str(tmp_path)).collect()
    got = {(r.line_id, r.stream, r.start, r.end, r.edits, r.matches) for r in rows}
    assert got == want and len(rows) == len(got)
    assert {r.line_id for r in plans.QUERIES["fuzzy_containment"](spark, str(tmp_path)).collect()} == {x[0] for x in want}
