"""Cases that earlier versions got wrong."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from versewise.llm import language_id, line_dedup, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_blank_lines_link_no_lines(spark):
    docs = spark.createDataFrame([(1, " " * 10), (2, "x" + " " * 9), (3, " " * 9 + "y")], "doc_id long, text string")
    assert all(r.dropped == [] for r in line_dedup.dedup_lines(docs).collect())


def test_a_column_named_letters_stays(spark):
    rows = [(i, f"{'der die das und nicht' if i % 2 else 'the of and that this'} {i % 7}" * 9, "de" if i % 2 else "en", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _letters int")
    kept = language_id.keep_identified(docs, language_id.fit_languages(docs))
    assert kept.columns == docs.columns and kept.count() > 50


def test_every_language_is_learned_and_predicted_alike_in_plain_python(spark):
    rnd = random.Random(4)
    words = {f"l{k:02d}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9))) for _ in range(60)] for k in range(24)}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(60)), lang) for i, lang in enumerate(sorted(words) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_languages(docs)
    assert [lang for lang, _ in model.dictionaries] == sorted(words) and len(model.margins) == 24
    got = {r.doc_id: r for r in language_id.predict_languages(docs, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) > 0.98 * len(rows)
    measure, fast, slow = language_id._coders(model)
    for i, text, _ in rows[:40]:
        best, margin = measure(text.encode(), fast)
        if margin < max(0.03, 2 * model.least_margin(best, len(text))):
            best, margin = measure(text.encode(), slow)
        assert (got[i].lang_pred, got[i].score) == (model.dictionaries[best][0], margin)



def test_languages_of_copies_and_of_numbers_are_learned(spark):
    """the sample is taken of different texts with letters, however many copies and bare numbers a language has."""
    rnd = random.Random(6)
    words = {lang: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(80)] for lang in ("aa", "bb", "cc")}
    texts = [(lang, " ".join(rnd.choice(words[lang]) for _ in range(50))) for lang in sorted(words) for _ in range(30)]
    copies = spark.range(150_000).selectExpr("'aa' AS lang", f"'{texts[0][1]}' AS text")
    numbers = spark.range(20_000).selectExpr("'bb' AS lang", "concat(id, ' !') AS text").unionByName(spark.range(50).selectExpr("'dd' AS lang", "string(id) AS text"))
    rows = spark.createDataFrame(texts, "lang string, text string")
    docs = rows.unionByName(copies).unionByName(numbers).withColumn("doc_id", F.monotonically_increasing_id())
    model = language_id.fit_languages(docs)
    assert [lang for lang, _ in model.dictionaries] == ["aa", "bb", "cc"] and model.counts == (150_030, 20_030, 30)
    for lang, data in model.dictionaries:
        assert sum(text.encode() in data for x, text in texts if x == lang) == 24, lang
    got = language_id.predict_languages(rows.withColumn("doc_id", F.col("lang")), model).collect()
    assert all(r.doc_id == r.lang_pred for r in got)


def test_the_mix_does_not_depend_on_partitions(spark):
    rows = [(1 if i < 150 else None, f"{'w ' * (i % 3 + 1)}{i}", "en", f"s{i % 2}", i) for i in range(200)] + [(7, "same text", "en", "s0", i % 2) for i in range(40)]
    mixed = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, DOCS).repartition(parts, "text")
        mixed.append(Counter(tuple(r) for r in corpus_pipeline.mix(spark, docs, "").collect()))
    assert mixed[0] == mixed[1] and mixed[0]


def test_equal_rows_take_their_share(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")] * 500 + [(i, "w " * (i % 9 + 1), "y") for i in range(2, 400)], "doc_id long, text string, source string")
    out = mixing.mix_sources(docs)
    assert out.count() == 898
    for r in out.groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("copies")).alias("most")).collect():
        assert abs(r.taken - r.target) <= 0.02 * r.target and r.most <= 3
