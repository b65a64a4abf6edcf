from versewise.llm import decontaminate, language_id, scratch, token_store


def test_a_worker_keeps_one_encoder():
    import public_tokenizers
    from versewise.llm.queries import TOKENIZER

    path = public_tokenizers.path(TOKENIZER)
    encoder = token_store._word_encoder(path, 2)
    assert token_store._word_encoder(path, 2) is encoder

    class Held:
        value = language_id.LanguageModel((("a", b"abc " * 40), ("b", b"xyz " * 40)), (1, 1))

    coders = language_id._cached(Held)
    assert scratch._kept[1] is coders is language_id._cached(Held)
    assert token_store._word_encoder(path, 2) is not encoder


def test_postings_start_no_python_workers(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "'a b c' AS text")
    terms = spark.range(1).selectExpr("'a b' AS term", "7L AS term_id")
    index = decontaminate.positional_index(docs, terms)
    assert "ExistingRDD" not in index._jdf.queryExecution().toString()
    assert sorted((r.term_id, r.pos) for r in index.collect()) == [(0, 3)] * 3 + [(7, 0)] * 3
