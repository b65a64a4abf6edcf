"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.llm import language_id
from versewise.llm.decontaminate import decontaminate
from versewise.llm.mixing import mix_sources
from versewise.llm.ngram_join import ngram_jaccard_join
from versewise.llm.queries import TOKENIZER
from versewise.llm.scratch import cut, small
from versewise.llm.token_store import read_token_store, write_token_store


def _same_row(docs: str, facts: str, *more: str) -> Column:
    """Whether a fact is about a row: the same doc_id (or none), text and further columns."""
    both = F.col(f"{docs}.doc_id").eqNullSafe(F.col(f"{facts}.doc_id")) & (F.xxhash64(f"{docs}.text") == F.col(f"{facts}.text_key"))
    for c in more:
        both &= F.col(f"{docs}.{c}").eqNullSafe(F.col(f"{facts}.{c}"))
    return both


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go (no letters, or a margin too narrow for the length).

    Null and empty texts have no letters and go. Repeated rows are judged alike, whole texts of any length are
    encoded, and ties go as too narrow. An empty table stays empty. Any further columns stay.
    """
    model = language_id.fit_languages(docs.where(~language_id.held_out()))
    return language_id.keep_identified(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class the first document by (doc_id, hash of the text) stays, null ids last.

    Documents are told apart by doc_id and text; of rows that are equal in both any one stays. Null texts and
    texts without words are in no class: they stay, once each. Any further columns stay, whatever their names.
    """
    classes = cut(ngram_jaccard_join(docs), "classes")
    gone = cut(classes.where(~F.col("first")).select("doc_id", "text_key").distinct(), "gone")
    kept = docs.alias("d").join(small(gone).alias("g"), _same_row("d", "g"), "left_anti")
    again = cut(classes.where("first").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1"), "again")
    if not again.take(1):
        return kept
    again = small(again).alias("a")
    once = kept.alias("d").join(again, _same_row("d", "a"), "left_anti")
    return once.unionByName(kept.alias("d").join(again, _same_row("d", "a"), "left_semi").dropDuplicates(["doc_id", "text"]))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a word inside a benchmark window go.

    Null and empty texts have no words and stay. Repeated rows go or stay together. Any further columns stay.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = cut(found.where("contaminated").select("doc_id", "text_key").distinct(), "hit")
    return docs.alias("d").join(small(hit).alias("h"), _same_row("d", "h"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source mix: every document as many times as the mix takes it, none included.

    Rows that are equal in doc_id, text and source share what the mix takes of them: each the whole number, and as
    many of them as remain one more. Null and empty texts have size 0; sources of size 0 are not taken. Any further
    columns stay, whatever their names.
    """
    key = ["doc_id", "text_key", "source"]
    taken = cut(mix_sources(docs).groupBy(*key).agg(F.sum("copies").cast("int").alias("n"), F.count("*").cast("int").alias("k")).where("n > 0"), "taken")
    rows = docs.alias("d").join(small(taken).alias("t"), _same_row("d", "t", "source")).select(F.struct("d.*").alias("d"), "t.n", "t.k", F.struct(*[f"t.{c}" for c in key]).alias("key"))
    # rows that agree in the key: equal ones are counted, and what remains of n goes to them in the order of their hashes
    several = rows.where("k > 1").groupBy("key", "d", "n", "k").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("key").orderBy(F.xxhash64(F.to_json("d")), F.to_json("d"))) - F.col("c")
    more = F.least(F.col("c"), F.greatest(F.lit(0), F.col("n") % F.col("k") - before))
    several = several.withColumn("n", (F.col("c") * F.floor(F.col("n") / F.col("k")) + more).cast("int")).drop("c").where("n > 0").select(rows.columns)
    every = rows.where("k = 1").unionByName(several)
    return every.select("d", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("d.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID output: shard files in doc_id order, and where each document stands in them.

    Null is the empty text: the end id alone. Repeated rows are written as often as they are. Null ids come first.
    """
    import public_tokenizers

    return read_token_store(spark, write_token_store(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [("language_id", identify), ("ngram_join", deduplicate), ("decontamination", clean), ("source_mix", mix), ("token_store", tokenize)]
#: The stages are samples, approximate searches and binary output; no SQL states their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
