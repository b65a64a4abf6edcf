"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index holds postings (term, document, position). A term is a pair of neighbouring words, which keeps lists
short; a benchmark item of one word is looked up by that word. Only terms of the benchmark are stored. A window
of the benchmark is found by taking the list of its rarest term, adjusting it by the term's offset, and
intersecting it with the adjusted lists of the window's other terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.llm.scratch import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Proximity matches: positions that a term may be off, and the share of a window's terms that must stand there. A window
#: of ten words with one of them replaced keeps seven of its nine pairs.
SLACK, SHARE = 2, 0.75
#: The benchmark's terms are broadcast up to this many (about 40 bytes each); beyond, the join shuffles.
BROADCAST_TERMS = 200_000


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only. ASCII texts take the built-in, which is the same for them and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(window_id, width, words)`` and their items ``(window_id, item_id)``.

    A window is ``width`` consecutive words; an item of fewer words, but not none, is one window.
    """
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    rows = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("words")).distinct()
    rows = rows.withColumn("window_id", F.sha2(F.concat_ws(" ", "words"), 256))
    return rows.select("window_id", F.size("words").alias("width"), "words").dropDuplicates(["window_id"]), rows.select("window_id", "item_id")


def window_terms(windows: DataFrame) -> DataFrame:
    """``(window_id, width, offset, term)``: the pairs of words of every window; its word, if it has one only."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("width") - 1)), lambda i: F.concat_ws(" ", F.slice("words", i, 2)))
    return windows.select("window_id", "width", F.posexplode(pairs).alias("offset", "term"))


def positional_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``(doc_id, text_key, term, pos)`` of the given terms, and a length record with term 0 a row.

    One pass over the texts: words are exploded, each is paired with the next, and all but the given terms are
    dropped before anything is shuffled. ``terms(term, term_id)`` holds the distinct terms; a one-word term is
    looked up beside the pairs. ``pos`` of a length record is the number of words. The rows of a repeated
    doc_id are told apart by a hash of their text.
    """
    few = terms.count() <= BROADCAST_TERMS
    singles = bool(terms.where("instr(term, ' ') = 0").take(1))
    # Rows of Python lists would start a second pool of Python workers on every executor.
    marker = terms.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).cast("long").alias("term_id"))
    wanted = terms.unionByName(marker)
    wanted = F.broadcast(wanted) if few else wanted
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), words(F.col(text_col)).alias("w"))
    rows = rows.select("doc_id", "text_key", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    # The last element is the length record: its word is empty, and the word before it pairs with nothing.
    pair = F.when(F.col("word") == "", F.lit("")).otherwise(F.concat("word", F.lit(" "), F.get("w", F.col("pos") + 1)))
    index = rows.select("doc_id", "text_key", "pos", pair.alias("term")).join(wanted, "term").select("doc_id", "text_key", "term_id", "pos")
    if singles:
        alone = rows.select("doc_id", "text_key", "pos", F.col("word").alias("term")).where("term <> ''")
        index = index.union(alone.join(wanted, "term").select("doc_id", "text_key", "term_id", "pos"))
    return index


def find_windows(index: DataFrame, terms: DataFrame, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """``(doc_id, text_key, window_id, width, start, exact, near)`` of windows' matches in the indexed documents.

    Each window's terms are ordered by the lengths of their lists. A match with at least ``share`` of the terms has one
    of as many of the rarest terms as may be missing and one more; their lists, adjusted by the terms' offsets,
    propose starts, and the lists of the others are intersected with them at the adjusted positions. ``exact`` when all
    terms stand where they should (the phrase itself); ``near``, a proximity match, when at least ``share`` of them do
    within ``slack`` positions. A window with a term that occurs nowhere has no exact match.
    """
    size = F.greatest(F.lit(1), F.col("width") - 1)
    lengths = index.where("term_id <> 0").groupBy("term_id").agg(F.count("*").alias("n"))
    by_rarity = Window.partitionBy("window_id").orderBy(F.coalesce("n", F.lit(0)), "offset")
    ranked = cut(terms.join(lengths, "term_id", "left").withColumn("rank", F.row_number().over(by_rarity)).where("n > 0"), "ranked")
    anchors = ranked.where(F.col("rank") <= size - F.ceil(size * share) + 1)
    anchors = F.broadcast(anchors) if anchors.count() <= BROADCAST_TERMS else anchors
    starts = index.join(anchors, "term_id").select("doc_id", "text_key", "window_id", "width", (F.col("pos") - F.col("offset")).alias("start")).distinct()
    starts = cut(starts, "starts")
    held = starts.select("doc_id", "text_key").distinct()
    held = F.broadcast(held) if held.count() <= BROADCAST_TERMS else held
    same_doc = F.col("i.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("i.text_key") == F.col("h.text_key"))
    # Positions meet in cells as wide as the slack reaches: those asked for in two of them, and each pair in one.
    cell = lambda pos: F.floor(pos / (2 * slack + 1)).cast("int")
    lists = index.where("term_id <> 0").alias("i").join(held.alias("h"), same_doc, "left_semi").distinct().withColumn("cell", cell(F.col("pos")))
    asked = starts.join(ranked.select("window_id", "offset", "term_id"), "window_id").withColumn("pos", F.col("start") + F.col("offset"))
    asked = asked.withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("pos") - slack), cell(F.col("pos") + slack)))))
    hit = F.col("i.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("i.text_key") == F.col("a.text_key")) & (F.col("i.term_id") == F.col("a.term_id")) & (F.col("i.cell") == F.col("a.cell")) & (F.abs(F.col("i.pos") - F.col("a.pos")) <= slack)
    met = asked.alias("a").join(lists.alias("i"), hit).groupBy("a.doc_id", "a.text_key", "a.window_id", "a.width", "a.start").agg(F.count(F.when(F.col("i.pos") == F.col("a.pos"), 1)).alias("there"), F.count_distinct("offset").alias("around"))
    return met.select("doc_id", "text_key", "window_id", "width", "start", (F.col("there") == size).alias("exact"), (F.col("around") >= size * share).alias("near")).where("exact or near")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """``(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items)``, a row per row.

    A document word inside an exact occurrence of a window is hit; ``n_items`` counts the items with such
    windows, ``items_sha256`` is the hash of their ids sorted as strings, and ``n_near_items`` counts the items
    with proximity matches. Null and empty texts have no words. Items without words match nothing; an item
    without an id is not listed. Repeated rows each get the same result.
    """
    windows, owners = benchmark_windows(items, width, item_col, item_text)
    terms = cut(window_terms(windows).withColumn("term_id", F.xxhash64("term")), "terms")
    index = cut(positional_index(docs, terms.select("term", "term_id").distinct(), id_col, text_col), "postings")
    found = cut(find_windows(index, terms.drop("term"), slack, share), "matches")
    # Of each document: its occurrences as intervals, swept in order.
    spans = F.array_sort(F.collect_set(F.when(F.col("exact"), F.struct("start", (F.col("start") + F.col("width")).alias("stop")))))
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("stop"))
    sweep = lambda s: F.aggregate(s, start, lambda a, x: F.struct((a["hit"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["stop"], x["start"]))).cast("int").alias("hit"), F.greatest(a["stop"], x["stop"]).cast("int").alias("stop")), lambda a: a["hit"])
    hits = found.groupBy("doc_id", "text_key").agg(sweep(spans).alias("n_hit"))
    listed = found.join(owners, "window_id").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item_id").cast("string")))).alias("ids"), F.count_distinct("item_id").alias("n_near_items"))
    facts = cut(hits.join(listed, hits.doc_id.eqNullSafe(listed.doc_id) & (hits.text_key == listed.text_key)).select(hits.doc_id, hits.text_key, "n_hit", "ids", "n_near_items"), "facts").alias("f")
    rows = index.where("term_id = 0").select("doc_id", "text_key", F.col("pos").alias("n_words")).alias("d")
    rows = rows.join(facts, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key")), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select("d.doc_id", "d.text_key", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near_items", F.lit(0)).alias("n_near_items"))
