"""Order MinHash fingerprints, in DataFrame operations only.

The k-mers of a text's tokens are numbered by their occurrence, so that equal k-mers count as often as they
stand. Their hashes deal the numbered k-mers to ``bins`` bins; in each bin the ``l`` least by hash are selected, put
back into their order in the text and hashed as a tuple. Two texts agree in a bin when they share its selected
k-mers in the same order, so the share of equal bins falls with the edit distance and not only with the overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.llm.ranges import range_bounds, range_of

#: Tokens are words of up to twelve characters; longer runs without white space are cut after vowels and after
#: characters beyond ASCII, so that an edit inside one moves no later cut, and after eight characters at most.
TOKEN = r"\S{1,12}+(?!\S)|\S{0,7}?[aeiouAEIOU[^\x00-\x7F]&&\S]|\S{1,8}"
BINS, PICKED, K = 32, 2, 3
#: Numbered k-mers that are looked at first: the least by hash, eight a bin on average. Bins that hold too few of
#: them are filled up from all others.
LEAST = 8 * BINS
_AT = 31  # low bits of a packed number: the place in the text, for which any array's length fits
_PLACE = (1 << _AT) - 1
_BITS = ~_PLACE


def _packed(w: Column) -> Column:
    """Of every k-mer of tokens its hash's high bits and its place, as one number; fewer tokens are one k-mer."""
    kmer = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)]).bitwiseAND(F.lit(_BITS)).bitwiseOR(i.cast("bigint"))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - K)), kmer))


def fingerprint_columns(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds ``to``: the fingerprint (array of BINS hashes; null where a bin is empty) of column ``text``.

    Texts of any length; ties between equal k-mers go by their number. Columns of ``df`` that begin with an underscore
    must not have the names used here.
    Each step is a column of its own, so that no array is computed twice.
    """
    high = lambda x: x.bitwiseAND(F.lit(_BITS))
    df = df.withColumn("_w", F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).withColumn("_s", F.sort_array(_packed(F.col("_w"))))
    # Without repeated k-mers the sorted array is in order already. Else first occurrences keep their hash, and the
    # further ones of a repeated k-mer get hashes of their own number.
    df = df.withColumn("_more", F.size(F.array_distinct(F.transform("_s", high))) < F.size("_s"))
    same = lambda i, j: high(F.get("_s", i)) == high(F.get("_s", j))
    first = F.filter("_s", lambda x, i: (i == 0) | ~same(i, F.greatest(F.lit(0), i - 1)))
    df = df.withColumn("_first", F.when(F.col("_more"), first).otherwise(F.col("_s")))
    again = F.filter(F.sequence(F.lit(1), F.size("_s") - 1), lambda i: same(i, i - 1))
    # How far its run of equals reaches back, by halving: the run is contiguous as the array is sorted.
    steps = F.transform(F.sequence(F.ceil(F.log2(F.size("_s") + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2), b).cast("int"))
    df = df.withColumn("_steps", F.when(F.col("_more"), steps))
    back = lambda i: F.aggregate("_steps", F.lit(0), lambda d, s: F.when((i >= d + s) & same(F.greatest(F.lit(0), i - d - s), i), d + s).otherwise(d))
    numbered = F.transform(again, lambda i: F.xxhash64(high(F.get("_s", i)), back(i)).bitwiseAND(F.lit(_BITS)).bitwiseOR(F.get("_s", i).bitwiseAND(F.lit(_PLACE))))
    df = df.withColumn("_again", F.when(F.col("_more"), numbered))
    every = F.when(F.col("_more"), F.sort_array(F.concat("_first", "_again"))).otherwise(F.col("_first"))
    df = df.withColumn("_every", every).withColumn("_head", F.slice("_every", 1, LEAST))
    # From here on numbers are packed as (bin, place, index into the least), so that all sorts are of plain numbers.
    # The bin comes from the hash's last bits, on which the order among the least does not depend.
    bin_of = lambda x: F.shiftrightunsigned(x, _AT).bitwiseAND(F.lit(BINS - 1)).cast("int")
    by_bin = lambda least: F.sort_array(F.transform(least, lambda x, i: F.shiftleft(bin_of(x).cast("bigint"), 32).bitwiseOR(i.cast("bigint"))))
    df = df.withColumn("_binned", by_bin("_head"))
    # Bins that hold PICKED of the first ones, as a set of bits; for the others all the rest is looked through.
    held = F.filter("_binned", lambda k, i: F.shiftright(F.get("_binned", i + (PICKED - 1)), 32) == F.shiftright(k, 32))
    full = F.aggregate(held, F.lit(0).cast("bigint"), lambda a, k: a.bitwiseOR(F.pow(F.lit(2), F.shiftright(k, 32)).cast("bigint")))
    df = df.withColumn("_full", F.when(F.size("_every") > LEAST, full).otherwise((1 << BINS) - 1))
    rest = F.filter("_every", lambda x, i: (i >= LEAST) & (F.col("_full").bitwiseAND(F.pow(F.lit(2), bin_of(x)).cast("bigint")) == 0))
    short = F.col("_full") != (1 << BINS) - 1
    df = df.withColumn("_least", F.when(short, F.concat("_head", rest)).otherwise(F.col("_head")))
    df = df.withColumn("_sorted", F.when(short, by_bin("_least")).otherwise(F.col("_binned")))
    picked = F.filter("_sorted", lambda k, i: (i < PICKED) | (F.shiftright(F.get("_sorted", F.greatest(F.lit(0), i - PICKED)), 32) != F.shiftright(k, 32)))
    index = lambda k: k.bitwiseAND(F.lit((1 << 28) - 1)).cast("int")
    place = lambda k: F.shiftleft(F.get("_least", index(k)).bitwiseAND(F.lit(_PLACE)), 28)
    df = df.withColumn("_placed", F.sort_array(F.transform(picked, lambda k: F.shiftleft(F.shiftright(k, 32), 59).bitwiseOR(place(k)).bitwiseOR(index(k).cast("bigint")))))
    # Tuples: the selected k-mers of a bin in the text's order; the last of a bin closes its tuple.
    at = lambda i: F.get("_placed", i)
    bin_at, hash_at = lambda k: F.shiftrightunsigned(k, 59), lambda k: high(F.get("_least", index(k)))
    ends = F.filter(F.sequence(F.lit(0), F.size("_placed") - 1), lambda i: at(i + 1).isNull() | (bin_at(at(i + 1)) != bin_at(at(i))))
    before = lambda i: F.when((i > 0) & (bin_at(at(F.greatest(F.lit(0), i - 1))) == bin_at(at(i))), hash_at(at(F.greatest(F.lit(0), i - 1)))).otherwise(F.lit(0))
    closed = F.transform(ends, lambda i: F.struct(bin_at(at(i)).cast("int").alias("b"), F.xxhash64(before(i), hash_at(at(i))).alias("t")))
    df = df.withColumn("_closed", F.when(F.size("_placed") > 0, F.map_from_entries(closed)).otherwise(F.create_map().cast("map<int,bigint>")))
    # One look-up a bin: inside a lambda the optimizer would put the map's whole expression, once for every bin.
    df = df.withColumn(to, F.array(*[F.element_at("_closed", F.lit(b)) for b in range(BINS)]))
    return df.drop("_w", "_s", "_more", "_steps", "_first", "_again", "_every", "_head", "_full", "_least", "_binned", "_sorted", "_placed", "_closed")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those that either text has; 1 for two texts without tokens."""
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda v: v))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda v: v))
    return F.when(either == 0, F.lit(1.0)).otherwise(equal / either)


def as_hex(fingerprint: Column) -> Column:
    """A printable fingerprint: 16 hexadecimal digits a bin, dots for an empty one."""
    return F.concat_ws("", F.transform(fingerprint, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x), 16, "0")), F.lit("." * 16))))


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """``(doc_id, n_chars, edited, fp, edited_fp, next_fp)`` of every document.

    The edited text is the text with its last third (rounded down) replaced by as many characters (or all) from
    the front of the next document in descending doc_id; after the last comes the first. Null is the empty text.
    Rows of one id are ordered by their texts; a null id comes last. A table of one row is its own next. Ids are
    integers. An empty table gives no rows.

    Rows are dealt to ranges of ids; each range's first document is also sent, as a guest, to the range before
    it, so that a window in each range sees the next text without one order over the whole table. The driver
    holds a bound and an id a range.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc_id", F.octet_length("text"), block_bytes)
    block = range_of(F.col("doc_id"), bounds)
    # The first of each range in descending order: its largest id, or null for a range of null ids alone.
    tops = {r.b: r.top for r in rows.select("doc_id", block.alias("b")).groupBy("b").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    to = {tops[b]: order[k - 1] for k, b in enumerate(order)}  # the range that sees b's first as its last next
    known = {k: v for k, v in to.items() if k is not None}
    guest = F.lit(None).cast("int")
    if known:
        pairs = F.map_from_arrays(F.array(*[F.lit(k).cast("long") for k in known]), F.array(*[F.lit(int(v)) for v in known.values()]))
        guest = F.element_at(pairs, F.col("doc_id"))
    if None in to:
        guest = F.when(F.col("doc_id").isNull(), F.lit(int(to[None]))).otherwise(guest)
    rows = fingerprint_columns(rows, "text", "fp")
    own = F.struct(block.cast("int").alias("block"), F.lit(0).alias("guest"))
    rows = rows.withColumn("_to", guest)
    places = F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_to").alias("block"), F.lit(1).alias("guest"))))
    rows = rows.select("doc_id", "text", "fp", F.explode(places).alias("at")).select("doc_id", "text", "fp", "at.block", "at.guest")
    rows = rows.repartition(len(bounds) + 1, "block")
    w = Window.partitionBy("block").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    third = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)}).where("guest = 0")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    return fingerprint_columns(rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp"), "edited", "edited_fp")
