"""Spoken numbers (B11): numeric tokens of lyrics by a generated dictionary, larger numbers by groups of three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versewise.functions import let

# The English number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
# Fixed value: the form of a numeric token.
TOKEN = r"(?<![A-Za-z0-9.,:])'?[0-9]+(?:[,:][0-9]+)*(?:st|nd|rd|th|s)?(?![A-Za-z0-9]|[.,:][0-9])"


def _two(m: Column) -> Column:
    """Cardinal words of 0 to 99."""
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))
    ten = F.get(tens, (m / 10).cast("int"))
    return F.when(m < 20, F.get(ones, m)).when(m % 10 == 0, ten).otherwise(F.concat_ws("-", ten, F.get(ones, m % 10)))


def _small(n: Column) -> Column:
    """Cardinal words of 0 to 999."""

    def of(x: Column) -> Column:
        hundreds = F.concat(F.get(F.array(*map(F.lit, ONES)), (x / 100).cast("int")), F.lit(" hundred"))
        return F.concat_ws(" ", F.when(x >= 100, hundreds), F.when((x < 100) | (x % 100 > 0), let(x % 100, _two)))

    return let(n.cast("int"), of)


def cardinal(n: Column) -> Column:
    """Cardinal words of 0 to 999,999,999, by groups of three digits."""

    def of(x: Column) -> Column:
        group = lambda k, name: let(F.floor(x / k) % 1000, lambda g: F.when(g > 0, F.concat(_small(g), F.lit(name))))
        return F.when(x == 0, F.lit("zero")).otherwise(F.concat_ws(" ", group(1000000, " million"), group(1000, " thousand"), group(1, "")))

    return let(n, of)


def year(n: Column) -> Column:
    """Years 1100 to 2099 as they are sung."""

    def of(x: Column) -> Column:
        tail = let((x % 100).cast("int"), lambda low: F.when(low == 0, F.lit("hundred")).when(low < 10, F.concat(F.lit("oh "), _small(low))).otherwise(_small(low)))
        return F.when(x.between(2000, 2009), cardinal(x)).otherwise(F.concat_ws(" ", _small(x / 100), tail))

    return let(n, of)


def plural(words: Column) -> Column:
    return F.when(words.endswith("y"), F.concat(F.regexp_replace(words, "y$", ""), F.lit("ies"))).otherwise(F.concat(words, F.lit("s")))


def ordinal(n: Column) -> Column:
    """Ordinal words: the last word of the cardinal changes."""
    odd = F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair])
    ending = lambda w: F.coalesce(F.element_at(odd, w), F.when(w.endswith("y"), F.concat(F.regexp_replace(w, "y$", ""), F.lit("ieth"))).otherwise(F.concat(w, F.lit("th"))))
    split = lambda words: F.concat(F.regexp_extract(words, r"^(.*[ -])?([a-z]+)$", 1), let(F.regexp_extract(words, r"^(.*[ -])?([a-z]+)$", 2), ending))
    return let(cardinal(n), split)


def ordinal_suffix(n: Column) -> Column:
    last = n % 10
    return F.when((n % 100).between(11, 13) | ~last.between(1, 3), F.lit("th")).when(last == 1, F.lit("st")).when(last == 2, F.lit("nd")).otherwise(F.lit("rd"))


def _clock(body: Column) -> Column:
    part = lambda i: F.nullif(F.regexp_extract(body, r"^([0-9]{1,9}):([0-9]{2})$", i), F.lit("")).cast("int")
    words = lambda h: let(part(2), lambda m: F.when(h.between(0, 24) & (m < 60), F.when(m == 0, F.concat(_small(h), F.lit(" o'clock"))).when(m < 10, F.concat(_small(h), F.lit(" oh "), _small(m))).otherwise(F.concat_ws(" ", _small(h), _small(m)))))
    return let(part(1), words)


def _tens(body: Column, decade: Column) -> Column:
    """Decades: ``80s``, ``'90s``, ``1980s``, ``1900s``."""

    def of(n: Column) -> Column:
        ten = F.get(F.array(*map(F.lit, TENS)), (F.floor(n / 10) % 10).cast("int"))
        short = F.when(n.between(10, 90), plural(ten))
        long = F.when(n % 100 == 0, plural(year(n))).otherwise(F.concat_ws(" ", _small(n / 100), plural(ten)))
        return F.when(n % 10 == 0, F.when(decade | (n < 100), short).when(n.between(1000, 2090), long))

    return let(F.nullif(F.regexp_extract(body, r"^([0-9]{1,9})s$", 1), F.lit("")).cast("bigint"), of)


def spoken(token: Column) -> Column:
    """Spoken words of one numeric token, or null for a form that is not supported."""
    decade = token.startswith("'")

    def of(body: Column) -> Column:
        plain = body.rlike(r"^(?:0|[1-9][0-9]{0,8}|[0-9]{1,3}(?:,[0-9]{3}){1,2})(?:st|nd|rd|th)?$")
        number = F.when(plain & ~decade, F.nullif(F.regexp_replace(body, "[^0-9]", ""), F.lit("")).cast("bigint"))
        suffix = F.regexp_extract(body, "(st|nd|rd|th)$", 1)
        nth = let(number, lambda n: F.when((n > 0) & (ordinal_suffix(n) == suffix), ordinal(n)))
        simple = let(number, lambda n: F.when(body.rlike("^[0-9]{4}$") & n.between(1100, 2099), year(n)).otherwise(cardinal(n)))
        return F.when(body.contains(":"), F.when(~decade, _clock(body))).when(suffix != "", nth).when(body.endswith("s"), _tens(body, decade)).otherwise(F.when(number.isNotNull(), simple))

    return let(F.regexp_replace(token, "^'", ""), of)


def number_dictionary(spark: SparkSession, most: int = 9999) -> DataFrame:
    """``(token, words)`` of the plain, ordinal, decade and clock tokens up to ``most``: about 22,000 rows, to broadcast."""
    n, text = F.col("id"), F.col("id").cast("string")
    tens = spark.range(10, 2091, 10).where("id < 100 or id >= 1000")
    clocks = spark.range(25 * 60).select(F.format_string("%d:%02d", F.expr("id div 60"), n % 60))
    tokens = spark.range(most + 1).select(text.alias("token")).union(spark.range(1, most + 1).select(F.concat(text, ordinal_suffix(n))))
    tokens = tokens.union(tens.select(F.concat(text, F.lit("s")))).union(tens.where("id < 100").select(F.concat(F.lit("'"), text, F.lit("s")))).union(clocks)
    return tokens.withColumn("words", spoken(F.col("token"))).where("words is not null")


def expand_numbers(lines: DataFrame, text: str = "text", to: str = "expanded") -> DataFrame:
    """Adds ``to``: every supported numeric token of a text replaced by its spoken words, the others unchanged.

    The text is split around its tokens and the tokens are transformed where they stand: no join is needed.
    """
    fenced = F.split(F.regexp_replace(F.col(text), f"({TOKEN})", "\x01$1\x02"), "\x01")
    piece = lambda p: F.when(F.instr(p, "\x02") > 0, F.concat(F.coalesce(spoken(F.substring_index(p, "\x02", 1)), F.substring_index(p, "\x02", 1)), F.substring_index(p, "\x02", -1))).otherwise(p)
    return lines.withColumn(to, F.array_join(F.transform(fenced, piece), ""))
