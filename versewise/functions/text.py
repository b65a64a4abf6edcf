"""Text functions of timed lyrics as column expressions (Column -> Column)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from versewise.functions import let
from versewise.functions.numbers import TOKEN

# Apostrophe variants, and the words without lexical content.
APOSTROPHES = "ʼ`´＇"
VOCABLES = "(?:h?m+(?:h?m+)*|mh?m+|a+h*|o+h*|u+h+|e+y+|a+y+|la+|na+|da+|whoa+|ha+|w?h?o+o+|ow+|hee+|ye+a+h*|hey+|shamone)"
WORDS = r"[A-Za-z]+(?:['’][A-Za-z]+)*"


def _folds() -> tuple[str, str]:
    """Letters of the first plane that are an ASCII letter with marks, and those letters."""
    pairs = []
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and c.isalpha() and base.isascii() and base.isalpha() and all(unicodedata.category(m) == "Mn" for m in marks):
            pairs.append((c, base))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folds()


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends (B1)."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tighten(text: Column) -> Column:
    """No space before punctuation (B1)."""
    return F.regexp_replace(text, r" ([,.;:!?])", "$1")


def unify_breaks(text: Column) -> Column:
    """Byte order mark stripped, CRLF and CR as LF (B2)."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def compose(text: Column) -> Column:
    """Letters and their marks in composed form (B2). Only texts with marks go to Python."""
    marked = text.rlike(r"[\p{M}\x{1100}-\x{11FF}\x{2126}\x{212A}\x{212B}]")
    return F.when(marked, F.pandas_udf(_composed, "string")(F.when(marked, text))).otherwise(text)


def unify_apostrophes(text: Column) -> Column:
    """Apostrophe variants as U+2019; a left quote only after a letter or digit, or before a decade."""
    return F.regexp_replace(F.translate(text, APOSTROPHES, "’" * len(APOSTROPHES)), "(?<=[\\p{L}\\p{N}])‘|‘(?=[0-9]{2}s\\b)", "’")


def is_section_label(line: Column) -> Column:
    """A line that is one bracketed label."""
    return line.rlike(r"^\s*\[[^\]]*\]\s*$")


def has_letters(line: Column) -> Column:
    """Letters or decimal digits."""
    return line.rlike(r"[\p{L}\p{M}\p{Nd}]")


def credit(line: Column) -> Column:
    """The names of a ``written by:`` line, or null."""
    return F.nullif(collapse(F.regexp_extract(line, r"(?i)^\s*written\s+by\s*:\s*(.+?)\s*$", 1)), F.lit(""))


def is_second_voice(line: Column) -> Column:
    """A leading ``>`` marks the second singer."""
    return F.ltrim(line).startswith(">")


def without_voice_mark(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s*>", "")


def backing(line: Column) -> Column:
    """The parenthesised phrases of a line, collapsed, empty ones left out."""
    return F.filter(F.transform(F.regexp_extract_all(line, F.lit(r"\(([^()]*)\)"), F.lit(1)), collapse), lambda x: x != "")


def main_text(line: Column) -> Column:
    """A line without its parenthesised phrases."""
    return tighten(collapse(F.regexp_replace(line, r"\([^()]*\)", " ")))


def canonical(text: Column) -> Column:
    """Letters, numbers and marks, lower-cased; punctuation and space dropped; null if another symbol occurs."""
    return F.when(text.rlike(r"[^\p{L}\p{N}\p{M}\p{P}\s]"), F.lit(None)).otherwise(F.lower(F.regexp_replace(text, r"[\p{P}\s]", "")))


def fold_latin(text: Column) -> Column:
    """Latin letters without their diacritics, for alignment only."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def first_unsupported(text: Column) -> Column:
    """Code point (hex) of the first character that alignment does not support, or null."""
    found = F.regexp_extract(fold_latin(text), r"([^\sA-Za-z\p{P}’])", 1)
    return F.when(found != "", F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(found)), 4, "0")))


def running(sizes: Column) -> Column:
    """Sums of an array's elements up to each, by doubling the stretch that is summed: n log n steps, no growing arrays."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(sizes), F.lit(1)))).cast("int"))
    step = lambda sums, k: F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))
    return F.aggregate(rounds, sizes, step)


def words_of(text: Column) -> Column:
    """Words of English letters with inner apostrophes, after folding, and numeric tokens, as they stand.

    Folding keeps every character's place, so where it changes a text its words are cut where the folded ones stand.
    """

    def of(t: Column, folded: Column) -> Column:
        cut = lambda chars: F.transform(_places(folded, F.length), lambda w: F.array_join(F.slice(chars, w["begin"] + 1, w["size"]), ""))
        return F.when(t == folded, F.regexp_extract_all(folded, F.lit(_ANY_WORD), F.lit(0))).otherwise(let(F.split(t, ""), cut))

    return let(text, lambda t: let(fold_latin(t), lambda folded: of(t, folded)))


_ANY_WORD = f"(?:{TOKEN}|{WORDS})"


def _places(folded: Column, size: Callable[[Column], Column]) -> Column:
    """Words of a folded text as (begin, size), from 0, in units that ``size`` counts."""

    def of(words: Column, between: Column) -> Column:
        # what stands up to the end of each word: the words so far and what stands before them
        ends = running(F.transform(words, lambda w, i: size(w) + size(F.get(between, i))))
        return F.transform(F.arrays_zip(words.alias("w"), ends.alias("e")), lambda x: F.struct((x["e"] - size(x["w"])).alias("begin"), size(x["w"]).alias("size")))

    return let(F.regexp_extract_all(folded, F.lit(_ANY_WORD), F.lit(0)), lambda words: let(F.split(folded, _ANY_WORD), lambda between: of(words, between)))


def word_places(text: Column) -> Column:
    """Words as (word, begin, size) in characters, from 0."""
    return _with_words(text, F.length, "begin", "size")


def _with_words(text: Column, size: Callable[[Column], Column], begin: str, length: str) -> Column:
    def of(words: Column, places: Column) -> Column:
        return F.transform(F.arrays_zip(words.alias("w"), places.alias("p")), lambda x: F.struct(x["w"].alias("word"), x["p"]["begin"].alias(begin), x["p"]["size"].alias(length)))

    return let(text, lambda t: let(words_of(t), lambda words: let(_places(fold_latin(t), size), lambda places: of(words, places))))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def utf16_slice(text: Column, start: Column, length: Column) -> Column:
    """The slice of UTF-16 units that begins at ``start`` (from 0)."""
    return F.decode(F.substring(F.encode(text, "UTF-16LE"), (start * 2 + 1).cast("int"), (length * 2).cast("int")), "UTF-16LE")


def word_ranges(text: Column) -> Column:
    """Words with UTF-16 ranges: array of (word, start_utf16, length_utf16) (B12). Folded letters have one unit, as before."""
    return _with_words(text, utf16_length, "start_utf16", "length_utf16")


def english_words(text: Column) -> Column:
    """Lower-cased words with plain apostrophes; null where another letter, digit or symbol occurs."""
    return F.when(text.rlike(r"[\p{S}\p{M}\p{C}\p{N}]|[^\P{L}A-Za-z]"), F.lit(None)).otherwise(F.transform(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), lambda w: F.lower(F.replace(w, F.lit("’"), F.lit("'")))))


def is_vocable(text: Column) -> Column:
    """Every run of letters is a vocable, and there is one."""
    w = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    return (F.size(w) > 0) & F.forall(w, lambda x: F.lower(x).rlike(f"^{VOCABLES}$"))


def low_confidence(similarity: Column, flags: Column, marks: list[str]) -> Column:
    """Similarity below 0.4 (null counts as 1), or one of the marks among the flags."""
    return (F.coalesce(similarity, F.lit(1.0)) < 0.4) | F.coalesce(F.arrays_overlap(flags, F.array(*[F.lit(m) for m in marks])), F.lit(False))


def has_japanese(text: Column) -> Column:
    """Kana or kanji."""
    return text.rlike(r"[\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{30FC}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]")


def disagreement(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length, of canonical texts; 0 for two empty ones (H9)."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def syllables(word: Column) -> Column:
    """Vowel groups, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.lower(word), F.lit("[aeiouy]+")))


def xml_escape(text: Column) -> Column:
    """Ampersand and angle brackets as entities."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def stamp(us: Column) -> Column:
    """Microseconds as trimmed decimal seconds: ``12.5s`` (H5)."""
    number = F.format_string("%d.%06d", F.floor(us / 1000000).cast("long"), (us % 1000000).cast("long"))
    return F.when(us.isNotNull(), F.concat(F.regexp_replace(F.regexp_replace(number, "0+$", ""), r"\.$", ""), F.lit("s")))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the canonical JSON of columns in the given order."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def joins_grapheme(suffix: Column) -> Column:
    """Whether a text begins with a mark or joiner, so that a cut before it would split a character."""
    return suffix.rlike(r"^[\p{M}\x{200D}]")
