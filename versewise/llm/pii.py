"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame operations only.

Base entities (e-mail, IP, card and phone numbers) are the seeds. The words around them are lexical patterns; the
graph of patterns and the values that stand in them, over the whole corpus, is scored in rounds: a pattern is as
good as the values it is known for, a value as good as its patterns. Values that good patterns agree on are
found wherever they stand, and become seeds of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.llm.scratch import cut

# Kinds in their order, and their patterns. Repetitions are possessive where giving back can never
# help, and matches begin at the front of a run or where the last match ended, so that long runs cost no more
# than their length; the matches are those of the plain patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text needs for a kind to be looked for at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: A candidate is a word with a digit or an at sign, without the marks around it.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: A candidate too: words that begin with a digit, a plus or a bracket and go on with groups of digits, a blank between.
GROUPS = r"(?<!\S)[+(]{0,2}+[0-9][0-9().-]*+(?: \(?+[0-9][0-9().-]*+)++(?![^\s.,;:!?])"
#: Production parameters of the bootstrap.
MIN_SUPPORT, MIN_PATTERN, MIN_VALUE, MIN_DIGITS = 3, 0.6, 0.85, 4
#: Characters beside a span that its neighbouring words are looked for in first.
NEAR = 80
_SPAN = "array<struct<start:int,end:int,value:string>>"


def find_all(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), in code points, end exclusive.

    Matches are fenced by two control characters (any in the text are replaced first, one for one), the text is
    split at the fences, and the lengths of the pieces are summed.
    """
    clean = F.when(text.rlike("[\\x01\\x02]"), F.translate(text, "\x01\x02", "\x03\x03")).otherwise(text)
    pieces = F.split(F.regexp_replace(clean, pattern, "\x01$0\x02"), "\x01")
    start = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(s: Column, piece: Column) -> Column:
        value = F.substring_index(piece, "\x02", 1)
        span = F.struct(s["at"].alias("start"), (s["at"] + F.length(value)).alias("end"), value.alias("value"))
        return F.struct((s["at"] + F.length(piece) - 1).alias("at"), F.concat(s["found"], F.array(span)).alias("found"))

    return F.aggregate(F.slice(pieces, 2, F.greatest(F.lit(0), F.size(pieces) - 1)), start, step, lambda s: s["found"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    weighed = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + (d.cast("int") * 2) / 10).cast("int"))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)(?:\.|$)){4}$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n < 16) | (n > 19), F.lit(False)).otherwise(luhn(_digits(value)))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of one kind; failing ones are dropped without another try."""
    found = F.filter(find_all(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(F.array().cast(_SPAN))


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_context(text: Column, size: Column, span: Column, body) -> Column:
    """``body`` of (far, near, after): the two words before a span and the one after it, whole and lower-cased.

    A word is empty where there is none. They are looked for in NEAR characters on either side, and in all that stands
    there if a word reaches further. ``size`` is the text's length.
    """
    n = span["start"]
    words = r"^\s*+(\S++)(?:\s++(\S++))?"
    close = F.substring(text, F.greatest(F.lit(1), n - NEAR + 1), F.least(F.lit(NEAR), n))
    beside = F.struct(close.alias("before"), F.substring(text, span["end"] + 1, F.lit(NEAR)).alias("after"))

    def whole(x: Column) -> Column:
        before = F.when((n <= NEAR) | x["before"].rlike(r"\s\S+\s+\S+\s*$"), x["before"]).otherwise(F.substring(text, F.lit(1), n))
        after = F.when((size - span["end"] <= NEAR) | x["after"].rlike(r"^\s*\S+\s"), x["after"]).otherwise(F.substring(text, span["end"] + 1, size))
        return F.struct(F.reverse(F.lower(before)).alias("before"), F.lower(after).alias("after"))

    parts = lambda x: body(F.reverse(F.regexp_extract(x["before"], words, 2)), F.reverse(F.regexp_extract(x["before"], words, 1)), F.regexp_extract(x["after"], r"^\s*+(\S++)", 1))
    return _let(_let(beside, whole), parts)


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: the base spans of each kind, and ``seen``: base spans and candidates with contexts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumns({"text_key": F.xxhash64("text"), "size": F.length("text")})
    rows = rows.withColumn("some", F.col("text").rlike("[0-9@]"))
    none = F.array().cast(_SPAN)
    for kind in KINDS:
        rows = rows.withColumn(kind, F.when(F.col("some"), base_spans(F.col("text"), kind)).otherwise(none))
    rows = rows.withColumn("words", F.when(F.col("some"), find_all(F.col("text"), CANDIDATE)).otherwise(none))
    grouped = F.when(F.col("text").rlike(r"[0-9).-] [(]?[0-9]"), find_all(F.col("text"), GROUPS)).otherwise(none)
    rows = rows.withColumn("groups", grouped).withColumn("words", F.concat("words", "groups"))
    taken = F.concat(*KINDS)
    rows = rows.withColumn("taken", taken)
    rows = rows.withColumn("free", F.filter("words", lambda w: ~F.exists("taken", lambda t: (t["start"] < w["end"]) & (w["start"] < t["end"]))))
    # Marks around a candidate are not part of it.
    lead = lambda w: F.length(F.regexp_extract(w["value"], r"^[^\p{L}\p{N}+]*", 0))
    core = lambda w: F.regexp_replace(w["value"], r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")
    rows = rows.withColumn("free", F.transform("free", lambda w: F.struct((w["start"] + lead(w)).alias("start"), (w["start"] + lead(w) + F.length(core(w))).alias("end"), core(w).alias("value"))))

    def seen(kind: str | None, source: str) -> Column:
        def one(w: Column) -> Column:
            said = lambda far, near, after: F.struct(F.lit(kind).cast("string").alias("kind"), w["start"].alias("start"), w["end"].alias("end"), w["value"].alias("value"), far.alias("far"), near.alias("near"), after.alias("after"))
            return _in_context(F.col("text"), F.col("size"), w, said)

        return F.transform(source, one)

    every = F.concat(*[seen(k, k) for k in KINDS], seen(None, "free"))
    return rows.select("doc_id", "text_key", *KINDS, every.alias("seen"))


def bootstrap(seen: DataFrame, min_support: int = MIN_SUPPORT, min_pattern: float = MIN_PATTERN, min_value: float = MIN_VALUE, min_digits: int = MIN_DIGITS) -> DataFrame:
    """``(value, kind)`` of the unseen identifiers that the graph finds.

    ``seen(kind, value, far, near, after)`` lists mentions; kind is null where it is not known. Two patterns come
    from a mention: the two words before it, and the word before and the word after; from one that begins its text,
    the word after. A pattern's confidence for a
    kind is the mean score of its distinct values, unknown ones counting 0, if at least ``min_support`` of them
    are known; a value's score is 1 - prod(1 - confidence) over its patterns of at least ``min_pattern``. Values
    of at least ``min_value`` with ``min_digits`` digits, for e-mail with an at sign inside, are found (ties: the first kind in order) and are known
    in the next round. Patterns of fewer than ``min_support`` + 1 distinct values say nothing about others and
    are left out. Rounds go on until one finds no value. Both scores are sums combined before the shuffle, however many mentions a pattern has.
    """
    sides = F.array(F.concat_ws(" ", F.lit("<<"), "far", "near"), F.concat_ws(" ", F.lit("<>"), "near", F.lit("_"), "after"))
    begins = (F.col("near") == "") & (F.col("after") != "")
    sides = F.when(begins, F.array(F.concat_ws(" ", F.lit(">>"), "after"))).otherwise(sides)
    whole = begins | ((F.col("near") != "") & ((F.col("far") != "") | (F.col("after") != "")))
    edges = seen.where(whole & (F.col("value") != "")).select(F.explode(sides).alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    edges = cut(edges, "graph")
    rich = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") > min_support)
    edges = cut(edges.join(rich, "pattern"), "graph")
    known = edges.where("kind is not null").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    known = cut(known, "known")
    # The shape that an unseen value of a kind must have.
    like = lambda kind: F.when(kind == "email", F.col("value").rlike(r"[^\s@]@[^\s@]")).otherwise(F.length(_digits(F.col("value"))) >= min_digits)
    found = None
    while True:
        scores = edges.drop("kind").join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("support"), F.max("n").alias("n")).where(F.col("support") >= min_support)
        good = scores.withColumn("c", F.least(F.col("s") / F.col("n"), F.lit(0.999))).where(F.col("c") >= min_pattern).select("pattern", F.col("kind").alias("of"), "c")
        open_ = edges.join(known.select("value"), "value", "left_anti").where(like(F.lit("email")) | like(F.lit("")))
        values = open_.join(good, "pattern").where(like(F.col("of"))).groupBy("value", "of").agg((1 - F.exp(F.sum(F.log(1 - F.col("c"))))).alias("score"))
        rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("of"))
        best = values.groupBy("value").agg(F.max_by(F.struct("of", "score"), F.struct("score", -rank)).alias("b")).select("value", F.col("b.of").alias("kind"), F.col("b.score").alias("score"))
        new = cut(best.where(F.col("score") >= min_value), "found")
        if not new.take(1):
            break
        found = new if found is None else found.union(new)
        known = cut(known.union(new), "known")
    return (found if found is not None else known.limit(0)).select("value", "kind")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, email, ip, card, phone, added)``: arrays of spans (start, end, value) a row per row.

    The base kinds hold base spans only; ``added`` holds (kind, start, end, value) of the identifiers that the
    bootstrap found. Null is the empty text. A corpus without base spans adds nothing.
    """
    rows = cut(mentions(docs, id_col, text_col), "mentions")
    seen = rows.select("doc_id", "text_key", F.explode("seen").alias("m")).select("doc_id", "text_key", "m.*")
    found = bootstrap(seen)
    hits = seen.where("kind is null").drop("kind").join(found, "value").select("doc_id", "text_key", F.struct("kind", "start", "end", "value").alias("x")).distinct()
    added = hits.groupBy("doc_id", "text_key").agg(F.collect_list("x").alias("added"))
    # A word inside a found run of groups is part of it. Runs do not overlap each other, nor do words.
    runs = F.filter("added", lambda x: F.instr(x["value"], " ") > 0)
    inside = lambda x: (F.instr(x["value"], " ") == 0) & F.exists("runs", lambda r: (r["start"] <= x["start"]) & (x["end"] <= r["end"]))
    added = added.withColumn("runs", runs).select("doc_id", "text_key", F.filter("added", lambda x: ~inside(x)).alias("added")).alias("a")
    rows = rows.drop("seen").alias("r").join(added, F.col("r.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("r.text_key") == F.col("a.text_key")), "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return rows.select("r.doc_id", "r.text_key", *KINDS, F.coalesce("added", none).alias("added"))


def span_digest(*named: tuple[str, Column]) -> Column:
    """``kind:start:end`` of spans, by kind as given, then start, comma-joined."""
    text = lambda k: lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string"))
    parts = [F.transform(F.array_sort(spans), text(k)) for k, spans in named]
    return F.concat_ws(",", F.concat(*parts))
