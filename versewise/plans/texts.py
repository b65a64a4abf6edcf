"""Text, matching and export operators over documents, benchmark, conversations, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.functions import numbers, text as tx
from versewise.operators import match, schedule
from versewise.plans.registry import LINES, events, lines, query, table

_VOC = tx.VOCABLES
_W = "[A-Za-z]+(?:['’][A-Za-z]+)*"


@query(f"WITH {LINES} SELECT doc_id, line_no, regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ([,.;:!?])', '\\1', 'g') AS clean FROM ln")
def line_normalise(spark, d):
    return lines(spark, d).select("doc_id", "line_no", tx.tighten(tx.collapse(F.col("line"))).alias("clean"))


_PIECE = "''?[0-9]+(?:[,:][0-9]+)*|[A-Za-z]+(?:[''’][A-Za-z]+)*|."


@query(f"""WITH {LINES}, p AS (SELECT doc_id, line_no, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM (SELECT doc_id, line_no, regexp_extract_all(strip_accents(line), '{_PIECE}') AS w FROM ln)),
    n AS (SELECT *, coalesce(lag(w) OVER o, '') AS before, coalesce(lead(w) OVER o, '') AS a1, coalesce(lead(w, 2) OVER o, '') AS a2, coalesce(lead(w, 3) OVER o, '') AS a3, regexp_matches(w, '[0-9]') AS num FROM p WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY i)),
    t AS (SELECT *, num AND regexp_matches(a1, '^(st|nd|rd|th|s)$') AND NOT regexp_matches(a2, '^[0-9]') AND NOT (a2 IN ('.', ',', ':') AND regexp_matches(a3, '^[0-9]')) AS ordinal, num AND NOT regexp_matches(a1, '^[A-Za-z0-9]') AND NOT (a1 IN ('.', ',', ':') AND regexp_matches(a2, '^[0-9]')) AS bare FROM n),
    v AS (SELECT *, num AND (ordinal OR bare) AND (w[1] = chr(39) OR NOT regexp_matches(before, '[A-Za-z0-9.,:]$')) AS token, CASE WHEN w[1] = chr(39) AND regexp_matches(before, '[A-Za-z0-9.,:]$') THEN w[2:] ELSE w END AS x FROM t),
    f AS (SELECT doc_id, line_no, i, CASE WHEN token AND ordinal THEN x || a1 WHEN token THEN x ELSE w END AS word FROM (SELECT *, coalesce(lag(token AND ordinal) OVER (PARTITION BY doc_id, line_no ORDER BY i), false) AS used FROM v) WHERE token OR (NOT used AND regexp_matches(w, '^[A-Za-z]')))
    SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) AS k, lower(word) AS word FROM f""")
def word_tokens(spark, d):
    """Words and numeric tokens of every line."""
    rows = lines(spark, d).select("doc_id", "line_no", F.posexplode(tx.words_of(F.col("line"))).alias("i", "w"))
    return rows.select("doc_id", "line_no", (F.col("i") + 1).cast("bigint").alias("k"), F.lower(tx.fold_latin(F.col("w"))).alias("word"))


@query(f"""WITH {LINES}, p AS (SELECT doc_id, line_no, w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT doc_id, line_no, string_split(line, ' ') AS w FROM ln))
    SELECT doc_id, line_no, CAST(k AS BIGINT) AS k, w[k] AS phrase FROM p WHERE len(regexp_extract_all(w[k], '[A-Za-z]+')) > 0 AND len(list_filter(regexp_extract_all(w[k], '[A-Za-z]+'), lambda x: NOT regexp_full_match(lower(x), '{_VOC}'))) = 0""")
def nonlexical_lines(spark, d):
    """Phrases without blanks that are vocables alone."""
    rows = lines(spark, d).select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("i", "phrase"))
    return rows.where(tx.is_vocable(F.col("phrase"))).select("doc_id", "line_no", (F.col("i") + 1).cast("bigint").alias("k"), "phrase")


@query(f"WITH {LINES} SELECT doc_id, line_no, CASE WHEN NOT regexp_matches(line, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{P}}\\s]') THEN lower(regexp_replace(line, '[\\p{{P}}\\s]', '', 'g')) END AS canonical FROM ln")
def canonical_text(spark, d):
    return lines(spark, d).select("doc_id", "line_no", tx.canonical(F.col("line")).alias("canonical"))


@query(f"WITH {LINES}, u AS (SELECT doc_id, line_no, CAST(length(line) + length(regexp_replace(line, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS BIGINT) AS size FROM ln) SELECT doc_id, line_no, size, CAST(coalesce(sum(size + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_utf16 FROM u")
def utf16_offsets(spark, d):
    rows = lines(spark, d).select("doc_id", "line_no", tx.utf16_length(F.col("line")).cast("bigint").alias("size"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start_utf16", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)))


@query(f"WITH {LINES}, n AS (SELECT doc_id, line_no, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i FROM ln), p AS (SELECT *, (n + 3) // 4 AS p FROM n), s AS (SELECT *, n // p AS size, n % p AS extra FROM p) SELECT doc_id, line_no, CASE WHEN i < extra * (size + 1) THEN i // (size + 1) ELSE extra + (i - extra * (size + 1)) // size END AS chunk FROM s")
def balanced_chunks(spark, d):
    return schedule.balanced_chunks(lines(spark, d).select("doc_id", "line_no"), "doc_id", "line_no").select("doc_id", "line_no", "chunk")


@query(f"""WITH {LINES}, w AS (SELECT doc_id, line_no, k, CAST(length(w[k]) AS BIGINT) AS size FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM (SELECT doc_id, line_no, regexp_extract_all(line, '[^ ]+') AS w FROM ln)))
    SELECT doc_id, line_no, CAST(k AS BIGINT) AS k, round(1000.0 * (sum(size) OVER (PARTITION BY doc_id, line_no ORDER BY k ROWS UNBOUNDED PRECEDING) - size) / sum(size) OVER (PARTITION BY doc_id, line_no), 4) AS split_begin FROM w""")
def even_split(spark, d):
    w = lines(spark, d).select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit("[^ ]+"), F.lit(0))).alias("i", "w"))
    w = w.select("doc_id", "line_no", (F.col("i") + 1).cast("bigint").alias("k"), F.length("w").cast("bigint").alias("size"))
    return schedule.even_split(w, ["doc_id", "line_no"], "k", "size", F.lit(0.0), F.lit(1000.0)).select("doc_id", "line_no", "k", F.round("split_begin", 4).alias("split_begin"))


_O, _T = [repr(w) for w in numbers.ONES], [repr(w) for w in numbers.TENS]
_TWO = lambda n: f"CASE WHEN {n} < 20 THEN ones[{n} + 1] WHEN {n} % 10 = 0 THEN tens[{n} // 10 + 1] ELSE tens[{n} // 10 + 1] || '-' || ones[{n} % 10 + 1] END"
_CARD = f"concat_ws(' ', CASE WHEN n >= 1000 THEN {_TWO('(n // 1000)')} || ' thousand' END, CASE WHEN n % 1000 >= 100 THEN ones[n % 1000 // 100 + 1] || ' hundred' END, CASE WHEN n % 100 > 0 OR n = 0 THEN {_TWO('(n % 100)')} END)"
_YEAR = f"concat_ws(' ', {_TWO('(n // 100)')}, CASE WHEN n % 100 = 0 THEN 'hundred' WHEN n % 100 < 10 THEN 'oh ' || ones[n % 100 + 1] ELSE {_TWO('(n % 100)')} END)"


@query(f"""WITH l AS (SELECT [{', '.join(_O)}] AS ones, [{', '.join(_T)}] AS tens), k AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS n, 'part' AS kind FROM part UNION ALL SELECT o_orderkey, o_orderkey % 10000, 'order' FROM orders)
    SELECT id, kind, CAST(n AS VARCHAR) AS token, CASE WHEN n BETWEEN 1100 AND 2099 AND NOT n BETWEEN 2000 AND 2009 THEN {_YEAR} ELSE {_CARD} END AS words FROM k, l""")
def spoken_numbers(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("token"), F.lit("part").alias("kind"))
    rows = rows.union(table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 10000).cast("string"), F.lit("order")))
    return rows.select("id", "kind", "token", numbers.spoken(F.col("token")).alias("words"))


@query(f"WITH {LINES} SELECT doc_id, line_no, count(*) OVER (PARTITION BY doc_id, line) > 1 AS repeated FROM ln")
def repeated_lines(spark, d):
    return lines(spark, d).select("doc_id", "line_no", (F.count("*").over(Window.partitionBy("doc_id", "line")) > 1).alias("repeated"))


# The SQL's distance counts bytes: letters beyond ASCII are named by capitals first, which lower-cased texts don't have.
_BARE = "translate(lower(regexp_replace({}, '[\\s!-/:-@\\[-`{{-~]', '', 'g')), 'ßäöüàáâçèéêëìíîïñòóôùúûœæ', 'ABCDEFGHIJKLMNOPQRSTUVWXY')"


@query(f"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prior FROM conversations),
    k AS (SELECT conv_id, turn, {_BARE.format('text')} AS a, {_BARE.format('prior')} AS b FROM c WHERE prior IS NOT NULL)
    SELECT conv_id, turn, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 0 ELSE levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS disagreement FROM k""")
def levenshtein_disagreement(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\s!-/:-@\[-`{-~]", ""))
    rows = table(spark, d, "conversations").withColumn("prior", F.lag("text").over(w)).where("prior is not null").select("conv_id", "turn", bare("text").alias("a"), bare("prior").alias("b"))
    return rows.select("conv_id", "turn", F.round(tx.disagreement(F.col("a"), F.col("b")), 6).alias("disagreement"))


@query(f"""WITH {LINES}, c AS (SELECT lang, ln.doc_id, line_no, line, row_number() OVER (PARTITION BY lang, ln.doc_id % 2, line ORDER BY ln.doc_id * 10000 + line_no) AS nth FROM ln JOIN documents USING (doc_id))
    SELECT a.lang, a.doc_id * 10000 + a.line_no AS l, b.doc_id * 10000 + b.line_no AS r, a.nth FROM c a JOIN c b ON a.lang = b.lang AND a.line = b.line AND a.nth = b.nth AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1""")
def ordered_text_match(spark, d):
    """The n-th time that a line stands in documents of even and of odd number, by language."""
    rows = lines(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("at", F.col("doc_id") * 10000 + F.col("line_no"))
    return match.ordered_text_match(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "lang", "at", "line").select("lang", "l", "r", F.col("nth").cast("bigint").alias("nth"))


def _bench_lines(spark, d):
    """Sentences of the benchmark items as lines of words, each under its item and number."""
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "[.\n]")).alias("i", "line"))
    return rows.select(F.concat_ws(":", "item_id", "i").alias("line_id"), F.transform(F.regexp_extract_all("line", F.lit(r"[\p{L}]+"), F.lit(0)), F.lower).alias("words")).where(F.size("words") > 0)


#: Bytes of texts of a part whose pairs of words are counted in one task, about.
PART_BYTES = 4 << 20


def _doc_runs(spark, d):
    """Documents as runs of words; they lie by a hash of their number, so that what is counted for each needs no shuffle.

    There are as many parts as the texts' bytes need, so that what a task holds does not grow with the table.
    """
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("stream"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = texts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)), "stream")
    return texts.select("stream", F.lit(0).alias("first"), F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)).alias("run"))


@query()
def line_candidates(spark, d):
    return _candidates(spark, d)


def _candidates(spark, d):
    return match.candidates_in(_bench_lines(spark, d), _doc_runs(spark, d))


@query()
def fuzzy_containment(spark, d):
    return _candidates(spark, d).select("line_id").distinct()


def _scored(spark, d):
    """Candidates of passages from events: occurrences are days, stretches the events' intervals."""
    from versewise.plans.registry import intervals

    day = F.expr("begin div 86400000000")
    rows = intervals(events(spark, d)).select("user_id", F.dense_rank().over(Window.partitionBy("user_id").orderBy(day)).cast("bigint").alias("occurrence"), F.col("event_id").alias("id"), "begin", "end")
    return rows.withColumn("score", F.round((F.col("end") - F.col("begin")) / 6e9, 6))


@query("""WITH ev AS (SELECT event_id, user_id, epoch_us(ts) AS t, value FROM events), iv AS (SELECT user_id, event_id AS id, t AS b, t + CAST(floor(value * 60000000) AS BIGINT) AS e FROM ev WHERE floor(value * 60000000) > 0),
    s AS (SELECT *, b // 86400000000 AS day, row_number() OVER (PARTITION BY user_id, b // 86400000000 ORDER BY round((e - b) / 6e9, 6) DESC, id) AS k FROM iv),
    RECURSIVE_GUARD AS (SELECT 1) SELECT a.user_id, a.id, (SELECT o.id FROM s o WHERE o.user_id = a.user_id AND o.day = a.day AND o.k < a.k AND abs(o.b - a.b) <= 60000000000 AND abs(o.e - a.e) <= 60000000000 ORDER BY o.k LIMIT 1) AS near_better FROM s a""".replace("RECURSIVE_GUARD AS (SELECT 1) ", "").replace("iv),\n", "iv),\n").replace("FROM iv),\n     SELECT a.user_id", "FROM iv)\n     SELECT a.user_id"))
def near_better_candidate(spark, d):
    """Each candidate's best near neighbour of a higher rank (the pairwise part of near-duplicate suppression)."""
    s = _scored(spark, d)
    s = s.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "occurrence").orderBy(F.col("score").desc(), "id")))
    o = s.select("user_id", "occurrence", F.col("id").alias("oid"), F.col("begin").alias("ob"), F.col("end").alias("oe"), F.col("k").alias("ok"))
    near = (F.col("ok") < F.col("k")) & (F.abs(F.col("ob") - F.col("begin")) <= 60000000000) & (F.abs(F.col("oe") - F.col("end")) <= 60000000000)
    best = s.join(o, ["user_id", "occurrence"]).where(near).groupBy("user_id", "id").agg(F.min_by("oid", "ok").alias("near_better"))
    return s.select("user_id", "id").join(best, ["user_id", "id"], "left")


@query()
def near_duplicate_suppression(spark, d):
    return match.suppress_near_duplicates(_scored(spark, d), ["user_id", "occurrence"], "id", "score", "begin", "end", 60_000_000_000).select("user_id", "occurrence", "id", "duplicate_of")


@query()
def best_path(spark, d):
    rows = _scored(spark, d).withColumn("utility", F.col("score"))
    return match.chronological_path(rows, "user_id", 0.05)


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type, value FROM events)
    SELECT user_id, '<tt><body><div>' || string_agg('<p begin="' || rtrim(rtrim(printf('%d.%06d', t // 1000000 - 1704067200, t % 1000000), '0'), '.') || 's">' || replace(replace(event_type || ' & <' || CAST(event_id AS VARCHAR) || '>', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') || '</p>', '' ORDER BY t, event_id) || '</div></body></tt>' AS ttml FROM e GROUP BY 1""")
def ttml_export(spark, d):
    from versewise.sources.sinks import ttml_documents

    rows = events(spark, d).select(F.col("user_id").alias("recording_id"), F.struct("t", "event_id").alias("line_id"), (F.col("t") - 1704067200000000).alias("begin_us"), F.lit(None).cast("bigint").alias("end_us"), F.concat("event_type", F.lit(" & <"), F.col("event_id").cast("string"), F.lit(">")).alias("text"))
    return ttml_documents(rows).select(F.col("recording_id").alias("user_id"), "ttml")


@query("""SELECT doc_id, '[' || string_agg('{"line":' || CAST(i AS VARCHAR) || ',"size":' || CAST(length(s[i]) AS VARCHAR) || '}', ',' ORDER BY i) || ']' AS report FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) GROUP BY 1""")
def json_report(spark, d):
    from versewise.sources.sinks import report_rows

    rows = lines(spark, d).select(F.col("doc_id").alias("recording_id"), F.col("line_no").alias("line"), F.length("line").alias("size"))
    return report_rows(rows, ["line", "size"]).select(F.col("recording_id").alias("doc_id"), F.to_json("lines").alias("report"))
