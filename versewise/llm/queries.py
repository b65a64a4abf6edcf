"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
#: Fixed values of the SQL: the proximity parameters of the decontamination query.
SLACK, SHARE = 2, 0.75


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versewise.llm.license_scan import scan_licenses

    rows = scan_licenses(_read(spark, sf_dir, "documents"))
    best = F.get("matches", F.lit(0))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return rows.select("doc_id", F.size("matches").alias("n_matches"), F.concat_ws(",", names).alias("licenses"), best["license"].alias("best_license"), best["dice"].alias("best_dice"), best["line"].alias("best_line"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versewise.llm import language_id as li

    docs = _read(spark, sf_dir, "documents")
    model = li.fit_languages(docs.where(~li.held_out()))
    found = li.predict_languages(docs, model, min_margin=li.MIN_MARGIN)
    return found.select("doc_id", li.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versewise.llm.mixing import mix_sources

    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_token_store(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from versewise.llm.token_store import read_token_store, write_token_store

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    return read_token_store(spark, write_token_store(_read(spark, sf_dir, "documents"), tokenizer_path, end_id=1))


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versewise.llm.warc_bundle import read_bundles, write_bundles

    folder = write_bundles(_read(spark, sf_dir, "pages"))
    return read_bundles(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versewise.llm.pii import KINDS, find_personal_data, span_digest

    rows = find_personal_data(_read(spark, sf_dir, "documents"))
    added = {k: F.transform(F.filter("added", _is_kind(k)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))) for k in KINDS}
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    base = span_digest(*[(k, F.col(k)) for k in KINDS])
    every = span_digest(*[(k, F.concat(F.col(k), added[k])) for k in KINDS])
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def _is_kind(kind: str):
    return lambda x: x["kind"] == kind


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versewise.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_read(spark, sf_dir, "documents"), threshold=0.8, n=5).select("doc_id", "class_id", "n_links", "n_copies")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versewise.llm.decontaminate import decontaminate

    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), width=10).drop("text_key")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versewise.llm.order_minhash import as_hex, edited_neighbours, likeness

    rows = edited_neighbours(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versewise.llm.line_dedup import dedup_lines

    rows = dedup_lines(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), "n_exact", "n_near", F.concat_ws(",", F.transform("dropped", lambda x: x.cast("string"))).alias("dropped"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versewise.llm.suffix_dedup import dedup_repeats, kept_bytes

    rows = dedup_repeats(_read(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(kept_bytes(text, F.col("spans")), 256).alias("kept_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versewise.llm.whitening import whiten

    return whiten(_read(spark, sf_dir, "embeddings")).drop("deviation_exact")


def op13_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versewise.llm.pivot_clusters import pivot_clusters

    rows = pivot_clusters(_read(spark, sf_dir, "embeddings"))
    named = F.sha2(F.concat_ws(",", F.transform("centroid", lambda v: v.cast("string"))), 256)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", named.alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_language_id, op3_source_mix, op4_personal_data, op5_ngram_join, op6_order_minhash, op7_token_store, op8_line_dedup, op9_warc_bundles, op10_decontaminate, op11_suffix_dedup, op12_embedding_whitening, op13_pivot_clusters)}


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Every distance of every round, as SQL."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    steps = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT vec_id, any_value(v.x) AS x, min({square} * {k} + c) AS best FROM v, c{r} AS c GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT c, i, (s - ((s % n) + n) % n) // n AS m FROM (SELECT best % {k} AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS d(i) GROUP BY ALL))")
            steps.append(f"c{r + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} AS c LEFT JOIN (SELECT c, list(CAST(m AS BIGINT) ORDER BY i) AS x FROM m{r} GROUP BY c) AS m ON m.c = c.c)")
    last = f"SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, CAST(best // {k} AS BIGINT) AS distance FROM a{rounds}"
    return f"WITH {', '.join(steps)}, o AS ({last}) SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM o JOIN c{rounds} AS c ON c.c = o.cluster"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL: dict[str, str] = {
    "op10_decontaminate": f"""WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS ww FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT len(ww) AS n FROM win),
    dwin AS (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS ww FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)),
    occ AS (SELECT doc_id, p, n, item_id FROM dwin JOIN win USING (ww)),
    hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY 1),
    its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY 1),
    wt AS (SELECT DISTINCT ww, o, greatest(1, len(ww) - 1) AS size, CASE WHEN len(ww) = 1 THEN ww[1] ELSE ww[o + 1] || ' ' || ww[o + 2] END AS term FROM (SELECT ww, unnest(range(0, greatest(1, len(ww) - 1))) AS o FROM (SELECT DISTINCT ww FROM win))),
    post AS (SELECT doc_id, p - 1 AS pos, term FROM (SELECT doc_id, p, unnest(CASE WHEN p < len(w) THEN [w[p], w[p] || ' ' || w[p + 1]] ELSE [w[p]] END) AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw)) WHERE term IN (SELECT term FROM wt)),
    rk AS (SELECT wt.*, n, row_number() OVER (PARTITION BY ww ORDER BY coalesce(n, 0), o) AS r FROM wt LEFT JOIN (SELECT term, count(*) AS n FROM post GROUP BY 1) USING (term)),
    st AS (SELECT DISTINCT doc_id, ww, pos - o AS s FROM post JOIN rk USING (term) WHERE r <= size - ceil({SHARE} * size) + 1),
    near AS (SELECT st.doc_id, st.ww, s FROM st JOIN wt USING (ww) JOIN post ON post.doc_id = st.doc_id AND post.term = wt.term AND abs(pos - s - o) <= {SLACK} GROUP BY st.doc_id, st.ww, s, size HAVING count(DISTINCT o) >= {SHARE} * size),
    nit AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM near JOIN win USING (ww) GROUP BY 1)
    SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nit USING (doc_id)""",
    "op9_warc_bundles": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), g AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY sha1(b)) AS top FROM p),
    bits AS (SELECT DISTINCT h, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', h[i]) - 1), 4, '0')), '') AS bits FROM g),
    digest AS (SELECT h, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT)]), '') AS d FROM bits)
    SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM g JOIN digest USING (h)""",
    "op5_ngram_join": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) AS g FROM d WHERE len(w) > 0),
    s AS (SELECT min(doc_id) AS rep, g, count(*) AS copies FROM g GROUP BY g), e AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM s),
    p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
    q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), reach(a, b) AS (SELECT rep, rep FROM s UNION SELECT reach.a, q.b FROM reach JOIN q ON reach.b = q.a),
    c AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY 1), l AS (SELECT a AS rep, sum(copies) AS links FROM q JOIN s ON s.rep = q.b GROUP BY 1)
    SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(copies - 1, 0) + coalesce(links, 0) AS BIGINT) AS n_links, coalesce(copies - 1, 0) AS n_copies
    FROM d LEFT JOIN g USING (doc_id) LEFT JOIN s ON g.g = s.g LEFT JOIN c ON c.rep = s.rep LEFT JOIN l ON l.rep = s.rep""",
    "op11_suffix_dedup": """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    w AS (SELECT doc_id, i, md5(b[i + 1 : i + 400]) AS h FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 399)) AS i FROM t WHERE octet_length(b) >= 400)),
    r AS (SELECT w.doc_id, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
    o AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM r)),
    s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM o GROUP BY doc_id, run),
    f AS (SELECT doc_id, z AS j FROM s UNION ALL SELECT doc_id, 0 FROM t),
    p AS (SELECT f.doc_id, f.j, (SELECT min(a) FROM s WHERE s.doc_id = f.doc_id AND s.a >= f.j) AS till FROM f),
    k AS (SELECT doc_id, unhex(string_agg(hex(b[j + 1 : coalesce(till, octet_length(b))]), '' ORDER BY j)) AS kept FROM p JOIN t USING (doc_id) GROUP BY doc_id),
    n AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
    SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(kept) AS kept_sha256 FROM t JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op13_pivot_clusters": _clusters_sql(),
}
