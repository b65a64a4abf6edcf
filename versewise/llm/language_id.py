"""Language identification by compression with per-language Zstandard raw-content dictionaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.llm.scratch import bound_batches, cut, kept_by_worker, small

#: Labelled rows a language that are looked at for its dictionary, the bytes of that, and of all dictionaries together: the
#: documented bounds of the fit. Many languages share the last.
SAMPLE_DOCS, DICTIONARY_BYTES, MODEL_BYTES = 400, 128 << 10, 64 << 20
#: Rejection threshold of the production queries, as a share of the second-best size.
MIN_MARGIN = 0.002
#: Labelled rows a language (fewer with many languages) that the rejection margins are fitted on, apart from the rows
#: learned from; the lengths (bytes) that they are fitted for; the share of rightly labelled pieces that may fall below.
FIT_DOCS, FIT_ALL, BANDS, QUANTILE = 200, 2000, tuple(16 << k for k in range(10)), 0.005
#: How many times the sample is ranked.
SPARE = 4
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Dictionary bytes of each language, its labelled rows and its least margin by band, by the languages' code points."""

    dictionaries: tuple[tuple[str, bytes], ...]
    counts: tuple[int, ...] = ()
    fast_level: int = 3
    slow_level: int = 9
    margins: tuple[tuple[float, ...], ...] = ()

    def least_margin(self, lang: int, size: int) -> float:
        """The fitted margin of a text of ``size`` bytes: the lower of the two bands beside it.

        What a dictionary saves does not grow beyond the last band, so from there the share falls with the size.
        """
        if not self.margins:
            return 0.0
        k = min(max(size // BANDS[0], 1).bit_length() - 1, len(BANDS) - 1)
        own = self.margins[lang]
        return own[k] * BANDS[-1] / size if size >= BANDS[-1] else min(own[k], own[k + 1])


def letters_only(text: Column) -> Column:
    """Lower-cased words of letters with single spaces: what the dictionaries hold and what is encoded."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def fit_languages(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn every language from a bounded sample: its different texts with letters in the order of their hashes.

    Copies and texts without letters go before the sample is taken, so however many there are, it holds as many texts as the language
    has, up to its bound. Only texts whose hash is low are ranked, a few times as many as are taken, so a language with most texts is
    not gathered. Whole texts fill the dictionary until it holds ``dictionary_bytes`` (fewer if many languages share ``MODEL_BYTES``), at most
    ``sample_docs`` and four fifths of them; what the last has too much is cut off. Of the texts that are not in it ``FIT_DOCS``
    give the rejection margins. The driver sees a row a language, the dictionaries, and a number a language and band.
    Rows with null text or language, and texts without letters, are not used; repeated texts count once. Without any row the
    model is empty.
    """
    known = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("raw"))
    most = sample_docs + FIT_DOCS
    spark = labelled.sparkSession
    worded = F.col("raw").rlike(r"[\p{L}\p{M}]")
    different = cut(known.where(worded).select("lang", "key").distinct(), "different")
    # a row a language
    sizes = cut(different.groupBy("lang").agg(F.count("*").alias("of")).join(known.groupBy("lang").agg(F.count("*").alias("n")), "lang"), "languages")
    counts = {r.lang: r.n for r in sizes.collect()}
    if not counts:
        return LanguageModel(())
    few = F.pmod("key", F.lit(1 << 30)) < F.lit((1 << 30) * SPARE * most) / F.col("of")
    low = different.join(small(sizes), "lang").where(few).select("lang", "key")
    ranked = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("r") <= most)
    chosen = small(cut(ranked, "sample"))
    texts = known.join(chosen, ["lang", "key"]).dropDuplicates(["lang", "key"]).select("lang", "key", letters_only(F.col("raw")).alias("text")).where("text <> ''")
    room = min(dictionary_bytes, MODEL_BYTES // len(counts))
    by_hash = Window.partitionBy("lang").orderBy("key")
    size = F.octet_length("text") + 1
    texts = texts.withColumns({"r": F.row_number().over(by_hash), "before": F.sum(size).over(by_hash) - size, "of": F.count("*").over(Window.partitionBy("lang"))})
    learn = (F.col("r") <= F.least(F.lit(sample_docs), F.ceil(F.col("of") * 0.8))) & (F.col("before") < room)
    texts = cut(texts.withColumn("learn", learn), "texts")
    by_lang: dict[str, list] = {}
    for r in texts.where("learn").select("lang", "r", F.substring("text", 1, room).alias("text")).orderBy("lang", "r").collect():
        by_lang.setdefault(r.lang, []).append(r.text.encode())
    names = sorted(by_lang)
    model = LanguageModel(tuple((lang, b"\n".join(by_lang[lang])[:room]) for lang in names), tuple(counts[lang] for lang in names))
    return replace(model, margins=_fit_margins(spark, model, texts.where("not learn")))


def _pieces(most: int):
    """Rows (lang, parts) -> (lang, band, piece): of each band up to ``most`` pieces, cut from single parts where enough are long enough, else from all in a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, parts in zip(b["lang"].to_pylist(), b["parts"].to_pylist()):
                parts = [p["part"].encode() for p in parts]
                whole, out = b" ".join(parts), []
                for band, size in enumerate(BANDS):
                    own = [p[:size] for p in parts if len(p) >= size]
                    if 2 * len(own) < len(parts):
                        own = [whole[i : i + size] for i in range(0, len(whole) - size + 1, size)]
                    out += [(lang, band, p.decode("utf-8", "ignore")) for p in own[:most]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["lang", "band", "piece"])

    return run


def _fit_margins(spark, model: LanguageModel, apart: DataFrame) -> tuple[tuple[float, ...], ...]:
    """Of each language and band the low quantile of the margins, at the slow level, of its rightly labelled pieces.

    A text gives what follows a place that its hash chooses, as much as the longest band. Pieces are measured as rows of a job.
    """
    names = [lang for lang, _ in model.dictionaries]
    if len(names) < 2:
        return tuple((0.0,) * len(BANDS) for _ in names)
    most = max(10, min(FIT_DOCS, FIT_ALL // len(names)))
    length = F.length("text")
    place = F.pmod(F.col("key"), F.greatest(F.lit(1), length - BANDS[-1] + 1)).cast("int") + 1
    some = apart.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("r"))).where(F.col("i") <= most)
    parts = some.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", F.substring(F.col("text"), place, F.lit(BANDS[-1])).alias("part")))).alias("parts"))
    held = spark.sparkContext.broadcast(model)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure, _, slow = _cached(held)
        for b in batches:
            found = [measure(p.encode(), slow) for p in b["piece"].to_pylist()]
            right = [i for i, (lang, (best, _)) in enumerate(zip(b["lang"].to_pylist(), found)) if names[best] == lang]
            take = pa.array(right, pa.int64())
            yield pa.RecordBatch.from_arrays([b["lang"].take(take), b["band"].take(take), pa.array([found[i][1] for i in right], pa.float64())], ["lang", "band", "margin"])

    pieces = cut(parts.mapInArrow(_pieces(most), "lang string, band long, piece string"), "pieces")
    spread = pieces.repartition(max(2, spark.sparkContext.defaultParallelism), "band", "piece")
    low = spread.mapInArrow(margins, "lang string, band long, margin double").groupBy("lang", "band").agg(F.array_sort(F.collect_list("margin")).alias("m"))
    got = {(r.lang, r.band): r.m for r in low.select("lang", "band", F.get("m", F.floor(F.lit(QUANTILE) * F.size("m")).cast("int")).alias("m")).collect()}
    out = []
    for lang in names:
        own: list[float] = []
        for band in range(len(BANDS)):
            own.append(got.get((lang, band), own[-1] if own else 0.0))
        out.append(tuple(own))
    return tuple(out)


def _cached(held):
    """The encoders of a broadcast model: making them costs far more than a text."""
    return kept_by_worker(held.value, lambda: _coders(held.value))


def _coders(model: LanguageModel):
    """The measure of a text's (language, margin), and the encoders at the fast and at the slow level."""
    import zstandard as z

    def coders(level: int) -> list:
        out = []
        for _, data in model.dictionaries:
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            out.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def measure(data: bytes, by: list) -> tuple[int, float]:
        sizes = [len(c.compress(data)) for c in by]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], -model.counts[i]))
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        return best, 1.0 if rest is None else (rest - sizes[best]) / rest

    return measure, coders(model.fast_level), coders(model.slow_level)


def _measurer(held, sure_margin: float, min_margin: float):
    """A function from a text of letters to (language, margin, rejected), for one Python worker; ``held`` is a broadcast model."""
    model = held.value
    names = [lang for lang, _ in model.dictionaries]
    measure, fast, slow = _cached(held)

    def judge(text: str | None) -> tuple[str, float, bool]:
        if not names or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        data = text.encode("utf-8", "replace")
        best, margin = measure(data, fast)
        if margin < max(sure_margin, 2 * model.least_margin(best, len(data))):
            best, margin = measure(data, slow)
        return names[best], margin, margin <= 0 or margin < max(min_margin, model.least_margin(best, len(data)))

    return judge


def predict_languages(docs: DataFrame, model: LanguageModel, min_margin: float = 0.0, sure_margin: float = 0.03, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` of every whole text, from the text alone.

    The text's letters, lower-cased, are encoded with each language's dictionary and the smallest encoding names
    the language (ties: the one with more labelled rows, then the first by code point). Margins below
    ``sure_margin`` or twice the fitted least are measured again at the slower level. ``score`` is the margin: the share by which the
    smallest encoding is below the second (1 if there is one language only). ``rejected`` when the
    first two are even, or the margin is below ``min_margin`` or below what is usual for the language and the text's length, as fitted. Null, a text without a letter or an empty model: ``und``, score 0, rejected.
    """
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double, rejected boolean"

    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _measurer(held, sure_margin, min_margin)
        for batch in batches:
            langs, scores, rejected = zip(*(judge(t.as_py()) for t in batch.column(1))) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [id_col, "lang_pred", "score", "rejected"])

    bound_batches(docs.sparkSession)
    return docs.select(id_col, letters_only(F.col(text_col)).alias("text")).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, min_margin: float = MIN_MARGIN, sure_margin: float = 0.03, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``predict_languages`` does not reject, with all their columns, in one pass."""
    names = docs.columns

    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _measurer(held, sure_margin, min_margin)
        for batch in batches:
            kept = pa.array([not judge(t.as_py())[2] for t in batch.column(batch.num_columns - 1)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=names).filter(kept)

    bound_batches(docs.sparkSession)
    letters = max(names, key=len) + "_letters"  # longer than any name, so none of them
    return docs.select("*", letters_only(F.col(f"`{text_col}`")).alias(letters)).mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", fold: int = 2, folds: int = 4) -> Column:
    """Whether a row is kept from the fit: crc32 of the id as text, modulo ``folds``. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
