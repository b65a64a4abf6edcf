"""Data-quality rules: each gives rows ``(recording_id, row, rule_id, detail)`` instead of stopping a job."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import accumulate, groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.operators.intervals import complement, merge_intervals


def violations(rows: DataFrame, key: str, row: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks; a rule is a condition that is true where it is broken."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select(F.col(key).alias("recording_id"), F.col(row).cast("string").alias("row"), F.explode(broken).alias("rule_id"))


def timed_line_violations(lines: DataFrame, key: str, row: str, begin: str, end: str, duration: str) -> DataFrame:
    """Order, overlap, bounds and emptiness of timed lines (M1, M3)."""
    w = Window.partitionBy(key).orderBy(row)
    upto = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumns({"_last": F.lag(begin).over(w), "_upto": upto})
    return violations(rows, key, row, {
        "empty_interval": F.col(begin) >= F.col(end), "out_of_bounds": (F.col(begin) < 0) | (F.col(end) > F.col(duration)),
        "not_monotonic": F.col(begin) < F.col("_last"), "overlap": F.col(begin) < F.col("_upto"),
    })


def segment_violations(lines: DataFrame, key: str, row: str, begin: str, end: str, segments: str) -> DataFrame:
    """Segments inside their line, in order."""
    s = F.col(segments)
    late = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(s) - 1)), lambda i: F.get(s, i)["begin_us"] < F.get(s, i - 1)["end_us"])
    return violations(lines, key, row, {
        "segment_outside": F.exists(s, lambda x: (x["begin_us"] < F.col(begin)) | (x["end_us"] > F.col(end))),
        "segment_order": (F.size(s) > 1) & late, "segment_empty": F.exists(s, lambda x: x["begin_us"] >= x["end_us"]),
    })


def changed_rows(stored: DataFrame, computed: DataFrame, key: str, row: str, values: Sequence[str]) -> DataFrame:
    """Stored rows that a fresh computation does not give (M2), and rows on one side only."""
    a, b = stored.select(key, row, F.struct(*values).alias("_a")), computed.select(key, row, F.struct(*values).alias("_b"))
    rows = a.join(b, [key, row], "full")
    return violations(rows, key, row, {"missing_in_source": F.col("_b").isNull(), "missing_in_stored": F.col("_a").isNull(), "mapping_changed": F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))})


def reviewed_without_history(rows: DataFrame, events: DataFrame, key: str, row: str, state: str) -> DataFrame:
    """Rows in a reviewed state that no review event explains (M4)."""
    bare = rows.where(F.col(state) != "unreviewed").join(events.select(key, row, F.col("action").alias(state)), [key, row, state], "left_anti")
    return bare.select(F.col(key).alias("recording_id"), F.col(row).cast("string").alias("row"), F.lit("review_without_history").alias("rule_id"))


def observation_violations(rows: DataFrame) -> DataFrame:
    """Ticks in order and inside their window, ids unique, text without control characters (M5)."""
    n = F.count("*").over(Window.partitionBy("recording_id", "obs_id"))
    return violations(rows.withColumn("_n", n), "recording_id", "obs_id", {
        "duplicate_id": F.col("_n") > 1, "invalid_ticks": (F.col("begin_tick") < 0) | (F.col("begin_tick") >= F.col("end_tick")),
        "outside_window": (F.col("begin_tick") < F.col("window_begin")) | (F.col("end_tick") > F.col("window_end")),
        "control_character": F.col("text").rlike(r"\p{Cc}"), "empty_text": F.trim("text") == "",
    })


def override_violations(rows: DataFrame) -> DataFrame:
    """Pronunciation ranges in order and apart, their text the source's slice (M6)."""
    from versewise.functions.text import utf16_slice

    w = Window.partitionBy("recording_id", "paragraph").orderBy("start_utf16")
    stop = F.col("start_utf16") + F.col("length_utf16")
    rows = rows.withColumns({"_upto": F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_slice": utf16_slice(F.col("source"), F.col("start_utf16"), F.col("length_utf16"))})
    return violations(rows, "recording_id", "start_utf16", {"override_overlap": F.col("start_utf16") < F.col("_upto"), "override_empty": F.col("length_utf16") <= 0, "wrong_slice": ~F.col("_slice").eqNullSafe(F.col("text"))})


def annotation_violations(rows: DataFrame) -> DataFrame:
    """Uncertainty bands in order, inside the recording, classes known (M7)."""
    return violations(rows, "recording_id", "seq", {
        "band_order": (F.col("onset_earliest_us") > F.col("onset_latest_us")) | (F.col("offset_earliest_us") > F.col("offset_latest_us")) | (F.col("onset_latest_us") > F.col("offset_earliest_us")),
        "band_bounds": (F.col("onset_earliest_us") < 0) | (F.col("offset_latest_us") > F.col("duration_us")), "unknown_kind": ~F.col("kind").isin("vocal", "unknown", "instrumental"),
    })


def pass_violations(passes: DataFrame) -> DataFrame:
    """Two passes over one source by different people, of the same audio (M8)."""
    per = passes.groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("annotator").alias("people"), F.count_distinct("audio_sha256").alias("audio"))
    return violations(per, "source_id", "source_id", {"not_two_passes": F.col("n") != 2, "same_annotator": F.col("people") < F.col("n"), "different_audio": F.col("audio") > 1})


# The classes of annotated intervals.
VOCAL = ("lead_singing", "backing_singing", "overlapping_singers", "humming", "sung_ad_lib")
NEGATIVE = ("instrumental", "silence")
UNKNOWN = ("breath", "spoken_interjection", "ambiguous_reverberation", "unresolved")
#: What an initial pass and the reviewed record of one source must share.
IDENTITY = ("source_id", "audio_sha256", "sample_rate_hz", "source_start_sample", "source_end_sample", "language")


def annotation_record_violations(annotations: DataFrame, rows: DataFrame) -> DataFrame:
    """Rules of whole annotation records and of their intervals (M7).

    ``annotations(recording_id, source_id, audio_sha256, annotator, reviewer, language, sample_rate_hz, source_total_samples,
    source_start_sample, source_end_sample, duration_us, resolution_us, review_status, initial_passes)``;
    ``rows(recording_id, seq, kind, onset_earliest_us, onset_latest_us, offset_earliest_us, offset_latest_us, censored_onset,
    censored_offset)``: of other kinds than singing the first and last bound alone count. The excerpt in samples and its length in
    microseconds must agree within one microsecond; envelopes are in order and apart; a censored bound touches the edge.
    """
    rate, size = F.col("sample_rate_hz"), F.col("source_end_sample") - F.col("source_start_sample")
    reviewed = F.col("review_status") == "reviewed"
    whole = violations(annotations.withColumn("row", F.lit("record")), "recording_id", "row", {
        "identity": F.coalesce(F.trim("source_id"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("annotator"), F.lit("")).eqNullSafe(""),
        "audio_digest": ~F.coalesce(F.col("audio_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "language": ~F.coalesce(F.col("language").isin("en", "ja"), F.lit(False)),
        "sample_rate": ~F.coalesce((rate >= 1) & (rate <= 192_000), F.lit(False)),
        "excerpt": ~F.coalesce((F.col("source_start_sample") >= 0) & (size > 0) & (F.col("source_end_sample") <= F.col("source_total_samples")) & (size <= rate * 60), F.lit(False)),
        "duration": F.abs(F.col("duration_us") * rate - size * 1_000_000) > rate,
        "resolution": ~F.coalesce((F.col("resolution_us") >= 1) & (F.col("resolution_us") <= F.col("duration_us")), F.lit(False)),
        "review_status": ~F.coalesce(F.col("review_status").isin("independent_pass", "reviewed"), F.lit(False)),
        "reviewer": reviewed & (F.col("reviewer").isNull() | (F.col("reviewer") == F.col("annotator"))),
        "initial_passes": (reviewed & (F.size(F.array_distinct(F.coalesce("initial_passes", F.array().cast("array<string>")))) != 2)) | ((F.col("review_status") == "independent_pass") & F.col("initial_passes").isNotNull()),
    })
    a, b, c, d = (F.col(x) for x in ("onset_earliest_us", "onset_latest_us", "offset_earliest_us", "offset_latest_us"))
    vocal, known = F.col("kind").isin(*VOCAL), F.col("kind").isin(*VOCAL, *NEGATIVE, *UNKNOWN)
    w = Window.partitionBy("recording_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(annotations.select("recording_id", "duration_us"), "recording_id").withColumn("_upto", F.coalesce(F.last("offset_latest_us").over(w), F.lit(0)))
    each = violations(placed, "recording_id", "seq", {
        "unknown_kind": ~F.coalesce(known, F.lit(False)),
        "band_order": vocal & ~F.coalesce((a <= b) & (b <= c) & (c <= d) & (a < d), F.lit(False)),
        "empty_interval": known & ~vocal & ~F.coalesce(a < d, F.lit(False)),
        "censored_edge": vocal & ((F.col("censored_onset") & (a != 0)) | (F.col("censored_offset") & (d != F.col("duration_us")))),
        "envelope_order": a < F.col("_upto"),
        "outside_excerpt": (a < 0) | (d > F.col("duration_us")),
    })
    return whole.unionByName(each)


def annotation_summary(annotations: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged unknown intervals, counts) of records without violations.

    Unknown is what no interval covers, what is of an unknown class, and the bands of uncertain bounds; a vocal interval whose
    bands touch is unknown whole. Counts: vocal intervals with both bounds clear and uncensored, gaps, instrumental ones.
    """
    a, b, c, d = (F.col(x) for x in ("onset_earliest_us", "onset_latest_us", "offset_earliest_us", "offset_latest_us"))
    vocal = F.col("kind").isin(*VOCAL)
    piece = lambda x, y: F.struct(x.alias("begin"), y.alias("end"))
    unsure = F.when(F.col("kind").isin(*UNKNOWN) | (vocal & (b == c)), F.array(piece(a, d))).when(vocal, F.array(piece(a, b), piece(c, d))).otherwise(F.array().cast("array<struct<begin:bigint,end:bigint>>"))
    bands = rows.select("recording_id", F.explode(unsure).alias("p")).select("recording_id", "p.begin", "p.end").where("begin < end")
    spans = annotations.select("recording_id", F.lit(0).cast("bigint").alias("begin"), F.col("duration_us").alias("end"))
    free = complement(rows.select("recording_id", a.alias("begin"), d.alias("end")), "recording_id", spans)
    unknown = merge_intervals(bands.unionByName(free.select("recording_id", "begin", "end")), "recording_id")
    clear = vocal & (b < c) & ~F.coalesce(F.col("censored_onset") | F.col("censored_offset"), F.lit(False))
    counts = rows.groupBy("recording_id").agg(F.count_if(clear).alias("pairs"), F.count_if(F.col("kind").isin(*NEGATIVE)).alias("gaps"), F.count_if(F.col("kind") == "instrumental").alias("instrumental"))
    return unknown, annotations.select("recording_id").join(counts, "recording_id", "left").fillna(0, ["pairs", "gaps", "instrumental"])


def review_violations(annotations: DataFrame, intervals: DataFrame, disagreements: DataFrame) -> DataFrame:
    """Reviewed records against the two independent passes that they name (M8).

    ``annotations`` as above with ``sha256``, the digest that ``initial_passes`` of a reviewed record lists; ``intervals(recording_id,
    digest)`` names each record's intervals; ``disagreements(recording_id)``. Both passes must exist and be independent, by the
    annotator and the reviewer of the record, of one identity with it; passes that differ need a disagreement.
    """
    named = annotations.where("review_status = 'reviewed'").select("recording_id", "annotator", "reviewer", F.struct(*IDENTITY).alias("own"), F.explode("initial_passes").alias("sha256"))
    passes = annotations.where("review_status = 'independent_pass'").join(intervals.withColumnRenamed("recording_id", "_i"), F.col("recording_id") == F.col("_i"), "left").select("sha256", F.col("annotator").alias("by"), F.struct(*IDENTITY).alias("other"), F.coalesce("digest", F.lit("")).alias("digest"))
    met = named.join(passes, "sha256", "left").groupBy("recording_id").agg(F.count("by").alias("n"), F.count_distinct("by").alias("people"), F.every(F.col("by").isin(F.col("annotator"), F.col("reviewer"))).alias("declared"), F.every(F.col("own") == F.col("other")).alias("same"), F.count_distinct("digest").alias("versions"))
    seen = disagreements.select("recording_id").distinct().withColumn("_seen", F.lit(True))
    return violations(met.join(seen, "recording_id", "left").withColumn("row", F.lit("review")), "recording_id", "row", {
        "missing_pass": F.col("n") != 2,
        "not_the_declared_people": (F.col("people") < 2) | ~F.coalesce("declared", F.lit(False)),
        "different_identity": ~F.coalesce("same", F.lit(True)),
        "disagreement_missing": (F.col("versions") > 1) & F.col("_seen").isNull(),
    })


def candidate_violations(rows: DataFrame) -> DataFrame:
    """Candidate ids unique in an occurrence, groups bounded (M9)."""
    per = rows.groupBy("recording_id", "occurrence").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    return violations(per, "recording_id", "occurrence", {"duplicate_candidate": F.col("n") > F.col("ids"), "too_many_candidates": F.col("n") > 64})


_MARK = "ー"
#: Primes and bases of the hashes of letters; together of 124 bits.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_BASES = (1103515245, 1664525, 22695477, 134775813)
#: Where kana begin: letters of runs are kept as bytes from here. Letters that are digested at once.
_KANA, _AT_ONCE = 0x3040, 1 << 18


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)


def _summed(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def _packed(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """Of each stretch between cuts the steps from value to value, in one, two or four bytes as the greatest needs; the first byte says which."""
    steps = np.diff(values, axis=0, prepend=values[:1] * 0)
    begins = cuts[:-1][cuts[:-1] < cuts[1:]]
    steps[begins] = values[begins]
    most, out = np.abs(steps).reshape(len(steps), *values.shape[1:] or (1,)).max(1, initial=0), []
    wide = _summed(most > 127), _summed(most > 32767)
    kinds = {size: steps.astype(f"<i{size}") for size in (1, 2, 4)}
    for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
        size = 1 if wide[0][i] == wide[0][j] else 2 if wide[1][i] == wide[1][j] else 4
        out.append(bytes([size]) + kinds[size][i:j].tobytes())
    return out


def _unpacked(data: list[bytes], columns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The values of all that ``_packed`` gave, one below the other, and where each begins."""
    sizes = np.array([d[0] for d in data])
    cuts = _summed(np.array([len(d) - 1 for d in data]) // sizes)
    steps = np.empty(cuts[-1], np.int64)
    for size in (1, 2, 4):
        own = np.flatnonzero(sizes == size)
        steps[_ranges(cuts[own], cuts[own + 1])] = np.frombuffer(b"".join([data[i][1:] for i in own.tolist()]), f"<i{size}")
    cuts, sums = cuts // columns, np.concatenate([np.zeros((1, columns), np.int64), np.cumsum(steps.reshape(-1, columns), axis=0)])
    return sums[1:] - np.repeat(sums[cuts[:-1]], np.diff(cuts), axis=0), cuts


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each begin up to its end."""
    sizes = _summed(end - begin)
    return np.repeat(begin - sizes[:-1], end - begin) + np.arange(sizes[-1])


def _spelled(letters: list[str]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Of each row how many letters are no marks, their hash, and how many of them stand before each mark."""
    codes, bounds = _codes(letters), _summed([len(t) for t in letters])
    plain = codes != ord(_MARK)
    upto, at = _summed(plain), np.flatnonzero(~plain)
    first = upto[bounds[:-1]]
    n = upto[bounds[1:]] - first
    place, hashes = np.arange(upto[-1]) - np.repeat(first, n), []
    for base, prime in zip(_BASES, _PRIMES):
        powers, k = np.ones(n.max(initial=1), np.int64), 1
        while k < len(powers):
            powers[k : 2 * k] = powers[:k][: len(powers) - k] * pow(base, k, prime) % prime
            k *= 2
        sums = _summed(codes[plain] * powers[place] % prime)
        hashes.append((sums[first + n] - sums[first]) % prime)
    cuts = np.searchsorted(at, bounds)
    gaps = upto[at] - np.repeat(first, np.diff(cuts))
    return n, [r.tobytes() for r in np.stack(hashes, 1).astype(np.uint32)], _packed(gaps, cuts)


def _kana_runs(texts: list[str]) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Of each row the run of kana around each mark, in the script of the letter before it: its number, the runs as
    (start_utf16, length), each once, and their letters."""
    codes = _codes(["\0" + t for t in texts] + ["\0"])
    starts = _summed([len(t) + 1 for t in texts]) + 1
    at = np.flatnonzero(codes == ord(_MARK))
    shared = (codes == ord(_MARK)) | (codes == 0x3099) | (codes == 0x309A)

    def around(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        turns = np.flatnonzero(np.diff(shared | ((codes >= first) & (codes <= last)))) + 1
        i = np.searchsorted(turns, at, "right")
        return turns[i - 1], turns[i]

    katakana = (codes[at - 1] >= 0x30A1) & (codes[at - 1] <= 0x30FA)
    begin, end = (np.where(katakana, k, h) for k, h in zip(around(0x30A1, 0x30FA), around(0x3041, 0x3096)))
    runs, number = np.unique(begin * len(codes) + end, return_inverse=True)
    begin, end = runs // len(codes), runs % len(codes)
    marks, cuts = np.searchsorted(at, starts), np.searchsorted(begin, starts)
    number = number - np.repeat(cuts[:-1], np.diff(marks))
    long, row = _summed(codes > 0xFFFF), np.repeat(starts[:-1], np.diff(cuts))
    spans = np.stack([begin - row + long[begin] - long[row], end - begin], 1)
    sizes = _summed(end - begin)
    kana = (codes[_ranges(begin, end)] - _KANA).astype(np.uint8)
    return _packed(number, marks), _packed(spans, cuts), [kana[i:j].tobytes() for i, j in pairwise(sizes[cuts].tolist())]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, source, unit, paragraph, tie, text, letters) -> the same with numbers, hashes, marks and runs for the texts."""
    names = ["key", "source", "unit", "paragraph", "tie", "n", "hash", "gaps", "number", "spans", "kana"]
    for b in batches:
        texts, letters = b.column(5).to_pylist(), b.column(6).to_pylist()
        part = [s // _AT_ONCE for s in accumulate(len(t) + len(u) for t, u in zip(texts, letters))]
        for _, same in groupby(range(len(part)), part.__getitem__):
            same = list(same)
            i, j = same[0], same[-1] + 1
            (n, *spelled), runs = _spelled(letters[i:j]), _kana_runs(texts[i:j])
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(5)), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (*spelled, *runs))], names)


def _powers(base: int, prime: int, exponents: np.ndarray) -> np.ndarray:
    out = np.ones(len(exponents), np.int64)
    for k in range(int(exponents.max(initial=0)).bit_length()):
        out = np.where(exponents >> k & 1, out * pow(base, 1 << k, prime) % prime, out)
    return out


def _dropped(keys: list, source: list[bool], places: list, n: list[int], hashes: list[bytes], gaps: list[bytes], number: list[bytes], spans: list[bytes], kana: list[bytes]) -> list[tuple]:
    """(key, paragraph, start_utf16, length_utf16, text) of the runs that lost marks, of all rows of some keys in order, units first."""
    source = np.array(source)
    changed = lambda x: np.array([True, *(a != b for a, b in pairwise(x))])
    new = changed(keys)
    key, place = np.cumsum(new) - 1, np.cumsum(new | changed(places)) - 1
    many = int(key[-1]) + 1
    # letters and hashes of each side of a key, row after row
    side = 2 * key + source
    total = _summed(np.array(n))
    first, last = np.searchsorted(side, np.arange(2 * many)), np.searchsorted(side, np.arange(2 * many), "right")
    before = total[:-1] - total[first[side]]
    own, sides = np.frombuffer(b"".join(hashes), np.uint32).reshape(-1, 4).astype(np.int64), [total[last] - total[first]]
    for i, (base, prime) in enumerate(zip(_BASES, _PRIMES)):
        sums = _summed(own[:, i] * _powers(base, prime, before) % prime)
        sides.append((sums[last] - sums[first]) % prime)
    sound = (last > first)[::2] & (last > first)[1::2] & np.logical_and.reduce([x[::2] == x[1::2] for x in sides])
    # marks by key and letters before: no fewer than the units have, the last of them lost
    gap, cuts = _unpacked(gaps)
    row = np.repeat(np.arange(len(keys)), np.diff(cuts))
    gap = key[row] * (int(total[-1]) + 1) + before[row] + gap[:, 0]
    mine = source[row]
    gap, row, kept = gap[mine], row[mine], gap[~mine]
    (want, begin, w), (held, at, g) = (np.unique(x, return_index=True, return_counts=True) for x in (gap, kept))
    i = np.searchsorted(want, held)
    met = i < len(want)
    met[met] = (want[i[met]] == held[met]) & (g[met] <= w[i[met]])
    sound[held[~met] // (int(total[-1]) + 1)] = False
    have = np.zeros(len(want), np.int64)
    have[i[met]] = g[met]
    lost = (np.arange(len(gap)) - np.repeat(begin, w) >= np.repeat(have, w)) & sound[key[row]]
    # their runs, each once in a paragraph
    span, runs = _unpacked(spans, 2)
    run = np.unique((_unpacked(number)[0][:, 0] + runs[row])[lost])
    row = np.searchsorted(runs, run, "right") - 1
    start, size = span[run, 0], span[run, 1]
    letters = (np.frombuffer(b"".join(kana), np.uint8).astype("<u2") + _KANA).astype("<u2").tobytes().decode("utf-16-le")
    stop = np.cumsum(span[:, 1])[run]
    named = np.array([places[r] is not None for r in row.tolist()], bool)
    order = np.lexsort((size, start, place[row]))
    order = order[named[order]]
    found = [(keys[r], places[r], a, m, letters[z - m : z]) for r, a, m, z in zip(*(x[order].tolist() for x in (row, start, size, stop)))]
    row, start, size = row[order], start[order], size[order]
    close = np.flatnonzero((place[row][1:] == place[row][:-1]) & (start[:-1] + size[:-1] > start[1:])) + 1
    again = {i for i in close.tolist() if found[i][2:] == found[i - 1][2:]}
    sound[[key[row[i]] for i in close.tolist() if i not in again]] = False
    return [x for i, (x, good) in enumerate(zip(found, sound[key[row]].tolist())) if good and i not in again]


def _suggested(key: str) -> Callable:
    """Digests sorted by key and place, units first -> ranges; the rows of a key may lie in several batches."""

    def ranges(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        out = _dropped(*(rows.column(i).to_pylist() for i in (0, 1, 3, 5, 6, 7, 8, 9, 10)))
        kinds = rows.column(0).type, rows.column(3).type, pa.int32(), pa.int32(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], [key, "paragraph", "start_utf16", "length_utf16", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            keys = b.column(0).to_pylist()
            begin = next((i for i in range(len(keys), 0, -1) if keys[i - 1] != keys[-1]), 0)
            if begin:
                yield ranges([*held, b.slice(0, begin)])
                held = [b.slice(begin)]
            elif keys:
                if held and last != keys[0]:
                    yield ranges(held)
                    held = []
                held.append(b)
            last = keys[-1] if keys else last
        if held:
            yield ranges(held)

    return run


def long_vowel_suggestions(paragraphs: DataFrame, units: DataFrame, key: str = "recording_id") -> DataFrame:
    """Source ranges to review where recognised units drop long-vowel marks: suggested, never applied.

    ``paragraphs(key, paragraph, text)``, ``units(key, unit, text)``. The units' letters, one after the other, must be those of
    the paragraphs but for marks that are missing; any other difference, or nothing missing, gives no suggestion. In each
    stretch between letters the last marks count as missing. A missing mark grows to the run of kana of its script around
    it. Returns ``(key, paragraph, start_utf16, length_utf16, text)``; a source with ranges that overlap has none. Rows of one place
    stand in the order of their first letters.

    Texts are not shuffled: letters are compared by hashes of 124 bits that add up over a key's rows, and a row takes along the places
    of its marks and, a byte a letter, the runs around them.
    """
    kinds = dict(paragraphs.dtypes)
    letters = F.coalesce(F.lower(F.regexp_replace("text", r"[\p{P}\s]", "")), F.lit(""))
    unit, paragraph = F.col("unit"), F.col("paragraph")
    side = lambda rows, source, unit, paragraph, text: rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lit(source).alias("source"), unit.alias("unit"), paragraph.alias("paragraph"), F.substring(letters, 1, 16).alias("tie"), text.alias("text"), letters.alias("letters"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = side(units, False, unit, none(kinds["paragraph"]), F.lit("")).unionByName(side(paragraphs, True, none(dict(units.dtypes)["unit"]), paragraph, F.coalesce("text", F.lit(""))))
    digests = rows.mapInArrow(_digests, f"key {kinds[key]}, source boolean, unit {dict(units.dtypes)['unit']}, paragraph {kinds['paragraph']}, tie string, n long, hash binary, gaps binary, number binary, spans binary, kana binary")
    ordered = digests.repartition("key").sortWithinPartitions("key", "source", "unit", "paragraph", "tie", "hash")
    return ordered.mapInArrow(_suggested(key), f"`{key}` {kinds[key]}, paragraph {kinds['paragraph']}, start_utf16 int, length_utf16 int, text string")


def all_violations(*tables: DataFrame) -> DataFrame:
    """The rules' rows together."""
    return reduce(DataFrame.unionByName, tables)
