"""Repeated byte strings of all documents by a distributed suffix sort by prefix tripling.

Suffixes are sorted by their first three symbols, those that tie by the ranks of the suffixes three symbols on, and so on;
neighbours in the sorted order are compared. Two things make that fit for large corpora:

* *Anchors.* Sorting starts from places that depend on the text alone: of every ``WINDOW`` consecutive places the one
  whose next ``GRAM`` bytes have the least hash. A string of ``length`` bytes that begins at i has its anchor among
  its first ``WINDOW`` places, and an equal string has it at the same place. The ``WINDOW + GRAM`` bytes after an anchor fix
  where the next one is, so they are its *symbol*: ordered by bytes, sequences of symbols sort as the texts do.
* *Pruning.* A string can occur twice only if the bytes after its anchor that it holds at least do. Anchors for which
  they do not are left out (by counts of hashes; a false alarm costs work, not correctness).

Each range of a sorted table knows the ranges before it only by a row about its ends, so a run of equal keys of any
size may lie over many tasks. Prefixes are compared by pairs of 64-bit hashes, as are texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versewise.llm.scratch import BROADCAST_IDS, bound_batches, dropped, scratch_path, small, written
from versewise.llm.texthash import mix

LENGTH, GRAM, SHORTEST = 400, 16, 64
#: Anchors of a block that are compared in one task; levels of the sort (three symbols, nine), after which ties are ordered by hashes of the prefix.
BLOCK, LEVELS = 1024, 2
#: Bytes that are hashed at a time, and the most that a hash spans; anchors of a batch that goes back to Spark (text that repeats
#: itself at once has an anchor every few bytes).
TILE, SPAN, SLICE = 1 << 18, 1 << 12, 1 << 14
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64((1 << 24) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def window_of(length: int) -> int:
    """Places among which an anchor is chosen: a symbol (window and gram) is no longer than what every string holds."""
    return (length + 1 - GRAM) // 2


def _power(base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers:
        with np.errstate(over="ignore"):
            _powers[base] = tuple(np.concatenate(([np.uint64(1)], np.full(TILE + SPAN, b, np.uint64))).cumprod() for b in (base, pow(base, -1, 1 << 64)))
    return _powers[base]


def _prefix_sums(data: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(base)[0][: len(data)], out=out[1:])
    return out


def string_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end]; starts ascend roughly, no string is longer than ``SPAN``."""
    out = np.zeros(len(starts), np.int64)
    tiles = starts // TILE
    down = _power(_BASES[which])[1]
    for t in np.unique(tiles):
        at = np.flatnonzero(tiles == t)
        s, e = starts[at] - t * TILE, ends[at] - t * TILE
        sums = _prefix_sums(data[t * TILE : (t + 1) * TILE + SPAN], _BASES[which])
        with np.errstate(over="ignore"):
            out[at] = (mix((sums[e] - sums[s]) * down[s]) + (e - s).astype(np.uint64)).view(np.int64)
    return out


def anchor_runs(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): consecutive places first..last of ``data`` have this anchor.

    ``ends[i]`` is the end of the text that place i lies in; a place counts if ``window + GRAM - 1`` bytes follow in it.
    """
    found = []
    for t in range(0, max(0, len(data) - window - GRAM + 2), TILE):
        part = data[t : t + TILE + window + GRAM - 2]
        n = len(part) - GRAM + 1
        with np.errstate(over="ignore"):
            sums = _prefix_sums(part, _BASES[0])
            grams = mix((sums[GRAM:] - sums[:n]) * _power(_BASES[0])[1][:n])
        keys = np.full(-(-n // window) * window, np.uint64(0xFFFFFFFFFFFFFFFF))
        keys[:n] = (grams & ~_PLACE) | np.arange(n, dtype=np.uint64)
        keys = keys.reshape(-1, window)
        ahead, behind = np.minimum.accumulate(keys, 1).ravel(), np.minimum.accumulate(keys[:, ::-1], 1)[:, ::-1].ravel()
        places = np.arange(t, t + n - window + 1)
        anchors = (np.minimum(behind[: n - window + 1], ahead[window - 1 : n]) & _PLACE).astype(np.int64) + t
        whole = places + window + GRAM - 1 <= ends[places]
        places, anchors = places[whole], anchors[whole]
        if not len(places):
            continue
        new = np.flatnonzero(np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (places[1:] != places[:-1] + 1))))
        found.append((anchors[new], places[new], places[np.concatenate((new[1:] - 1, [len(places) - 1]))]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    a, first, last = (np.concatenate(x) for x in zip(*found))
    over = np.concatenate(([False], (a[1:] == a[:-1]) & (first[1:] == last[:-1] + 1)))  # runs that a tile has cut
    return a[~over], first[~over], last[np.concatenate((~over[1:], [True]))]


class _Texts:
    """A batch of texts as one array of bytes, with its anchors."""

    def __init__(self, column, length: int) -> None:
        import pyarrow as pa

        column = column.cast(pa.large_string())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        self.at = at - at[0]
        self.length, self.window = length, window_of(length)
        ends = np.repeat(self.at[1:], np.diff(self.at))
        self.place, first, last = anchor_runs(self.data, ends, self.window)
        self.text = np.searchsorted(self.at, self.place, "right") - 1
        self.end = self.at[self.text + 1]
        last = np.minimum(last, self.end - length)
        self.used = first <= last  # some string of the whole length has this anchor
        self.far, self.near = self.place - first, self.place - last

    def certain(self, of: np.ndarray) -> np.ndarray:
        """Hashes of the bytes that every string with this anchor holds."""
        return string_hashes(self.data, self.place[of], self.place[of] + self.length - self.window + 1)


def _anchors(length: int):
    """Rows (t, twice, text) -> a row an anchor: (t, twice, pos, certain)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = _Texts(b["text"], length)
            used = np.flatnonzero(x.used)
            for a in range(0, len(used), SLICE):
                of = used[a : a + SLICE]
                rows = pa.array(x.text[of])
                yield pa.RecordBatch.from_arrays([b["t"].take(rows), b["twice"].take(rows), pa.array((x.place - x.at[x.text])[of]), pa.array(x.certain(of))], names=["t", "twice", "pos", "certain"])

    return run


_SEQUENCE = "g long, i int, t long, twice boolean, pos long, used boolean, near int, far int, s1 long, s2 long, symbol binary, l1 long, u1 long, u2 long, certain long, step int"


def _sequences(length: int):
    """Rows (t, twice, text, marks) -> sequences g of the anchors that suffixes of marked ones need, with their symbols.

    l1 is a hash of the bytes before an anchor that its strings hold, u1 and u2 are hashes of all bytes that they hold.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 24
        for b in batches:
            x = _Texts(b["text"], length)
            lists = b["marks"]
            marks = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(x.at[:-1], np.diff(lists.offsets.to_numpy()))
            used = x.used & np.isin(x.place, marks)
            near = np.maximum.accumulate(np.where(used, x.place, -1 - 2 * length)) if len(used) else x.place
            keep = np.flatnonzero((x.place - near < length) & (near >= x.at[x.text]))
            if not len(keep):
                continue
            place, text, end, used = x.place[keep], x.text[keep], x.end[keep], used[keep]
            new = np.concatenate(([True], (np.diff(keep) > 1) | (np.diff(text) > 0)))
            heads = np.flatnonzero(new)
            g = new.cumsum() - 1
            step = np.append(np.diff(place), length)
            step[np.append(new[1:], True)] = length
            stop = np.minimum(place + x.window + GRAM, end)
            far, low = np.where(used, x.far[keep], 0), np.where(used, x.near[keep], 0)
            left, right = place - far, np.where(used, place + length - low, place)
            i, pos, held = (np.arange(len(g)) - heads[g]).astype(np.int32), place - x.at[text], np.minimum(place + length - x.window + 1, end)
            for a in range(0, len(keep), SLICE):
                of = slice(a, a + SLICE)
                h = lambda s, e, w: pa.array(string_hashes(x.data, s[of], e[of], w))  # noqa: E731, B023
                rows = pa.array(text[of])
                symbols = pa.array([x.data[s:e].tobytes() for s, e in zip(place[of].tolist(), stop[of].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[of] + made), pa.array(i[of]), b["t"].take(rows), b["twice"].take(rows), pa.array(pos[of]), pa.array(used[of]), pa.array(low[of].astype(np.int32)), pa.array(far[of].astype(np.int32)),
                     h(place, stop, 0), h(place, stop, 1), symbols, h(left, place, 0), h(left, right, 0), h(left, right, 1), h(place, held, 0), pa.array(step[of].astype(np.int32))],
                    names=[c.split()[0] for c in _SEQUENCE.split(", ")],
                )
            made += int(g[-1]) + 1

    return run


_OPEN = "certain long, t long, pos long, near int, far int, rank long, twice boolean, bytes binary"


def _held_bytes(length: int):
    """Rows (t, text, open: anchors that are not settled) -> a row an anchor with the bytes that its strings hold."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            lists, flat = b["open"], b["open"].flatten()
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            texts = [t.as_buffer() for t in b["text"].cast(pa.large_binary())]
            pos, near, far = (flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("pos", "near", "far"))
            held = pa.array([bytes(texts[r][p - f : p - n + length]) for r, p, n, f in zip(rows.tolist(), pos, near, far)], pa.binary())
            yield pa.RecordBatch.from_arrays([flat.field("certain"), b["t"].take(pa.array(rows)), *[flat.field(c) for c in ("pos", "near", "far", "rank", "twice")], held], names=[c.split()[0] for c in _OPEN.split(", ")])

    return run


def _strings_of(b, length: int) -> tuple:
    """(row, back, hash of the bytes before the anchor, two hashes of the string) of every string of a batch of anchors."""
    held = b["bytes"]
    at = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    near, far = (b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("near", "far"))
    size = far - near + 1
    row = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(row)) - np.repeat(size.cumsum() - size, size)
    start = (at[:-1] - at[0])[row] + step
    back = far[row] - step
    return row, back, string_hashes(data, start, start + back), string_hashes(data, start, start + length), string_hashes(data, start, start + length, 1)


def _exploded(length: int):
    """A row a string of each anchor: (t, start, twice, back, rank, l1, w1, w2)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            row, back, left, one, two = _strings_of(b, length)
            of = lambda c: b[c].to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (of("t"), of("pos") - back, of("twice"), back.astype(np.int32), of("rank"), left, one, two)], names=["t", "start", "twice", "back", "rank", "l1", "w1", "w2"])

    return run


def _compared(length: int):
    """Anchors in the order of ``certain`` -> (t, lo, hi) of strings that another anchor of the same block also has.

    Strings are sorted by what stands before the anchor and the anchor's rank, and neighbours compared.
    """

    def settle(b):
        import pyarrow as pa

        row, back, left, one, two = _strings_of(b, length)
        of = lambda c: b[c].to_numpy(zero_copy_only=False)[row]
        block = of("certain")
        by = np.lexsort((one, of("rank"), left, back, block))
        like = np.zeros(len(by) + 1, bool)
        like[1:-1] = np.all([v[by][1:] == v[by][:-1] for v in (block, back, one, two)], axis=0)
        same = np.zeros(len(by), bool)
        same[by] = like[1:] | like[:-1]
        start = (of("pos") - back)[found := np.flatnonzero(same & ~of("twice"))]
        return pa.RecordBatch.from_arrays([pa.array(of("t")[found]), pa.array(start), pa.array(start)], names=["t", "lo", "hi"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None  # the last block may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            b = b if held is None else pa.concat_batches([held, b])
            key = b["certain"].to_numpy(zero_copy_only=False)
            cut = int(np.argmax(key == key[-1]))
            if cut:
                yield settle(b.slice(0, cut))
            held = b.slice(cut)
        if held is not None:
            yield settle(held)

    return run


# --- sorted tables ---


def _runs(keys: list[str], groups: int):
    """Within one range of a sorted table: runs of equal keys, rows of each group before the run, equal neighbours."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        me = TaskContext.get().partitionId()
        total, start, last, first, held = np.zeros(groups, np.int64), np.zeros(groups, np.int64), None, True, None

        def out(h, after: bool, end: bool) -> pa.RecordBatch:
            b, in_first, like, edge, less, done = h
            n = len(like)
            same = like.copy()
            same[:-1] |= like[1:]
            same[-1] |= after
            edge[-1] |= 2 * end
            whole = np.zeros((n, groups), np.int64)
            whole[-1] = done
            add = [pa.array(np.full(n, me, np.int32)), pa.array(in_first), pa.array(edge), pa.array(same), pa.array(like)]
            add += [pa.array(less[:, c].copy()) for c in range(groups)] + [pa.array(whole[:, c].copy()) for c in range(groups)]
            return pa.RecordBatch.from_arrays([*b.columns, *add], names=[*b.schema.names, *_extra(groups)])

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            k = np.stack([b[c].to_numpy(zero_copy_only=False) for c in keys], 1) if keys else np.arange(n)[:, None]
            of = b["group"].to_numpy(zero_copy_only=False) if groups > 1 else np.zeros(n, np.int64)
            like = np.zeros(n, bool)
            like[1:] = (k[1:] == k[:-1]).all(1)
            like[0] = bool(keys) and last is not None and bool((k[0] == last).all())
            before = np.zeros((n + 1, groups), np.int64)
            before[np.arange(1, n + 1), of] = 1
            before = before.cumsum(0) + total
            head = np.maximum.accumulate(np.where(like, -1, np.arange(n)))
            less = np.where((head >= 0)[:, None], before[np.maximum(head, 0)], start)
            in_first = (head < 0) & first if last is not None else head == 0
            edge = np.zeros(n, np.int32)
            edge[0] = last is None
            if held is not None:
                yield out(held, bool(like[0]), False)
            held = (b, in_first, like, edge, less, before[-1])
            total, start, last, first = before[-1], less[-1], k[-1].copy(), bool(in_first[-1])
        if held is not None:
            yield out(held, False, True)

    return run


def _extra(groups: int) -> list[str]:
    return ["_p", "_first", "_edge", "_same", "_like", *[f"_l{c}" for c in range(groups)], *[f"_n{c}" for c in range(groups)]]


def sorted_runs(rows: DataFrame, order: list, keys: list[str], path: str, groups: int = 1) -> DataFrame:
    """Sort ``rows`` over ranges by ``order``; runs of neighbours with equal integer ``keys`` get

    ``less0``, ``less1``, ...: rows of each group (column ``group``, from 0) before the run; ``same``: whether a neighbour has
    equal keys; ``head``: whether the row is the first of its run. Without ``keys`` each row is a run. ``order`` may end with
    columns that only spread equal keys. The table is written to ``path``; the driver sees two rows a range.
    """
    spark = rows.sparkSession
    kind = lambda name: T.IntegerType() if name in ("_p", "_edge") else T.BooleanType() if name in ("_first", "_same", "_like") else T.LongType()
    schema = T.StructType([*rows.schema.fields, *[T.StructField(name, kind(name)) for name in _extra(groups)]])
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = written(ranged.mapInArrow(_runs(keys, groups), schema), path)
    ends: dict[int, dict[int, object]] = {}
    for r in table.where("_edge > 0").select("_p", "_edge", "_first", *keys, *_extra(groups)[5:]).collect():
        for bit in (1, 2):
            if r._edge & bit:
                ends.setdefault(r._p, {})[bit] = r
    facts, total, before = [], [0] * groups, None  # before: last key, and rows before its run
    for p in sorted(ends):
        top, low = ends[p][1], ends[p][2]
        joined = bool(keys) and before is not None and before[0] == [top[k] for k in keys]
        first = before[1] if joined else list(total)
        facts.append([p, joined, False, *total, *first])
        if joined:
            facts[-2][2] = True
        before = ([low[k] for k in keys], first if low._first else [t + low[f"_l{c}"] for c, t in enumerate(total)])
        total = [t + low[f"_n{c}"] for c, t in enumerate(total)]
    names = [f"_b{c}" for c in range(groups)], [f"_f{c}" for c in range(groups)]
    known = F.broadcast(spark.createDataFrame(facts, "_p int, _joined boolean, _on boolean" + "".join(f", {c} long" for c in [*names[0], *names[1]])))
    less = [F.when(F.col("_first"), F.col(f"_f{c}")).otherwise(F.col(f"_b{c}") + F.col(f"_l{c}")).alias(f"less{c}") for c in range(groups)]
    first, last = F.col("_edge").bitwiseAND(1) > 0, F.col("_edge").bitwiseAND(2) > 0
    return table.join(known, "_p").select(*rows.columns, *less, (F.col("_same") | (first & F.col("_joined")) | (last & F.col("_on"))).alias("same"), (~F.col("_like") & ~(first & F.col("_joined"))).alias("head"))


# --- ranks of suffixes ---


def _as_strings(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (g, i, ...) -> a row a string: g, x (array in order of i)."""
    return rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", *more))).alias("x"))


def _at(i: Column, field: str, without: int) -> Column:
    return F.coalesce(F.get("x", i)[field], F.lit(without))


def suffix_ranks(strings: DataFrame, enough: int, levels: int | None = None) -> DataFrame:
    """``strings(g, x: array<struct<i, s, step, cover>>)`` -> ``(g, i, rank)``: how many suffixes are less than the one at i.

    ``s`` are symbols from 0; the end of a string is less than any. ``step`` and ``cover`` say how far the next symbol is and
    how much this one covers: suffixes that agree over ``enough`` may tie. All places are sorted by their next three symbols; those
    in a tie that covers less are sorted again by the ranks three, then nine, 27, ... places on, so every rank of a level looks equally
    far (a tie of unequal depths would part strings that are equal). The work ends after ``levels``, if given, with ties.
    """
    spark, level, reach = strings.sparkSession, 1, 1
    held = None
    strings = strings.withColumn("x", F.transform("x", lambda v: v.withField("open", F.lit(True))))
    while True:
        sorted_at, start_at, next_at = (scratch_path(spark, f"suffix-{k}") for k in ("sorted", "starts", "strings"))
        step = lambda v, i, last: F.least(F.lit(enough), v["step"] + _at(i + reach, "step", enough) + _at(i + 2 * reach, last, enough)).cast("int")  # noqa: E731, B023
        triple = lambda v, i: F.struct(i.alias("i"), v["s"].alias("s0"), _at(i + reach, "s", -1).alias("s1"), _at(i + 2 * reach, "s", -1).alias("s2"), step(v, i, "step").alias("step"), step(v, i, "cover").alias("cover"), v["open"].alias("open"))  # noqa: E731, B023
        rows = strings.select("g", F.explode(F.transform("x", triple)).alias("t")).select("g", "t.*")
        named = sorted_runs(rows.where("open").drop("open"), ["s0", "s1", "s2", "g"], ["s0", "s1", "s2"], sorted_at)
        rank = F.col("less0")
        if level > 1:  # rows of the table are those in ties: places within the tie are added to its rank
            starts = small(written(named.groupBy("s0").agg(F.min("less0").alias("start")), start_at))
            named, rank = named.join(starts, "s0"), F.col("s0") + F.col("less0") - F.col("start")
        named = named.select("g", "i", rank.alias("s"), "step", "cover", (F.col("same") & (F.col("cover") < enough)).alias("open"))
        if level > 1:
            named = named.union(rows.where("not open").select("g", "i", F.col("s0").alias("s"), "step", "cover", "open"))
        if level == levels or named.where("open").isEmpty():
            return named.select("g", "i", F.col("s").alias("rank"))
        strings = written(_as_strings(named, "s", "step", "cover", "open"), next_at)
        dropped(spark, sorted_at, start_at, *([held] if held else []))
        held, level, reach = next_at, level + 1, 3 * reach


# --- repeats ---


def _few(rows: DataFrame, size: Column) -> DataFrame:
    """Broadcast a written table of lists if rows and elements are few enough; they are counted."""
    n = rows.agg(F.count("*").alias("n"), F.sum(size).alias("of")).first()
    return F.broadcast(rows) if n.n <= BROADCAST_IDS and (n.of or 0) <= 4 * BROADCAST_IDS else rows


def _marked(texts: DataFrame, length: int, path: str) -> DataFrame:
    """Anchors whose certain bytes occur twice: (t, marks)."""
    anchors = written(texts.select("t", "twice", "text").mapInArrow(_anchors(length), "t long, twice boolean, pos long, certain long"), f"{path}-anchors")
    often = anchors.groupBy("certain").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n")).where("n > 1").select("certain")
    # a table of its own, so that the join can split the anchors of a hash that very many texts have
    often = small(written(often, f"{path}-often"))
    marks = written(anchors.join(often, "certain", "left_semi").groupBy("t").agg(F.collect_list("pos").alias("marks")), f"{path}-marks")
    dropped(texts.sparkSession, f"{path}-anchors", f"{path}-often")
    return marks


def _ordered(texts: DataFrame, marks: DataFrame, length: int, path: str) -> DataFrame:
    """Marked anchors with their rank in the order of suffixes, and whether one beside them holds the same bytes."""
    spark = texts.sparkSession
    rows = texts.select("t", "twice", "text").join(_few(marks, F.size("marks")), "t")
    sequences = written(rows.mapInArrow(_sequences(length), _SEQUENCE), f"{path}-sequences")
    symbols = sorted_runs(sequences.select("s1", "s2", "symbol").distinct(), ["symbol"], [], f"{path}-symbols")
    named = sequences.join(symbols.select("s1", "s2", F.col("less0").alias("s")), ["s1", "s2"])
    cover = F.when(F.col("step") >= length, length).otherwise(window_of(length) + GRAM)
    strings = written(_as_strings(named.select("g", "i", "s", "step", cover.alias("cover")), "s", "step", "cover"), f"{path}-strings")
    dropped(spark, f"{path}-marks", f"{path}-symbols")
    ranks = suffix_ranks(strings, length, LEVELS)
    ranked = sequences.where("used").select("g", "i", "t", "twice", "pos", "near", "far", "l1", "u1", "u2", "certain").join(ranks, ["g", "i"])
    # anchors of one rank that hold the same bytes agree in u1
    pairs = sorted_runs(ranked.drop("g", "i"), ["far", "near", "l1", "rank", "u1", "t"], ["far", "near", "u1", "u2"], f"{path}-pairs")
    dropped(spark, f"{path}-sequences", f"{path}-strings")
    return pairs


def repeated_starts(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``texts(t, twice, text)``, each text once -> ``(t, starts: array<struct<lo, hi>>)``.

    Strings of ``length`` bytes that begin at lo..hi occur elsewhere, in the same text or another, or the text does
    (``twice``). Texts without one have no row.

    Anchors that hold the same bytes, over all their strings, are neighbours in the order of suffixes and so settled. One of each
    such run, and the anchors that are in none, are looked into where a block (the anchors whose certain bytes agree, which
    lie together in that order) has several: their strings are sorted by what stands before the anchor and its rank, and
    neighbours compared; in one task for a block of at most ``BLOCK`` anchors, over ranges for others.
    """
    spark = texts.sparkSession
    bound_batches(spark)
    path = scratch_path(spark, "repeats")
    pairs = _ordered(texts, _marked(texts, length, path), length, path)
    settled = pairs.where("same or twice").select("t", (F.col("pos") - F.col("far")).alias("lo"), (F.col("pos") - F.col("near")).alias("hi"))
    heads = pairs.where("head").withColumn("twice", F.col("same") | F.col("twice"))
    mixed = heads.groupBy("certain").agg(F.count("*").alias("n"), F.min("twice").alias("all")).where("n > 1 and not all").select("certain", (F.col("n") > BLOCK).alias("many"))
    look = heads.join(mixed, "certain").groupBy("t").agg(F.collect_list(F.struct("pos", "near", "far", "rank", "twice", "certain", "many")).alias("open"))
    look = written(look, f"{path}-look")
    is_many = lambda x: x["many"]
    some = look.withColumns({"large": F.filter("open", is_many), "open": F.filter("open", lambda x: ~is_many(x))})
    held = lambda rows: texts.select("t", "text").join(_few(rows, F.size("open")), "t").select("t", "text", "open").mapInArrow(_held_bytes(length), _OPEN)
    blocks = held(some.where(F.size("open") > 0)).repartition("certain").sortWithinPartitions("certain")
    found = settled.union(blocks.mapInArrow(_compared(length), "t long, lo long, hi long"))
    large = some.where(F.size("large") > 0).select("t", F.col("large").alias("open"))
    if not large.isEmpty():
        each = held(large).mapInArrow(_exploded(length), "t long, start long, twice boolean, back int, rank long, l1 long, w1 long, w2 long")
        each = sorted_runs(written(each, f"{path}-each"), ["back", "l1", "rank", "w1", "t"], ["back", "w1", "w2"], f"{path}-order")
        found = found.union(each.where("same and not twice").select("t", F.col("start").alias("lo"), F.col("start").alias("hi")))
    return written(found.groupBy("t").agg(F.collect_list(F.struct("lo", "hi")).alias("starts")), f"{path}-starts")


def _cover(length: int):
    """Starts of repeated strings -> maximal runs of covered bytes (start, end)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            lists = b["starts"]
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(lists)), sizes)
            lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy() + length
            by = np.lexsort((hi, lo, row))
            row, lo, hi = row[by], lo[by], hi[by]
            far = 1 << 44  # texts one after another, far apart, so that no run reaches the next
            top = np.maximum.accumulate(hi + row * far)
            new = np.concatenate(([True], (lo + row * far)[1:] > top[:-1]))
            begins = np.flatnonzero(new)
            stops = np.concatenate((begins[1:] - 1, [len(row) - 1]))
            spans = pa.StructArray.from_arrays([pa.array(lo[begins]), pa.array(top[stops] - row[stops] * far)], names=["start", "end"])
            offsets = np.searchsorted(row[begins], np.arange(len(lists) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["t"], pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["t", "spans"])

    return run


def kept_bytes(text: Column, spans: Column) -> Column:
    """The bytes of a text outside ``spans`` (start, end; ascending, apart), as binary: a cut may split a character."""
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    whole = text.cast("binary")
    piece = lambda a, i: F.substring(whole, (a + 1).cast("int"), (F.coalesce(F.get(spans, i)["start"], F.octet_length(whole)) - a).cast("int")).cast("string")
    return F.when(F.size(spans) == 0, whole).otherwise(F.array_join(F.transform(bounds, piece), "").cast("binary"))


def dedup_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every row of ``docs`` with ``spans`` (array of start, end in bytes of its UTF-8 text) that lie in a repeated string.

    A byte is in a span if a string of ``length`` bytes over it also begins anywhere else, in the same text or another.
    Null is empty; texts shorter than ``length`` have no spans; rows with equal texts, the same row repeated among them, repeat
    each other wholly. All columns stay; a column named ``spans`` is replaced, names that begin with ``_dedup_`` are reserved.
    Texts are told apart by two 64-bit hashes; each different text is worked on once. ``length`` must be between 64 and 2048.
    """
    if not SHORTEST <= length <= SPAN // 2:
        raise ValueError(f"length must be between {SHORTEST} and {SPAN // 2}")
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = [F.xxhash64(F.lit(i), body) for i in (1, 2)]
    long = F.octet_length(body) >= length
    path, done = scratch_path(spark, "repeats-texts"), scratch_path(spark, "repeats-spans")
    each = docs.where(long).select(key[0].alias("k1"), key[1].alias("k2"), body.alias("text"))
    texts = each.groupBy("k1", "k2").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("twice"))
    texts = written(texts.withColumn("t", F.monotonically_increasing_id()), path)
    dropped(spark)
    spans = repeated_starts(texts, length).mapInArrow(_cover(length), "t long, spans array<struct<start: long, end: long>>")
    spans = written(spans.join(texts.select("t", "k1", "k2"), "t").select("k1", "k2", "spans"), done)
    dropped(spark, path)
    rest = [c for c in docs.columns if c.lower() != "spans"]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.when(long, key[0]).alias("_dedup_1"), F.when(long, key[1]).alias("_dedup_2"))
    found = _few(spans.toDF("_dedup_1", "_dedup_2", "spans"), F.size("spans"))
    return rows.join(found, ["_dedup_1", "_dedup_2"], "left").select(*[F.col(f"`{c}`") for c in rest], F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("spans"))


def plain_repeats(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """The spans of each text, by a table of all strings: for tests."""
    seen: dict[bytes, int] = {}
    cut = lambda t: [hashlib.md5(t[i : i + length]).digest() for i in range(len(t) - length + 1)]
    for t in texts:
        for d in cut(t):
            seen[d] = seen.get(d, 0) + 1
    out = []
    for t in texts:
        spans: list[tuple[int, int]] = []
        for i, d in enumerate(cut(t)):
            if seen[d] > 1:
                spans = [*spans[:-1], (spans[-1][0], i + length)] if spans and i <= spans[-1][1] else [*spans, (i, i + length)]
        out.append(spans)
    return out
