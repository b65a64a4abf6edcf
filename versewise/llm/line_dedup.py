"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Lines within ``edits`` edits share, unchanged, at least one of ``edits + 1`` segments of the shorter of the two,
at a place that the edits before and after it allow. Each distinct line is indexed by its segments and probes the
segments of lines up to ``edits`` characters shorter; what meets is verified by a banded bit-parallel distance.
A segment that very many lines share is not joined pair by pair: its lines are compared with one of them, and what
that leaves in different classes meets again on more and smaller segments, of which all but ``edits`` must agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.llm.components import connected_components, linked_to
from versewise.llm.scratch import cut, small

#: Production parameters: edits allowed at most, and the characters of the longer line that each edit needs.
EDITS, PER_EDIT = 2, 6
#: Indexed lines of one segment key that meet pair by pair; the number of segments that fuller keys go on to, and how
#: often such keys are looked into.
FULL, PIECES, DEPTH = 24, 9, 2
#: A line with more than one in so many of all occurrences is joined by broadcast: there are at most so many.
HEAVY = 1000
#: Characters that are counted in lines: an edit changes two of the counts by one at most. Of all lines, so few are counted
#: before they meet; of lines that have met, all. ``BITS`` of each count go along with a key.
COUNTED, BEFORE, BITS = " eanirtosdlu", 2, 5


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, line_no, line)``: the lines of every text; null has none."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def line_key(line: Column) -> Column:
    """128 bits that name a line: its hashes under two seeds."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def patterns(edits: int, pieces: int) -> list[tuple[int, int, int, int]]:
    """``(longer, s, t, between)``: how all but the pieces s and t can stand in a line longer by ``longer``.

    The pieces before s stand where they were, those between s and t ``between`` characters on and those after t
    ``longer`` characters on. Edits inside one piece are covered with a neighbour of it. Of lines of equal length
    one finds the other with a shift of 1 where the other way round it would be -1.
    """
    if edits == 1:
        return [(d, s, s, 0) for d in (0, 1) for s in range(pieces)]
    if edits != 2:
        raise ValueError("one or two edits")
    out = []
    for s in range(pieces):
        for t in range(s + 1, pieces):
            out += [(d, s, t, 0) for d in (0, 1, 2)] if t == s + 1 else [(0, s, t, 0), (0, s, t, 1), (1, s, t, 0), (1, s, t, 1), (2, s, t, 1)]
    return out


def allowed(longer: Column, edits: int, per_edit: int) -> Column:
    """Edits that a pair may have whose longer line has ``longer`` characters."""
    return F.least(F.lit(edits), F.floor(longer / per_edit)).cast("int")


def segment_keys(edits: int, per_edit: int, indexed: bool) -> Column:
    """Keys of a row ``(line, size)``: of its ``edits + 1`` segments if ``indexed``, else those and all it probes.

    A key is a hash of edits, length, segment and characters. Lines near a bound of ``allowed`` are indexed for
    both numbers of edits.
    """
    none = F.array().cast("array<bigint>")
    parts = []
    for e in range(1, edits + 1):
        keys = {True: [], False: []}
        for longer, s, t, between in patterns(e, e + 1):
            other = f"(size - {longer})"
            at = lambda j: f"(({other} * {j}) div {e + 1})"  # noqa: E731, B023
            runs = []
            if s > 0:
                runs.append(f"substring(line, 1, cast({at(s)} as int))")
            if t > s + 1:
                runs.append(f"substring(line, cast({at(s + 1)} + {between + 1} as int), cast({at(t)} - {at(s + 1)} as int))")
            if t < e:
                runs.append(f"substring(line, cast({at(t + 1)} + {longer + 1} as int), size)")
            keys[longer == between == 0].append(F.expr(f"xxhash64({(e * 64 + s) * 64 + t}, {other}, {', '.join(runs)})"))
        size, top = F.col("size"), (e + 1) * per_edit if e < edits else 1 << 30
        held = (size >= e * per_edit - e) & (size < top)
        own = (size >= e * per_edit) & (size < top)
        index = F.when(held, F.array(*keys[True])).otherwise(none)
        parts.append(index if indexed else F.when(own, F.array(*keys[True], *keys[False])).otherwise(index))
    return F.concat(*parts)


def _codes(edits: int, pieces: int, indexed: bool) -> Column:
    """The patterns of ``pieces`` segments as numbers, the plain ones of indexed lines alone or all."""
    return F.lit([((d * 2 + m) * 64 + s) * 64 + t for d, s, t, m in patterns(edits, pieces) if not indexed or d == m == 0])


def _places(code: Column, size: Column, pieces: int):
    """(s, t, shift between them, shift after t, place of a segment) of a pattern in a string of ``size`` characters."""
    t, s, between, longer = code % 64, F.shiftright(code, 6) % 64, F.shiftright(code, 12) % 2, F.shiftright(code, 13)
    return s, t, between, longer, lambda j: ((size - longer) * j / pieces).cast("int")


def finer_keys(edits: int, pieces: int, indexed: bool) -> Column:
    """Keys and codes of a row ``(part, line, size)``: hashes of all its segments but as many as there are edits.

    Only rows of one ``part`` meet. ``indexed`` as in ``segment_keys``.
    """

    def key(code: Column) -> Column:
        s, t, between, longer, at = _places(code, F.col("size"), pieces)
        runs = F.substring(F.col("line"), F.lit(1), at(s)), F.substring(F.col("line"), at(s + 1) + 1 + between, at(t) - at(s + 1)), F.substring(F.col("line"), at(t + 1) + 1 + longer, F.col("size"))
        return F.struct(F.xxhash64(F.col("part"), code % 4096, F.col("size") - longer, *runs).alias("key"), code.alias("code"))

    return F.transform(_codes(edits, pieces, indexed), key)


def left_open(pieces: int) -> Column:
    """What the pattern ``code`` leaves open of ``line``: its segments s and t as they stand, one after the other."""
    s, t, between, longer, at = _places(F.col("code"), F.col("size"), pieces)
    first = F.substring(F.col("line"), at(s) + 1, at(s + 1) - at(s) + between + F.when(s == t, longer).otherwise(0))
    return F.when(s == t, first).otherwise(F.concat(first, F.substring(F.col("line"), at(t) + 1 + between, at(t + 1) - at(t) + longer - between)))


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` bound once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by halving."""
    most = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.ceil(F.log2(most + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda d, s: F.when((d + s <= most) & (F.substring(a, d + 1, s) == F.substring(b, d + 1, s)), d + s).otherwise(d))


def banded_distance(edits: int) -> Column:
    """Edit distance of the strings whose characters are the arrays ``x`` and ``y``, or null if above ``edits``.

    Bit-parallel over the band of ``2 * edits + 1`` diagonals: the vertical differences of a column are two small
    bit sets that move one row down with every column, and the score follows the lowest diagonal, growing by its
    unset diagonal bits. Rows below the last are read as characters that match nothing; their differences in the
    last column lead from the lowest diagonal back to the last row. The state is one number.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    m, n = F.size("x"), F.size("y")
    same = lambda j, k: F.when(F.get("x", j - 1 - edits + k) == F.get("y", j - 1), F.lit(1 << k)).otherwise(F.lit(0))
    masks = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda j: sum((same(j, k) for k in range(1, width)), same(j, 0)).cast("bigint"))
    vp, vn = lambda s: s.bitwiseAND(F.lit(full)), lambda s: F.shiftright(s, width).bitwiseAND(F.lit(full))
    inv = lambda v: F.lit(full) - v

    def step(s: Column, pm: Column) -> Column:
        def with_diagonal(d0: Column) -> Column:
            hp, hn, down = vn(s).bitwiseOR(inv(d0.bitwiseOR(vp(s)))), d0.bitwiseAND(vp(s)), F.shiftright(d0, 1)
            score = F.shiftright(s, 2 * width) + 1 - F.shiftright(d0, width - 1)
            return hn.bitwiseOR(inv(down.bitwiseOR(hp))).bitwiseOR(F.shiftleft(down.bitwiseAND(hp), width)).bitwiseOR(F.shiftleft(score, 2 * width))

        d0 = ((pm.bitwiseAND(vp(s)) + vp(s)).bitwiseXOR(vp(s))).bitwiseOR(pm).bitwiseOR(vn(s)).bitwiseAND(F.lit(full))
        return _let(d0, with_diagonal)

    def finish(s: Column) -> Column:
        below = F.lit((1 << (2 * edits)) - 1).bitwiseAND(F.lit(-1) - (F.pow(F.lit(2), m - n + edits).cast("int") - 1))
        distance = F.shiftright(s, 2 * width) - F.bit_count(vp(s).bitwiseAND(below)) + F.bit_count(vn(s).bitwiseAND(below))
        return F.when(distance <= edits, distance.cast("int"))

    first = (((1 << (edits + 1)) - 1) << edits) | edits << (2 * width)
    return F.aggregate(masks, F.lit(first).cast("bigint"), step, finish)


def _may_be_near(a: Column, b: Column, edits: int) -> Column:
    """Whether strings that differ in their first and in their last characters can be within ``edits`` edits.

    With one edit, only single characters can. With two, one edit is at either end and what stands between is equal,
    moved by a character at most. With more, anything goes on to the distance.
    """
    if edits > 2:
        return F.lit(True)
    m, n = F.length(a), F.length(b)
    if edits == 1:
        return (m == 1) & (n == 1)
    inner = lambda s, first, last: F.substring(s, F.lit(1 + first), F.length(s) - first - last)
    same = lambda x, y: inner(a, *x) == inner(b, *y)
    level = same((1, 1), (1, 1)) | same((1, 0), (0, 1)) | same((0, 1), (1, 0))
    longer = same((0, 1), (1, 1)) | same((1, 0), (1, 1))
    shorter = same((1, 1), (0, 1)) | same((1, 1), (1, 0))
    return F.when(n == m, level).when(n == m + 1, longer).when(m == n + 1, shorter).when(n == m + 2, same((0, 0), (1, 1))).when(m == n + 2, same((1, 1), (0, 0))).otherwise(False)


def with_distance(pairs: DataFrame, a: str, b: str, edits: int, to: str = "distance") -> DataFrame:
    """Adds the banded distance of columns ``a`` and ``b``: null where it is above ``edits``.

    The lengths may differ by ``edits`` at most. What the strings share at both ends is cut off first: it does not
    change the distance. Pairs whose rest cannot be near are not measured.
    """
    rows = pairs.withColumn("_p", shared_prefix(F.col(a), F.col(b)))
    rows = rows.withColumns({"_a": F.substring(F.col(a), F.col("_p") + 1, F.length(a)), "_b": F.substring(F.col(b), F.col("_p") + 1, F.length(b))})
    rows = rows.withColumns({"_ra": F.reverse("_a"), "_rb": F.reverse("_b")}).withColumn("_s", shared_prefix(F.col("_ra"), F.col("_rb")))
    core = lambda c: F.substring(F.col(c), F.lit(1), F.length(c) - F.col("_s"))
    rows = rows.withColumns({"_a": core("_a"), "_b": core("_b")})
    empty = (F.length("_a") == 0) | (F.length("_b") == 0)
    rows = rows.withColumn("_near", ~empty & _may_be_near(F.col("_a"), F.col("_b"), edits))
    rows = rows.withColumns({c: F.when(F.col("_near"), F.split(s, "")).otherwise(F.array().cast("array<string>")) for c, s in (("x", "_a"), ("y", "_b"))})
    gap = F.greatest(F.length("_a"), F.length("_b"))
    measured = F.when(empty & (gap <= edits), gap).when(F.col("_near"), banded_distance(edits))
    return rows.withColumn(to, measured).drop("_p", "_a", "_b", "_ra", "_rb", "_s", "_near", "x", "y")


def _meet(rows: DataFrame, index: Column, probes: Column, edits: int, full: int | None, counted: DataFrame | None = None) -> DataFrame:
    """``(u, v, key)`` of the rows ``(id, line, size, packed, ...)`` that meet on a key.

    ``index`` and ``probes`` are arrays of keys. Rows with a ``side`` meet across sides only, and rows whose ``packed`` counts
    are too far apart do not. A key with more than ``full`` indexed lines (of ``counted(id, n, key)``, else of the rows) is
    full: there the line with most occurrences alone meets the others, and ``key`` is given with each of its lines, the
    one itself included; elsewhere it is null.
    """
    sided = "side" in rows.columns
    with_side = lambda name: [F.col("side").alias(name)] if sided else []
    left = rows.select(F.col("id").alias("u"), *with_side("s"), F.col("packed").alias("cu"), F.explode(index).alias("key"))
    right = rows.select(F.col("id").alias("v"), *with_side("r"), F.col("packed").alias("cv"), F.explode(probes).alias("key"))
    apart = F.expr("s <> r" if sided else "u <> v") & packed_allow(F.col("cu"), F.col("cv"), edits)
    crowded = None
    if full:
        each = rows.select("id", *with_side("s"), "n", F.explode(index).alias("key")) if counted is None else counted
        heads = [F.max_by(c, F.struct("n", "id") if sided else F.col("n")).alias(a) for c, a in (("id", "u"), ("s", "s"))[: 1 + sided]]
        crowded = cut(each.groupBy("key").agg(F.count("*").alias("c"), *heads).where(F.col("c") > full).drop("c"), "full")
        if not crowded.take(1):
            crowded = None
    if crowded is None:
        met = left.hint("shuffle_hash").join(right, "key").where(apart).select("u", "v", F.lit(None).cast("long").alias("key"))
    else:
        left = left.join(small(crowded.select("key")), "key", "left_anti").withColumn("full", F.lit(False)).unionByName(crowded.withColumns({"full": F.lit(True), "cu": F.lit(None).cast("long")}))
        # The indexed side has few rows a key, so its partitions can be hashed instead of sorting both sides.
        met = left.hint("shuffle_hash").join(right, "key").where(apart | F.col("full")).select("u", "v", F.when(F.col("full"), F.col("key")).alias("key"))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "key").where("u <> v or key is not null").distinct()


def _texts(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, name, line, n, counts)`` of the distinct lines with one of the given ids."""
    rows = lines.select(F.xxhash64("line").alias("id"), "line").join(small(ids), "id", "left_semi").groupBy("id", "line").agg(F.count("*").alias("n"))
    return cut(rows.select("id", line_key(F.col("line")).alias("name"), "line", "n", letter_counts(F.col("line")).alias("counts")), "texts")


def letter_counts(line: Column) -> Column:
    """How often each of the ``COUNTED`` characters, of one byte each, stands in the line."""
    return F.array(*[F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in COUNTED])


def packed_counts(line: Column, letters: str) -> Column:
    """The last ``BITS`` bits of the count of each of ``letters``, as one number."""
    bits = lambda c: (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit((1 << BITS) - 1)).cast("long")
    return sum((F.shiftleft(bits(c), BITS * i) for i, c in enumerate(letters[1:], 1)), bits(letters[0]))


def packed_allow(a: Column, b: Column, edits: int) -> Column:
    """Whether lines with these packed counts of the same letters can be within ``edits`` edits.

    Counts are compared around the circle of ``BITS`` bits, where they are no farther apart than they are: no pair
    within the edits is refused.
    """
    ring = 1 << BITS
    part = lambda x, i: F.shiftright(x, BITS * i).bitwiseAND(F.lit(ring - 1))
    gap = lambda i: F.abs(part(a, i) - part(b, i))
    return sum((F.least(gap(i), ring - gap(i)) for i in range(1, len(COUNTED))), F.least(gap(0), ring - gap(0))) <= 2 * edits


def counts_allow(a: Column, b: Column, edits: Column) -> Column:
    """Whether lines with these counts can be within ``edits`` edits; no pair within them is refused."""
    return sum((F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(1, len(COUNTED))), F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0)))) <= 2 * edits


def _verify(lines: DataFrame, met: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """Edges ``(u, v, m, n)`` between the names (and ids) of the lines of ``met(u, v)`` that are near.

    Pairs whose counts of letters cannot be so near leave the join of the texts, before both texts are shuffled and measured.
    """
    texts = _texts(lines, cut(met.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ids"))
    one = lambda id_, name, line, counts: texts.select(F.col("id").alias(id_), F.col("name").alias(name), F.col("line").alias(line), F.col("counts").alias(counts))
    both = met.join(one("u", "x", "a", "ca"), "u").join(one("v", "y", "b", "cb"), "v").where(F.abs(F.length("a") - F.length("b")) <= edits)
    both = both.where(counts_allow(F.col("ca"), F.col("cb"), allowed(F.greatest(F.length("a"), F.length("b")), edits, per_edit))).drop("ca", "cb")
    both = both.withColumnsRenamed({"x": "nu", "y": "nv"}).repartition("u", "v")
    # Written before it is filtered: a filter would be pushed below the columns of the distance, and repeat them in it.
    measured = with_distance(both, "a", "b", edits).withColumn("most", allowed(F.greatest(F.length("a"), F.length("b")), edits, per_edit))
    return cut(measured.select("u", "v", "nu", "nv", "distance", "most"), "distances").where("distance <= most").select("u", "v", "nu", "nv")


def near_lines(lines: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT, full: int = FULL, pieces: int = PIECES, depth: int = DEPTH) -> DataFrame:
    """Edges ``(u, v)`` whose connected lines are those of all pairs within the allowed edits.

    ``lines(line)`` may repeat lines; u and v are their ``line_key``. A pair may differ by ``edits`` edits at most, and
    by one for every ``per_edit`` characters of its longer line. Equal lines are combined before the shuffle; segment
    keys are hashed, so only numbers are shuffled by the join; texts are looked up for lines that met.

    A full key's lines are compared with the most frequent of them. If they are not all in one class then, those
    lines meet again on keys of ``pieces`` segments of which all but ``edits`` agree, across classes only; where such a
    key is full too, on the segments that it leaves open, cut again, and so on ``depth`` times. The last keys meet pair
    by pair. So no link between two classes is lost, and pairs inside a class are not all made.
    """
    long_ = lines.where(F.length("line") >= per_edit - 1).select("line", F.length("line").alias("size"))
    rows = long_.distinct().select(F.xxhash64("line").alias("id"), "line", "size", packed_counts(F.col("line"), COUNTED[:BEFORE]).alias("packed"))
    index, probes, edges = segment_keys(edits, per_edit, True), segment_keys(edits, per_edit, False), None
    # Counted by hashes alone, so that the lines themselves are shuffled once only.
    counted = long_.select(F.xxhash64("line").alias("id"), F.explode(index).alias("key")).groupBy("id", "key").agg(F.count("*").alias("n"))
    only = lambda keys: F.transform(keys, lambda x: x["key"])
    for level in range(depth + 1):
        met = cut(_meet(rows, index, probes, edits, full if level < depth else None, None if level else counted), "met")
        found = _verify(lines, met.where("u <> v").select("u", "v").distinct(), edits, per_edit)
        edges = found if edges is None else edges.unionByName(found)
        if level == depth:
            break
        members = met.where("key is not null").select("key", F.explode(F.array("u", "v")).alias("id")).distinct()
        if not members.take(1):
            break
        sides = cut(linked_to(edges.select("u", "v")), "sides")
        sided = cut(members.join(small(sides), F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("label", "id").alias("side")), "members")
        mixed = small(cut(sided.groupBy("key").agg(F.min("side").alias("x"), F.max("side").alias("y")).where("x <> y").select("key"), "mixed"))
        again = cut(sided.join(mixed, "key", "left_semi").select("id", "side").distinct(), "again")
        if not again.take(1):
            break
        again = small(again)
        if level == 0:
            rows = _texts(lines, again.select("id")).join(again, "id").select("id", "n", "side", "line", F.length("line").alias("size"), F.lit(0).cast("long").alias("part"), packed_counts(F.col("line"), COUNTED).alias("packed"))
        else:
            opened = rows.drop("side").join(again, "id").withColumn("k", F.explode(finer_keys(edits, pieces, False))).select("*", "k.key", "k.code").join(mixed, "key", "left_semi")
            rows = opened.select("id", "n", "side", left_open(pieces).alias("line"), F.col("key").alias("part"), "packed").distinct().withColumn("size", F.length("line"))
            rows = cut(rows, "open")
        index, probes = only(finer_keys(edits, pieces, True)), only(finer_keys(edits, pieces, False))
    return edges.select(F.col("nu").alias("u"), F.col("nv").alias("v"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, n_lines, n_exact, n_near, dropped)``: a row per document.

    Lines that are equal, or linked by the edits that ``near_lines`` allows, are one class; of each class the first
    line by (doc_id, text's hash, line number) is kept, null ids last. Blank lines are always kept. ``dropped`` lists
    the numbers of the lines that go; ``n_exact`` of them equal an earlier line and ``n_near`` do not. Null text has
    no lines. Rows that repeat a doc_id and its text are one document. Ids may be of any type that has an order.
    """
    lines = split_lines(docs, id_col, text_col)
    blank = F.col("line").rlike(r"^\s*$")
    edges = cut(near_lines(lines.where(~blank).select("line"), edits, per_edit), "edges")
    classes = cut(connected_components(edges).select("node.a", "node.b", "component"), "classes")
    occur = cut(lines.where(~blank).select("doc_id", "text_key", "line_no", line_key(F.col("line")).alias("name")).select("doc_id", "text_key", "line_no", "name.*"), "occurrences")
    # Only lines with company go on: those that repeat and those that are near to another.
    shared = occur.groupBy("a", "b").agg(F.count("*").alias("n")).join(small(classes), ["a", "b"], "left").where("n > 1 or component is not null")
    shared = cut(shared, "shared")
    # Frequent lines are joined by broadcast: fewer than HEAVY can have more than a HEAVY-th of all occurrences.
    heavy = F.col("n") > F.lit(max(1, occur.count() // HEAVY))

    def with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
        often = F.broadcast(facts.where(heavy))
        rest = rows.join(often.select("a", "b"), ["a", "b"], "left_anti").join(facts.where(~heavy), ["a", "b"])
        return rows.join(often, ["a", "b"]).unionByName(rest)

    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "line_no")
    held = cut(with_facts(occur, shared.select("a", "b", "n", "component")).withColumn("at", place), "held")
    own = cut(held.groupBy("a", "b").agg(F.min("at").alias("own")).join(shared, ["a", "b"]), "own")
    firsts = cut(own.where("component is not null").groupBy("component").agg(F.min("own").alias("first")), "firsts")
    known = cut(own.join(small(firsts), "component", "left").select("a", "b", "n", "own", F.coalesce("first", "own").alias("first")), "known")
    judged = with_facts(held.select("a", "b", "at"), known)
    gone = judged.where("at <> first").select("at.doc_id", "at.text_key", "at.line_no", (F.col("at") != F.col("own")).alias("exact"))
    drops = gone.groupBy("doc_id", "text_key").agg(F.count_distinct(F.when(F.col("exact"), F.col("line_no"))).alias("n_exact"), F.array_sort(F.collect_set("line_no")).alias("dropped"))
    n_lines = F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0))
    whole = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines")).groupBy("doc_id", "text_key").agg(F.max("n_lines").alias("n_lines"))
    rows = whole.alias("w").join(drops.alias("d"), F.col("w.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("w.text_key") == F.col("d.text_key")), "left")
    none, n_exact = F.array().cast("array<int>"), F.coalesce("n_exact", F.lit(0)).cast("long")
    return rows.select("w.doc_id", "w.text_key", "n_lines", n_exact.alias("n_exact"), (F.coalesce(F.size("dropped"), F.lit(0)) - n_exact).cast("long").alias("n_near"), F.coalesce("dropped", none).alias("dropped"))


def drop_lines(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts; the columns stay as they are."""
    marks = judged.where(F.size("dropped") > 0).select("doc_id", "text_key", "dropped").alias("m")
    own = lambda c: F.col(f"d.`{c}`")
    rows = docs.alias("d").join(marks, own(id_col).eqNullSafe(F.col("m.doc_id")) & (F.xxhash64(own(text_col)) == F.col("m.text_key")), "left")
    left = F.array_join(F.filter(F.split(own(text_col), "\n"), lambda x, i: ~F.array_contains(F.col("m.dropped"), i)), "\n")
    text = F.when(F.col("m.dropped").isNull(), own(text_col)).otherwise(left)
    return rows.select(*[text.alias(c) if c == text_col else own(c) for c in docs.columns])
