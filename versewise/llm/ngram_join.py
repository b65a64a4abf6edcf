"""N-gram Jaccard join by MinHash banding: shuffle on band hashes, verify on the full n-gram sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versewise.llm.components import connected_components
from versewise.llm.scratch import bound_batches, cut, small
from versewise.llm.texthash import blocks, gram_hashes, mix, word_hashes

#: A set with more than one in so many of all rows is joined by broadcast: there are at most so many.
HEAVY = 1000
#: Bytes of n-gram sets that one side of a verification block holds.
BLOCK_BYTES = 16 << 20


@dataclass(frozen=True)
class Banding:
    """``bands`` groups of ``rows`` minima: pairs of similarity s meet with chance 1 - (1 - s**rows)**bands."""

    bands: int
    rows: int

    def recall(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands


def choose_banding(threshold: float = 0.8, recall: float = 0.9999, most_hashes: int = 160) -> Banding:
    """The bands and rows that reach ``recall`` at ``threshold`` with the fewest candidates below it.

    Every row count within ``most_hashes`` is tried with the fewest bands that reach the recall; the choice has
    the least area of the candidate curve below the threshold.
    """
    best = None
    for rows in range(1, most_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))
        if bands * rows > most_hashes:
            continue
        b = Banding(bands, rows)
        area = sum(b.recall(threshold * i / 100) for i in range(100))
        if best is None or area < best[0]:
            best = (area, b)
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best[1]


def _hash_family(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    return draw() + np.uint64(1), draw()


def signatures(docs: DataFrame, banding: Banding, n: int = 5, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """``(doc_id, text_key, digest, n_grams, bands)`` and, with ``sets``, the sorted n-gram hashes as ``grams`` (binary).

    Words are lower-cased runs of letters and digits; a text of fewer than n words, but not none, is one gram.
    Texts without words have a null digest.
    """
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, text_key long, digest binary, n_grams int, bands binary" + (", grams binary" if sets else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hash_family(banding.bands * banding.rows)
        a, b = a[:, None], b[:, None]
        salt = np.arange(banding.bands, dtype=np.uint64)
        for batch in batches:
            for first, texts in blocks(batch.column(2)):
                words, at = word_hashes(texts)
                out = ([], [], [], [])
                for i in range(len(texts)):
                    if at[i] == at[i + 1]:
                        for x, v in zip(out, (None, 0, None, None)):
                            x.append(v)
                        continue
                    grams = np.unique(gram_hashes(words[at[i] : at[i + 1]], n))
                    least = np.full(banding.bands * banding.rows, np.iinfo(np.uint64).max)
                    with np.errstate(over="ignore"):
                        for j in range(0, len(grams), 2048):
                            least = np.minimum(least, (a * grams[j : j + 2048] + b).min(axis=1))
                        band = mix(mix(least).reshape(banding.bands, banding.rows).cumsum(axis=1, dtype=np.uint64)[:, -1] + salt * np.uint64(0x9E3779B97F4A7C15))
                    raw = grams.tobytes()
                    for x, v in zip(out, (hashlib.blake2b(raw, digest_size=16).digest(), len(grams), band.tobytes(), raw)):
                        x.append(v)
                cols = [batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(out[3], pa.binary())] if sets else []), names)

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def intersections(left: list[np.ndarray], right: list[np.ndarray], cells: int = 4 << 20) -> np.ndarray:
    """Sizes of the intersections of all pairs, from incidence matrices over slices of the shared values."""
    if len(left) == len(right) == 1:
        return np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]])
    values = [np.concatenate(x) for x in (left, right)]
    owners = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (left, right)]
    both, total = np.intersect1d(*values), np.zeros((len(left), len(right)))
    places = [np.minimum(np.searchsorted(both, v), max(len(both) - 1, 0)) for v in values]
    found = [both[p] == v if len(both) else np.zeros(len(v), bool) for p, v in zip(places, values)]
    step = max(1, cells // max(len(left), len(right)))
    for start in range(0, len(both), step):
        width = min(step, len(both) - start)
        grid = []
        for p, f, o, x in zip(places, found, owners, (left, right)):
            m = np.zeros((len(x), width), np.float32)
            inside = f & (p >= start) & (p < start + width)
            m[o[inside], p[inside] - start] = 1
            grid.append(m)
        total += grid[0] @ grid[1].T
    return total.astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each member's component under the links (i, j), by spreading minima and jumping."""
    up = np.arange(n)
    while len(i):
        least = np.minimum(up[i], up[j])
        new = up.copy()
        np.minimum.at(new, i, least), np.minimum.at(new, j, least)
        np.minimum.at(new, up[i], least), np.minimum.at(new, up[j], least)
        new = new[new]
        if (new == up).all():
            break
        up = new
    return up


def _verify(rows: list[tuple], threshold: float) -> list[tuple]:
    """Links of one block's pairs: ``(digest, root, links, linked)`` of every set that has one.

    A pair counts in the first band that the two share and in no other, so that no pair is emitted or counted
    twice. Output is a row a set, whatever the number of pairs.
    """
    rows = sorted(rows, key=lambda r: (r[4], r[5]))
    band, lo, hi = rows[0][0], rows[0][2], rows[0][3]
    mine = [r for r in rows if r[4] == lo]
    other = mine if lo == hi else [r for r in rows if r[4] == hi]
    if not other or len(rows) < 2:
        return []
    left, right = [np.frombuffer(r[9], np.uint64) for r in mine], [np.frombuffer(r[9], np.uint64) for r in other]
    shared = intersections(left, right)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - shared
    linked = shared >= threshold * union - 1e-9
    if lo == hi:
        linked &= np.triu(np.ones_like(linked), 1)
    sig = [np.array([np.frombuffer(r[8], np.uint64) for r in side]) for side in (mine, other)]
    pairs = np.argwhere(linked)
    n = len(mine)
    links, near = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    copies = np.array([r[7] for r in mine] + ([] if lo == hi else [r[7] for r in other]))
    held = []
    for start in range(0, len(pairs), 65536):
        part = pairs[start : start + 65536]
        first = (sig[0][part[:, 0]] == sig[1][part[:, 1]]).argmax(axis=1) == band
        i, j = part[first, 0], part[first, 1] + (0 if lo == hi else n)
        np.add.at(near, i, 1), np.add.at(near, j, 1)
        np.add.at(links, i, copies[j]), np.add.at(links, j, copies[i])
        held.append((i, j))
    every = mine if lo == hi else mine + other
    ends = [np.concatenate(x) if held else np.zeros(0, np.int64) for x in (zip(*held) if held else ((), ()))]
    up = _roots(len(every), *ends)
    return [(every[k][5], every[up[k]][5], int(links[k]), int(near[k])) for k in range(len(every)) if near[k]]


def ngram_jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, class_id, n_links, n_copies, first)``: one row per document.

    Two documents are linked when the Jaccard similarity of their sets of word n-grams is at least ``threshold``;
    ``class_id`` is the least doc_id of the connected documents (null if all are null), ``n_links`` the number of
    documents linked to this one (those with an equal set included) and ``n_copies`` that of equal sets alone.
    ``first`` marks the class's first row by (doc_id, hash of the text), null ids last, and rows equal to it in
    both. Documents with equal sets are joined as one, named by a 128-bit digest of the set. Band buckets with equal
    members are verified once; a bucket of any size is dealt over blocks of bounded bytes, each pair of blocks being
    a task's group. Null and empty texts, and texts without words, have no set: each is a class of its own without
    links. Repeated rows of one id count as copies of one another. Ids are integers.
    """
    banding = choose_banding(threshold, recall)
    marks = cut(signatures(docs, banding, n, id_col, text_col), "signatures")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    same = marks.where("digest is not null").groupBy("digest").agg(F.min(at).alias("head"), F.count("*").alias("copies"), F.min(F.struct("n_grams", "bands")).alias("x"))
    same = cut(same.select("digest", "head", "copies", "x.n_grams", "x.bands"), "copies")
    band_rows = same.select("digest", "n_grams", "copies", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(banding.bands - 1)), lambda i: F.substring("bands", i * 8 + 1, F.lit(8)))).alias("band", "bucket"))
    buckets = band_rows.groupBy("band", "bucket").agg(F.count("*").alias("k"), F.sum(F.col("n_grams").cast("long") * 8).alias("bytes"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y")).where("k > 1")
    kept = buckets.groupBy("k", "bytes", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.band", "b.bucket", F.greatest(F.lit(1), F.ceil(F.greatest(F.col("bytes") / BLOCK_BYTES, F.col("k") / 2048))).cast("int").alias("parts"))
    members = cut(band_rows.join(small(cut(kept, "buckets")), ["band", "bucket"]).select("band", "bucket", "parts", "digest", "copies"), "members")
    active = cut(same.join(small(cut(members.select("digest").distinct(), "active")), "digest", "left_semi").select("head.doc_id", "head.text_key"), "heads")
    mine = F.col(f"d.`{id_col}`").eqNullSafe(F.col("h.doc_id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("h.text_key"))
    chosen = docs.alias("d").join(small(active).alias("h"), mine, "left_semi")
    grams = signatures(chosen, banding, n, id_col, text_col, sets=True).select("digest", "bands", "grams").dropDuplicates(["digest"])
    part = F.pmod(F.xxhash64("digest", F.lit(5)), F.col("parts")).cast("int")
    dealt = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("band", "bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "digest", "copies")
    dealt = dealt.join(grams, "digest").select("band", "bucket", "lo", "hi", "part", "digest", F.lit(0).alias("pad"), "copies", "bands", "grams")
    group = ["band", "bucket", "lo", "hi"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([], [], [], []), kinds)], ["digest", "root", "links", "linked"])

        for batch in batches:
            done: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:4] != row[:4]:
                    done += _verify(held, threshold)
                    held = []
                held.append(row)
            yield out(done)
        if held:
            yield out(_verify(held, threshold))

    links = cut(dealt.mapInArrow(verify, "digest binary, root binary, links long, linked long"), "links")
    classes = cut(connected_components(links.select(F.col("digest").alias("u"), F.col("root").alias("v"))), "classes")
    counts = links.groupBy("digest").agg(F.sum("links").alias("links"))
    found = cut(counts.join(small(classes), F.col("digest") == F.col("node"), "left").select("digest", "links", "component"), "found")
    info = same.select("digest", "head", "copies").join(small(found), "digest", "left").where("copies > 1 or links is not null")
    heads = cut(info.where("component is not null").groupBy("component").agg(F.min("head").alias("lead")), "leads")
    facts = cut(info.join(small(heads), "component", "left").select(F.col("digest").alias("known"), F.coalesce("lead", "head").alias("lead"), "copies", F.coalesce("links", F.lit(0)).alias("links")), "facts")
    # Sets of very many documents are joined by broadcast: fewer than HEAVY can have more than a HEAVY-th of all rows.
    bound = F.lit(max(1, marks.count() // HEAVY))
    often = F.broadcast(facts.where(F.col("copies") > bound))
    rows = marks.select("doc_id", "text_key", "digest")
    worded = rows.where("digest is not null")
    joined = worded.join(often, F.col("digest") == F.col("known")).unionByName(worded.join(often.select("known"), F.col("digest") == F.col("known"), "left_anti").join(facts.where(F.col("copies") <= bound), F.col("digest") == F.col("known"), "left"))
    joined = joined.drop("digest", "known").unionByName(rows.where("digest is null").drop("digest"), allowMissingColumns=True)
    copies = F.coalesce("copies", F.lit(1)) - 1
    own = F.col("lead").isNull() | (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_key") == F.col("lead.text_key")))
    return joined.select("doc_id", "text_key", F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("class_id"), (copies + F.coalesce("links", F.lit(0))).alias("n_links"), copies.alias("n_copies"), own.alias("first"))
