"""Token-ID shards: concatenated ids with Elias-Fano document boundaries.

A shard file is ``magic | header | ids | boundaries | keys``. The boundaries (the end of every document in ids)
and the document keys (less the first) are non-decreasing sequences of n numbers up to u; each takes about ``2 + log2(u / n)`` bits each: the low bits are packed
as they are, the high bits are written in unary, and a sampled select structure finds the i-th one bit, so
``ends[i] = (select1(i) - i) << low | low_bits[i]`` without a table of 64-bit offsets.
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.llm.ranges import range_bounds, range_of
from versewise.llm.scratch import bound_batches, kept_by_worker, scratch_path

MAGIC = b"VWTOK1\0\0"
_HEAD = struct.Struct("<8sqQQQB7x")  # magic, first key, documents without a key, documents, ids, bytes of an id
_PART = struct.Struct("<QQB7x")  # bytes of packed low bits, bytes of unary high bits, low bits a value
#: One bits between two samples of the select structure, and documents that a reader decodes at a time.
SAMPLE, BLOCK = 64, 4096


class EliasFano:
    """A non-decreasing sequence below 2**62, with random access by select.

    It is read where it lies: beside its bytes only the place of every SAMPLE-th one bit is held.
    """

    def __init__(self, n: int, low: int, low_bytes: bytes, high_bytes: bytes):
        self.n, self.low = n, low
        self.low_words, self.words = np.frombuffer(low_bytes, np.uint8), np.frombuffer(high_bytes, np.uint8)
        samples, seen = [], 0
        for at in range(0, len(self.words), 1 << 16):
            ones = np.flatnonzero(np.unpackbits(self.words[at : at + (1 << 16)], bitorder="little"))
            samples.append(at * 8 + ones[-seen % SAMPLE :: SAMPLE])
            seen += len(ones)
        self.samples = np.concatenate(samples).astype(np.uint32 if len(self.words) < 1 << 29 else np.uint64) if samples else np.zeros(0, np.uint32)

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
        """(low bits a value, packed low bits, unary high bits)."""
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        low_part = ((values[:, None] >> np.arange(low)) & 1).astype(np.uint8) if low else np.zeros((n, 0), np.uint8)
        high = np.zeros((top >> low) + n + 1, np.uint8)
        high[(values >> low) + np.arange(n)] = 1
        return low, np.packbits(low_part.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()

    @property
    def nbytes(self) -> int:
        return self.low_words.nbytes + self.words.nbytes + self.samples.nbytes

    def select(self, first: int, count: int = 1) -> np.ndarray:
        """The places of ``count`` one bits from the ``first``-th on: from the sample before it, onwards."""
        at, skip = int(self.samples[first // SAMPLE]), first % SAMPLE
        byte, found, places = at // 8, -(np.bitwise_count(self.words[at // 8] & ((1 << at % 8) - 1)).item()), []
        while found < skip + count:
            bits = np.flatnonzero(np.unpackbits(self.words[byte : byte + 64], bitorder="little"))
            places.append(bits + byte * 8)
            found, byte = found + len(bits), byte + 64
        places = np.concatenate(places)
        skip += int(np.searchsorted(places, at))
        return places[skip : skip + count]

    def values(self, first: int, count: int) -> np.ndarray:
        """``count`` values from the ``first``-th on."""
        if not count:
            return np.zeros(0, np.int64)
        out = (self.select(first, count) - np.arange(first, first + count)) << self.low
        if self.low:
            start, stop = first * self.low, (first + count) * self.low
            bits = np.unpackbits(self.low_words[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start]
            out |= bits.reshape(count, self.low).astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.values(i, 1)[0])


def _pack_sequence(values: np.ndarray) -> bytes:
    low, low_bytes, high_bytes = EliasFano.encode(values)
    return _PART.pack(len(low_bytes), len(high_bytes), low) + low_bytes + high_bytes


def _read_sequence(data: bytes, at: int, n: int) -> tuple[EliasFano, int]:
    n_low, n_high, low = _PART.unpack_from(data, at)
    at += _PART.size
    return EliasFano(n, low, data[at : at + n_low], data[at + n_low : at + n_low + n_high]), at + n_low + n_high


def pack_shard(keys: list[int | None], ids: bytes, lengths: np.ndarray, width: int) -> bytes:
    """A shard's bytes: ``ids`` little-endian of ``width`` bytes each; ``keys`` ascend, null ones first."""
    known = np.array([k for k in keys if k is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    head = _HEAD.pack(MAGIC, first, len(keys) - len(known), len(keys), len(ids) // width, width)
    return b"".join((head, ids, _pack_sequence(np.cumsum(lengths)), _pack_sequence(known - first)))


class Shard:
    """A reader of one shard's bytes."""

    def __init__(self, data: bytes):
        magic, self.first, self.keyless, self.n, n_ids, self.width = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.ids = np.frombuffer(data, f"<u{self.width}", n_ids, _HEAD.size)
        self.ends, at = _read_sequence(data, _HEAD.size + n_ids * self.width, self.n)
        self._keys, _ = _read_sequence(data, at, self.n - self.keyless)

    def keys(self, first: int, count: int) -> list[int | None]:
        """The keys of ``count`` documents from the ``first``-th on."""
        keyless = max(0, min(count, self.keyless - first))
        return [None] * keyless + (self._keys.values(max(0, first - self.keyless), count - keyless) + self.first).tolist()

    def starts(self, first: int, count: int) -> np.ndarray:
        """Where ``count`` documents from the ``first``-th on begin, and where the last of them ends."""
        before = self.ends.values(first - 1, 1) if first else np.zeros(1, np.int64)
        return np.concatenate((before, self.ends.values(first, count)))

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the shard."""
        return self.ids[self.ends[i - 1] if i else 0 : self.ends[i]]


def write_file(folder: str, name: str, data: bytes) -> None:
    """Put a whole file into a shared folder: a private name first, then a rename, so that retries agree."""
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    where.create_dir(base, recursive=True)
    own = f"{base}/_{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(own) as out:
        out.write(data)
    where.move(own, f"{base}/{name}")


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Fixed value: the pre-tokenizer whose pieces are known here, namely runs of letters, single digits, runs of
#: other marks and a few English endings after an apostrophe; white space separates and is dropped.
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_PLAIN_WORD = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-/:-@\[-`{-~]*)")


class WordEncoder:
    """Encodes texts through bounded caches of white-space-delimited words and of their letters.

    The tokenizer drops ASCII white space and never joins what stands on its two sides, so a text's ids are
    those of its words in order. A word of Latin letters with marks after it is two pieces: its letters, lower-cased,
    which go to the tokenizer's model straight, and its marks. All other words are encoded whole.
    """

    def __init__(self, path: str, width: int, most: int = 260_000):
        self.tokenizer, self.code, self.most = _tokenizer(path), {2: "H", 4: "I"}[width], most
        self.words: dict[bytes, bytes] = {}
        self.letters: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {b"": b""}
        alphabet = [chr(c) for c in [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]]
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.bytewise = str.maketrans({c: split(c)[0][0] for c in alphabet})

    def pack(self, ids: list[int]) -> bytes:
        """Ids as little-endian bytes."""
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, word: str) -> bytes:
        return self.pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def word(self, raw: bytes) -> bytes:
        """The ids of one word. Words of ASCII letters with one mark or none are told by their bytes."""
        if raw.isalpha():
            core, tail = raw.lower(), b""
        elif raw[-1] in _MARKS and raw[:-1].isalpha():
            core, tail = raw[:-1].lower(), raw[-1:]
        else:
            word = raw.decode("utf-8", "replace")
            plain = _PLAIN_WORD.fullmatch(word)
            if not plain:
                return self._whole(word)
            core, tail = plain[1].lower().encode(), plain[2].encode()
        ids = self.letters.get(core)
        if ids is None:
            if len(self.letters) > self.most:
                self.letters.clear()
            ids = self.letters[core] = self.pack([t.id for t in self.tokenizer.model.tokenize(core.decode().translate(self.bytewise))])
        end = self.marks.get(tail)
        if end is None:
            if len(self.marks) > self.most:
                self.marks = {b"": b""}
            end = self.marks[tail] = self._whole(tail.decode())
        return ids + end

    def __call__(self, text: bytes) -> bytes:
        if len(self.words) > self.most:
            self.words.clear()
        known, out = self.words, []
        for w in text.split():
            ids = known.get(w)
            if ids is None:
                ids = known[w] = self.word(w)
            out.append(ids)
        return b"".join(out)


def _word_encoder(path: str, width: int) -> WordEncoder:
    """One for each Python worker, so that its caches serve all of the worker's tasks."""
    return kept_by_worker((path, width), lambda: WordEncoder(path, width))


@lru_cache(maxsize=4)
def tokenizer_facts(path: str) -> tuple[int, bool]:
    """(bytes that an id needs, whether words may be encoded on their own as WordEncoder does)."""
    import json

    tok = _tokenizer(path)
    width = 2 if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    spec = json.loads(tok.to_str())
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    known = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": _KNOWN_SPLIT} and steps[0].get("behavior") == "Removed"
    # Words may be encoded apart only if the normaliser lower-cases (composing is left to whole words) and no added token
    # can stand inside a text.
    steps = spec.get("normalizer") or {}
    kinds = {x.get("type") for x in (steps.get("normalizers", []) if steps.get("type") == "Sequence" else [steps])}
    lowers = "Lowercase" in kinds and kinds <= {"NFC", "Replace", "Lowercase"}
    added = any(t["content"].isalpha() or not t.get("special") for t in spec.get("added_tokens", []))
    return width, known and lowers and not added and spec["model"].get("end_of_word_suffix") is not None


def encode_texts(docs: DataFrame, tokenizer_path: str, end_id: int, text_col: str = "text") -> DataFrame:
    """The other columns and ``ids``: those of every whole text and ``end_id`` after them, little-endian.

    Null is the empty text. No special tokens are added.
    """
    width, by_piece = tokenizer_facts(tokenizer_path)
    kept = [c for c in docs.columns if c != text_col]
    schema = docs.select(*kept).schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, dtype = _word_encoder(tokenizer_path, width), np.dtype(f"<u{width}")
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [t or b"" for t in part.column(len(kept)).to_pylist()]
                if by_piece:
                    coded = [encoder(t) for t in texts]
                else:
                    coded = [np.array(e.ids, dtype).tobytes() for e in encoder.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([c + end for c in coded], pa.binary())], [*kept, "ids"])

    bound_batches(docs.sparkSession)
    return docs.select(*kept, F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def write_token_store(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None, order_col: str = "doc_id", text_col: str = "text", range_bytes: int = 8 << 20) -> str:
    """Encode ``docs`` and write shard files in ascending ``order_col`` order; returns the folder.

    Rows are dealt to ranges of the order column of about ``range_bytes`` of text (null first; equal keys are
    ordered by their ids), and each range is written as shards of about as many ids, so neither a task nor a file
    grows with the input; a longer document has a shard of its own. File names sort in document order. An empty
    table writes no shard.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    width, _ = tokenizer_facts(tokenizer_path)
    rows = docs.select(F.col(order_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    bounds = range_bounds(rows, "key", F.octet_length("text"), range_bytes)
    coded = encode_texts(rows.select("key", range_of(F.col("key"), bounds).cast("int").alias("range"), "text"), tokenizer_path, end_id)
    ordered = coded.repartition(len(bounds) + 1, "range").sortWithinPartitions("range", F.col("key").asc_nulls_first(), "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, lengths, done, at, part, total = [], [], [], [], None, 0, 0

        def flush() -> None:
            name = f"shard-{at:08d}-{part:06d}.bin"
            write_file(folder, name, pack_shard(keys, b"".join(ids), np.array(lengths, np.int64), width))
            done.append((name, len(lengths), sum(lengths)))
            for x in (keys, ids, lengths):
                x.clear()

        for batch in batches:
            for key, where, x in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(x) // width
                if ids and (where != at or total + n > range_bytes):
                    flush()
                    part, total = (part + 1 if where == at else 0), 0
                at = where
                keys.append(key)
                ids.append(x)
                lengths.append(n)
                total += n
        if ids:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["shard", "n_docs", "n_ids"])

    manifest = ordered.mapInArrow(write, "shard string, n_docs long, n_ids long")
    manifest.write.parquet(f"{folder}/_manifest")
    return folder


def read_token_store(spark, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the shard files alone.

    ``start`` is the number of ids of all documents before it. The prefix sums run over the manifest (one row
    per shard file), by range and inside each range, not over documents; shard files that are not in the manifest are
    not read. Boundaries and keys are read through select, a block of documents at a time.
    """
    manifest = spark.read.schema("shard string, n_docs long, n_ids long").parquet(f"{folder}/_manifest")
    ranges = manifest.select("shard", "n_ids", F.substring("shard", 1, 14).alias("range"))
    upto = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = ranges.groupBy("range").agg(F.sum("n_ids").alias("n_ids")).select(F.col("range").alias("r"), upto(Window.orderBy("range")).alias("base"))
    inside = ranges.select("shard", "range", upto(Window.partitionBy("range").orderBy("shard")).alias("more"))
    bases = inside.join(F.broadcast(whole), F.col("range") == F.col("r")).select("shard", (F.col("base") + F.col("more")).alias("first_id"))
    schema = "shard string, doc_id long, at long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_buffer().to_pybytes())
                for first in range(0, shard.n, BLOCK):
                    count = min(BLOCK, shard.n - first)
                    at = shard.starts(first, count)
                    crcs = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * count), pa.array(shard.keys(first, count), pa.int64()), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").option("recursiveFileLookup", "false").load(folder)
    rows = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("shard"), "content").mapInArrow(read, schema)
    return rows.join(bases, "shard").select("doc_id", (F.col("first_id") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
