"""Token ids as files: canonical Huffman codes of limited length, in independent blocks.

Every distinct piece of a chunk of texts is encoded once by the tokenizers library;
the ids of all texts are counted, and the counts give one code for the whole corpus:
lengths by package-merge, at most ``MAX_BITS``, and canonical codes by (length, id).

The format. ``<folder>/codebook`` holds ``id, bits``: all that a canonical code needs.
``<folder>/blocks`` holds one row for each block, in Parquet files of ascending
``file``: ``file, block, first`` (tokens before it in its file), ``doc_ids`` and
``sizes`` (whole documents, in ascending ``doc_id`` order over all blocks and files),
``payload`` (the codes, high bit first, padded to a byte) and ``checkpoints``: the bit
offset of every ``CHECKPOINT``-th token of the block. A block is decoded alone, with
the code book; all of its checkpoints advance together through one lookup table.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.llm import frames
from sift.llm.byte_bpe import LONG_ENDINGS, NUMBER, SHORT_ENDINGS, SPACE, code_point_classes
from sift.llm.words import chunks, span_hash, texts_of

MAX_BITS = 20
BLOCK_TOKENS = 1 << 18
CHECKPOINT = 256
#: Distinct pieces whose ids a process remembers, about 30 bytes each.
KNOWN_PIECES = 1 << 19
#: Text tokenized at once.
CHUNK_BYTES = 1 << 20


# ---- tokens -------------------------------------------------------------------


class PieceEncoder:
    """Encodes texts piece by piece; equal to the library's encoding of whole texts.

    The library's normalizer (NFC, lower case by code point), its split into pieces and
    its byte alphabet are applied to all texts of a chunk; the library encodes all new
    pieces in one call, with spaces between, which its alphabet has not. With ``special``, the library's default, the file's added tokens are
    found in the texts as they are, before the normalizer, and have their own ids; without
    it (the library's ``encode_special_tokens``) special ones are text like any other.
    """

    def __init__(self, raw: str, special: bool = False) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.pieces = Tokenizer(Tokenizer.from_str(raw).model)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        added = [t for t in json.loads(raw).get("added_tokens") or [] if special or not t["special"]]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that are not matched literally are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.mark = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.alphabet = np.arange(256, dtype=np.uint32)
        self.alphabet[rest] = 256 + np.arange(len(rest))
        self._forget()

    def _forget(self) -> None:
        """Pieces met lately, by hash: their ids are ``flat[at:at + size]``."""
        self.key, self.flat = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.at, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> None:
        """Encode new pieces ``data[start:end]``, and remember them."""
        size = end - start + 1
        upto = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)
        points = self.alphabet[data[np.minimum(place, len(data) - 1)]]
        points[upto[1:] - 1] = 0x20
        found = self.pieces.encode(points.astype("<u4").tobytes().decode("utf-32-le"), add_special_tokens=False)
        count = np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(key))
        at = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, np.array(found.ids, dtype=np.int32)])
        order = np.argsort(np.concatenate([self.key, key]), kind="stable")
        self.key, self.at, self.size = (np.concatenate(p)[order] for p in ((self.key, key), (self.at, at), (self.size, count)))

    def _places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Where each distinct piece is among the known ones, after learning the new."""
        if len(self.key) + len(key) > KNOWN_PIECES:
            self._forget()
        slot = np.searchsorted(self.key, key)
        new = np.ones(len(key), dtype=bool)
        if len(self.key):
            new = self.key[np.minimum(slot, len(self.key) - 1)] != key
        if new.any():
            self._learn(data, start[new], end[new], key[new])
            slot = np.searchsorted(self.key, key)
        return slot

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (one more: the end)."""
        parts = [self.mark.split(t) if t and self.mark else [t] for t in texts]
        count = np.array([len(p) for p in parts], dtype=np.int64)
        if (count == 1).all():
            return self._plain(texts)
        # Texts and added tokens take turns; a token follows the ids of the text before it.
        ids, first = self._plain([t for p in parts for t in p[::2]])
        before = np.concatenate([[0], np.cumsum(count // 2 + 1)])
        tokens = [self.added[t] for p in parts for t in p[1::2]]
        after = np.concatenate([b + np.arange(1, n // 2 + 1) for b, n in zip(before[:-1], count)])
        bounds = first[before] + np.concatenate([[0], np.cumsum(count // 2)])
        return np.insert(ids, first[after], np.array(tokens, dtype=ids.dtype)), bounds

    def _plain(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        import unicodedata

        # A final sigma is lowered like any other, code point by code point.
        own = [unicodedata.normalize("NFC", t).replace("\u03a3", "\u03c3").lower() if t else "" for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in own], dtype=np.int64)])
        # A line end between texts belongs to no piece.
        whole = "\n".join([*own, ""])
        points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        if not len(points):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        start, end = _pieces(points)
        size = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        byte = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(whole.encode("utf-8"), dtype=np.uint8)
        low, high = byte[start], byte[end]
        key, sample, which = np.unique(span_hash(data, low, high), return_index=True, return_inverse=True)
        slot = self._places(data, low[sample], high[sample], key)[which]
        upto = np.concatenate([[0], np.cumsum(self.size[slot])])
        place = np.arange(upto[-1]) + np.repeat(self.at[slot] - upto[:-1], self.size[slot])
        return self.flat[place], upto[np.searchsorted(start, bounds)]


def _pieces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, single numbers, runs of other marks, and short endings; no space."""
    n = len(points)
    kind = code_point_classes()[points]
    cut = np.ones(n + 1, dtype=bool)
    cut[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    mark = np.flatnonzero(cut[:-1] & (points == 0x27))
    for endings in (SHORT_ENDINGS, LONG_ENDINGS):
        size = len(endings[0])
        at = mark[mark + size < n]
        fits = np.zeros(len(at), dtype=bool)
        for ending in endings:
            fits |= np.all([points[at + 1 + k] == ord(c) for k, c in enumerate(ending)], axis=0)
        at = at[fits]
        cut[at + 1] = False
        cut[at + 1 + size] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    word = kind[start] != SPACE
    return start[word], end[word]


_encoders: dict[str, PieceEncoder] = {}


def vocabulary_size(raw: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_str(raw).get_vocab(with_added_tokens=True).values(), default=-1) + 1


def id_type(vocabulary: int) -> str:
    """Two bytes an id where they are enough, else four; little-endian."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _binary(offsets: np.ndarray, ids: np.ndarray, kind: str) -> pa.Array:
    places = pa.py_buffer((offsets * np.dtype(kind).itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, places, pa.py_buffer(ids.astype(kind).tobytes())])


def _ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the ids of each row begin (one more: the end), and all of them."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, dtype=np.uint8)
    return (offsets - offsets[0]).astype(np.int64) // np.dtype(kind).itemsize, raw.view(kind)


def tokenized(docs: DataFrame, raw_text: str, end_id: int, kind: str) -> DataFrame:
    """``doc_id, place, ids``: the ids of every text and ``end_id``, as numbers of ``kind``.

    ``place`` tells rows apart.
    """
    raw = docs.sparkSession.sparkContext.broadcast(raw_text)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    doc_id = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if raw.value not in _encoders:
            _encoders[raw.value] = PieceEncoder(raw.value, special=True)
        encoder = _encoders[raw.value]
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, _ in chunks(texts_of(batch.column(1)), CHUNK_BYTES):
                ids, first = encoder.encode(batch.column(1).slice(lo, hi - lo).to_pylist())
                n = hi - lo
                full = np.insert(ids, first[1:], end_id)
                offsets = first + np.arange(n + 1)
                places = pa.array(np.arange(place, place + n))
                place += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), places, _binary(offsets, full, kind)],
                    names=["doc_id", "place", "ids"],
                )

    return rows.mapInArrow(run, f"doc_id {doc_id}, place bigint, ids binary")


def id_counts(tokens: DataFrame, kind: str) -> dict[int, int]:
    """How often every id occurs; as many rows as the vocabulary has ids reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            own = np.bincount(_ids(batch.column(0), kind)[1])
            if len(own) > len(total):
                own, total = total, own
            total = total.copy()
            total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    counted = tokens.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return {row["id"]: row["n"] for row in counted.collect()}


# ---- code ---------------------------------------------------------------------


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits, by package-merge.

    A list of packages is as long as the alphabet, so the work is about
    ``limit`` times its size.
    """
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    if len(symbols) < 2:
        return dict.fromkeys(symbols, 1)
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} ids need codes longer than {limit} bits")
    weight = np.array([counts[s] for s in symbols], dtype=np.float64)
    single = [(w, k) for k, w in enumerate(weight.tolist())]
    # Of every level it is kept which of its items are packages, in order of weight.
    levels, packages = [], []
    for _ in range(limit):
        merged = list(heapq.merge(single, packages))
        levels.append(merged)
        packages = [(merged[i][0] + merged[i + 1][0], len(symbols)) for i in range(0, len(merged) - 1, 2)]
    lengths = np.zeros(len(symbols), dtype=np.int64)
    take = 2 * len(symbols) - 2
    for merged in reversed(levels):
        chosen = [k for _, k in merged[:take]]
        singles = [k for k in chosen if k < len(symbols)]
        lengths[singles] += 1
        take = 2 * (len(chosen) - len(singles))
    return dict(zip(symbols, lengths.tolist()))


@dataclass
class Code:
    """A canonical code: per id its bits and their number, and a table over ``width`` bits."""

    code: np.ndarray
    bits: np.ndarray
    width: int
    table_id: np.ndarray
    table_bits: np.ndarray


def canonical(lengths: dict[int, int]) -> Code:
    """Codes counted up in the order of (length, id)."""
    size = max(lengths, default=-1) + 1
    code, bits = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    width = max(lengths.values(), default=1)
    table_id, table_bits = np.zeros(1 << width, dtype=np.int32), np.ones(1 << width, dtype=np.int64)
    value, last = 0, 0
    for symbol in sorted(lengths, key=lambda s: (lengths[s], s)):
        n = lengths[symbol]
        value <<= n - last
        code[symbol], bits[symbol], last = value, n, n
        low, high = value << (width - n), (value + 1) << (width - n)
        table_id[low:high], table_bits[low:high] = symbol, n
        value += 1
    return Code(code, bits, width, table_id, table_bits)


def pack(ids: np.ndarray, code: Code) -> tuple[bytes, np.ndarray]:
    """The codes of ``ids`` one after another, and the bit offset of every checkpoint.

    Slices of ``BLOCK_TOKENS`` are spelled out at a time: a document is never split over
    blocks, and a long one makes a long block.
    """
    bits, checkpoints, before = [np.zeros(0, dtype=np.uint8)], [np.zeros(0, dtype=np.int64)], 0
    step = -(-BLOCK_TOKENS // CHECKPOINT) * CHECKPOINT
    for lo in range(0, len(ids), step):
        own = ids[lo : lo + step]
        size = code.bits[own]
        end = np.cumsum(size)
        shift = np.repeat(end, size) - np.arange(end[-1]) - 1
        bits.append(((np.repeat(code.code[own], size) >> shift) & 1).astype(np.uint8))
        checkpoints.append(before + (end - size)[::CHECKPOINT])
        before += int(end[-1])
    return np.packbits(np.concatenate(bits)).tobytes(), np.concatenate(checkpoints)


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, code: Code) -> np.ndarray:
    """The ``n`` ids of a block; the runs between checkpoints are decoded side by side."""
    data = np.frombuffer(payload + bytes(8), dtype=np.uint8).astype(np.int64)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((CHECKPOINT, len(at)), dtype=np.int32)
    mask = (1 << code.width) - 1
    last = len(window) - 1
    for step in range(min(CHECKPOINT, n)):
        look = (window[np.minimum(at >> 3, last)] >> (32 - code.width - (at & 7))) & mask
        out[step] = code.table_id[look]
        at += code.table_bits[look]
    return out.T.ravel()[:n]


# ---- files --------------------------------------------------------------------


def write_files(tokens: DataFrame, folder: str, kind: str) -> None:
    """Write ``tokens`` (``doc_id, place, ids`` as numbers of ``kind``) below ``folder`` in the format above.

    Rows are sorted by ``doc_id``, null first, then ``place``: the ranges and the order
    within them spread over the cluster, and many rows of one id over several ranges.
    """
    spark = tokens.sparkSession
    lengths = code_lengths(id_counts(tokens, kind))
    book = spark.createDataFrame(sorted(lengths.items()), "id int, bits int")
    book.coalesce(1).write.mode("overwrite").parquet(f"{folder}/codebook")
    code = spark.sparkContext.broadcast(lengths)
    doc_id = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = canonical(code.value)
        file, block, first = TaskContext.get().partitionId(), 0, 0
        docs, sizes, parts, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            payload, checkpoints = pack(ids, book)
            own = pa.chunked_array(docs).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (own, pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(checkpoints))]
            row = [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), *lists[:2], pa.array([payload], pa.binary()), lists[2]]
            return pa.RecordBatch.from_arrays(row, names=["file", "block", "first", "doc_ids", "sizes", "payload", "checkpoints"])

        for batch in batches:
            offsets, ids = _ids(batch.column(1), kind)
            lo = 0
            while lo < batch.num_rows:
                # Whole documents until the block is full.
                hi = int(np.searchsorted(offsets[1:], offsets[lo] + BLOCK_TOKENS - held)) + 1
                hi = min(hi, batch.num_rows)
                docs.append(batch.column(0).slice(lo, hi - lo))
                sizes.append(np.diff(offsets[lo : hi + 1]))
                parts.append(ids[offsets[lo] : offsets[hi]])
                held += int(offsets[hi] - offsets[lo])
                lo = hi
                if held >= BLOCK_TOKENS:
                    yield closed()
                    block, first = block + 1, first + held
                    docs, sizes, parts, held = [], [], [], 0
        if held:
            yield closed()

    ranged = tokens.repartitionByRange(F.col("doc_id").asc_nulls_first(), "place")
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "place").select("doc_id", "ids")
    fields = f"file int, block int, first bigint, doc_ids array<{doc_id}>, sizes array<int>, payload binary, checkpoints array<bigint>"
    ranged.mapInArrow(run, fields).write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of every document in files of the format above.

    ``start`` counts the ids of all documents before it. Only one number for each file
    reaches the driver.
    """
    lengths = {row["id"]: row["bits"] for row in spark.read.parquet(f"{folder}/codebook").collect()}
    code = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{folder}/blocks")
    tokens = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    totals = blocks.groupBy("file").agg(F.sum(tokens).alias("n")).orderBy("file").collect()
    before, base = 0, {}
    for row in totals:
        base[row["file"]] = before
        before += row["n"]
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = canonical(code.value)
        for batch in batches:
            for i in range(batch.num_rows):
                file, first, docs, sizes, payload, checkpoints = (batch.column(k)[i] for k in range(6))
                size = sizes.values.to_numpy(zero_copy_only=False).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(size)])
                ids = unpack(payload.as_py(), checkpoints.values.to_numpy(zero_copy_only=False), int(offsets[-1]), book)
                start = base[file.as_py()] + first.as_py() + offsets[:-1]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(start), lists], names=["doc_id", "start", "ids"])

    own = blocks.select("file", "first", "doc_ids", "sizes", "payload", "checkpoints")
    return own.mapInArrow(run, f"doc_id {kind}, start bigint, ids array<int>")


def round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, start, ids`` of all ``docs``, encoded, written to files and read back.

    A null or empty text has the end id alone. Rows that repeat a ``doc_id`` all stay,
    next to each other; rows without one come first. Other columns are ignored. An
    empty table gives an empty code book, no blocks and no rows. ``path`` names a
    tokenizer file on the driver; its text is sent to the tasks.
    """
    folder = frames.scratch(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    kind = id_type(max(vocabulary_size(raw), end_id + 1))
    tokens = frames.stored(tokenized(docs, raw, end_id, kind), folder, "tokens")
    write_files(tokens, folder, kind)
    return read_files(docs.sparkSession, folder)


def checked(found: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of ``doc_id, start, ids``."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            size = np.diff(offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return found.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
