"""Bodies of any size, read by several tasks and cut between jobs.

A body ``{"jobs": [...]}`` of many gigabytes is one JSON value, but where a job ends can
be told from the marks alone: quotes, brackets and commas. The text reader cuts a file at
the character ``}``, so every task gets a range of the file as records. Three steps:

1. Each range is summed up: how quotes and brackets change the state of whoever reads
   across it, for both states it may begin in (inside a string or not).
2. The sums of a file, one small row a range, are folded in order. That gives the state at
   the beginning of every range: inside a string, how deep, inside the list of jobs.
3. With it every range gives the jobs that lie whole in it, and pieces of those that do not.
   Pieces meet by a shuffle, two a range at most; whole jobs are never moved.

What is left of a body without its jobs is the row of the body itself. It tells whether
the rest is sound, so ``job_rows`` finds the same rejects as in a body read as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sift.params import Board

#: Text that is looked through at once.
SLICE_BYTES = 1 << 20
#: States of so many ranges are broadcast; of more, files are taken in portions.
MAX_RANGES = 500_000

END = b"}"
OPENS = re.compile(rb'"jobs"[ \t\r\n]*:[ \t\r\n]*\[')
WHOLE, HEAD, MIDDLE, TAIL, REST = range(5)

_SUM = "landed string, token string, at bigint, size bigint, file_size bigint, parity int, delta array<bigint>, lowest array<bigint>, open array<array<bigint>>"
_PART = "token string, landed string, at bigint, n bigint, kind int, text string, begins boolean, ends boolean"


# ---- marks --------------------------------------------------------------------


@dataclass
class Marks:
    """Quotes, brackets and commas of some text; ``inside`` holds if it begins outside a string."""

    quote: np.ndarray
    inside: np.ndarray
    step: np.ndarray
    comma: np.ndarray


def marks(data: np.ndarray) -> Marks:
    """A quote counts unless an odd number of backslashes stands before it."""
    quote = data == 0x22
    back = data == 0x5C
    if back.any():
        place = np.arange(len(data))
        last = np.maximum.accumulate(np.where(back, -1, place))
        run = place - 1 - np.concatenate([[-1], last[:-1]])
        quote &= run % 2 == 0
    upto = np.cumsum(quote, dtype=np.int64)
    inside = ((upto - quote) & 1).astype(bool)
    step = ((data == 0x7B) | (data == 0x5B)).astype(np.int8) - ((data == 0x7D) | (data == 0x5D)).astype(np.int8)
    return Marks(quote, inside, step, data == 0x2C)


def list_opens(data: bytes, found: Marks, outside: np.ndarray) -> np.ndarray:
    """Where the brackets are that open a list named ``jobs``."""
    spans = [(m.start(), m.end() - 1) for m in OPENS.finditer(data)]
    return np.array([e for s, e in spans if found.quote[s] and outside[s] and outside[e]], dtype=np.int64)


def slices(records: list[bytes], size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Runs of whole records of about ``size`` bytes."""
    own, held = [], 0
    for record in records:
        own.append(record)
        held += len(record) + 1
        if held >= size:
            yield own
            own, held = [], 0
    if own:
        yield own


# ---- sums of ranges -----------------------------------------------------------


@dataclass
class Sum:
    """What reading a range does, for each state (0 outside a string, 1 inside) it may begin in.

    ``open`` holds how deep, relative to the beginning, lists named ``jobs`` were opened
    that are still open at the end; ``lowest`` the least depth that was reached.
    """

    size: int = 0
    parity: int = 0
    delta: list[int] = field(default_factory=lambda: [0, 0])
    lowest: list[int] = field(default_factory=lambda: [0, 0])
    open: list[list[int]] = field(default_factory=lambda: [[], []])

    def add(self, data: bytes) -> None:
        raw = np.frombuffer(data, dtype=np.uint8)
        found = marks(raw)
        for begin in (0, 1):
            # The text may itself begin in the state that the range has come to.
            outside = found.inside if begin ^ self.parity else ~found.inside
            steps = np.where(outside, found.step, 0)
            depth = self.delta[begin] + np.cumsum(steps, dtype=np.int64)
            least = int(depth.min(initial=self.delta[begin]))
            opened = [(p, int(depth[p]) - 1) for p in list_opens(data, found, outside)]
            still = [d for p, d in opened if int(depth[p:].min()) > d]
            self.open[begin] = [d for d in self.open[begin] if d < least] + still
            self.lowest[begin] = min(self.lowest[begin], least)
            self.delta[begin] = int(depth[-1]) if len(depth) else self.delta[begin]
        self.parity ^= int(found.quote.sum()) & 1
        self.size += len(data)


def _ranges(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[bytes]]]:
    """Runs of records of one range: the first ``keys`` columns, which name it, and the texts."""
    for batch in batches:
        named = [batch.column(k) for k in range(keys)]
        texts = batch.column(keys).cast(pa.binary())
        rows = batch.num_rows
        start, file = batch.column(1).to_numpy(), batch.column(0).dictionary_encode().indices.to_numpy()
        cut = np.flatnonzero((start[1:] != start[:-1]) | (file[1:] != file[:-1])) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), rows]):
            if hi > lo:
                yield tuple(c[lo].as_py() for c in named), texts.slice(lo, hi - lo).to_pylist()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("landed", pa.string()), ("token", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("file_size", pa.int64()), ("parity", pa.int32()), ("delta", pa.list_(pa.int64())), ("lowest", pa.list_(pa.int64())), ("open", pa.list_(pa.list_(pa.int64())))])

    def row(key: tuple, own: Sum) -> pa.RecordBatch:
        landed, at, token, file_size = key
        values = [landed, token, at, own.size, file_size, own.parity, own.delta, own.lowest, own.open]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)

    key, own = None, Sum()
    for found, records in _ranges(batches, 4):
        if found != key:
            if key is not None:
                yield row(key, own)
            key, own = found, Sum()
        for part in slices(records):
            own.add(END.join(part) + END)
    if key is not None:
        yield row(key, own)


def range_states(sums: DataFrame) -> DataFrame:
    """``landed, at`` and the state at the beginning of each range, and how its file ends.

    A file's rows are folded in order: a few numbers for each of its ranges.
    """
    fields = ["at", "size", "parity", "delta", "lowest", "open"]
    own = F.array_sort(F.collect_list(F.struct(*fields)))
    files = sums.groupBy("landed").agg(own.alias("sums"), F.first("file_size").alias("file_size"), F.sum("size").alias("total"))
    start = F.struct(
        F.lit(0).alias("inside"), F.lit(0).cast("bigint").alias("depth"), F.lit(False).alias("listed"),
        F.array().cast("array<struct<at: bigint, inside: int, depth: bigint, listed: boolean>>").alias("states"),
    )

    def step(state: Column, x: Column) -> Column:
        which = state["inside"]
        delta, lowest, opened = (F.get(x[c], which) for c in ("delta", "lowest", "open"))
        # The list is the second level; it was left if the range came below that.
        stays = state["depth"] + lowest >= 2
        fresh = F.exists(opened, lambda d: d + state["depth"] == 1)
        here = F.struct(x["at"].alias("at"), which.alias("inside"), state["depth"].alias("depth"), state["listed"].alias("listed"))
        return F.struct(
            which.bitwiseXOR(x["parity"]).alias("inside"), (state["depth"] + delta).alias("depth"),
            F.when(stays, state["listed"]).otherwise(fresh).alias("listed"), F.concat(state["states"], F.array(here)).alias("states"),
        )

    folded = files.select("landed", F.aggregate("sums", start, step)["states"].alias("states"), (F.col("total") == F.col("file_size")).alias("closed"))
    # The last record of a file has no end of its own unless the sizes say so.
    last = F.element_at("states", -1)["at"].alias("last")
    return folded.select("landed", "closed", last, F.explode("states").alias("s")).select("landed", "s.*", (F.col("closed") | (F.col("s.at") < F.col("last"))).alias("closed"))


# ---- jobs ---------------------------------------------------------------------


class Cutter:
    """Cuts the text of a range into jobs, pieces of jobs, and what is not in the list."""

    def __init__(self, inside: int, depth: int, listed: bool) -> None:
        self.inside, self.depth, self.listed = inside, depth, listed
        # The job begun before this range, until its end is met.
        self.headless = listed
        self.begins = False
        self.job: list[bytes] = []
        self.rest: list[bytes] = []

    def _closed(self, ends: bool) -> tuple[int, bytes, bool, bool]:
        kind = HEAD if self.headless else WHOLE
        out = (kind, b"".join(self.job), self.begins, ends)
        self.job, self.headless, self.begins = [], False, False
        return out

    def add(self, data: bytes) -> Iterator[tuple[int, bytes, bool, bool]]:
        """Jobs that end here: their kind, text, and whether they are the list's first and last."""
        raw = np.frombuffer(data, dtype=np.uint8)
        found = marks(raw)
        outside = found.inside if self.inside else ~found.inside
        depth = self.depth + np.cumsum(np.where(outside, found.step, 0), dtype=np.int64)
        opens = list_opens(data, found, outside)
        opens = opens[depth[opens] == 2]
        commas = np.flatnonzero(found.comma & outside & (depth == 2))
        closes = np.flatnonzero(outside & (found.step < 0) & (depth == 1))
        events = sorted([(p, 0) for p in opens.tolist()] + [(p, 1) for p in commas.tolist()] + [(p, 2) for p in closes.tolist()])
        done = 0
        for place, what in events:
            if what == 0 and not self.listed:
                self.rest.append(data[done : place + 1])
                self.listed, self.begins, done = True, True, place + 1
            elif what and self.listed:
                self.job.append(data[done:place])
                yield self._closed(ends=what == 2)
                done = place + (what == 1)
                self.listed = what == 1
        (self.job if self.listed else self.rest).append(data[done:])
        self.inside ^= int(found.quote.sum()) & 1
        self.depth = int(depth[-1]) if len(depth) else self.depth

    def end(self) -> Iterator[tuple[int, bytes, bool, bool]]:
        """The piece of a job that goes on in the next range, and what is not in the list."""
        if self.listed:
            yield (MIDDLE if self.headless else TAIL), b"".join(self.job), self.begins, False
        yield REST, b"".join(self.rest), False, False


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _PART.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]

    def rows(key: tuple, first: int, parts: list[tuple]) -> pa.RecordBatch:
        landed, at, token = key[:3]
        n = len(parts)
        kinds, texts, begins, ends = zip(*parts)
        columns = [[token] * n, [landed] * n, [at] * n, list(range(first, first + n)), kinds]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        # A character lies in one record, so texts are as sound as the file.
        return pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(begins), pa.array(ends)], names=names)

    key, cutter, n, held = None, None, 0, None

    def given(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        nonlocal n
        if parts:
            yield rows(key, n, parts)
            n += len(parts)

    def closed() -> Iterator[pa.RecordBatch]:
        parts = []
        if held is not None:
            parts += cutter.add(held + (END if key[6] else b""))
        yield from given([*parts, *cutter.end()])

    for found, records in _ranges(batches, 7):
        if found != key:
            if key is not None:
                yield from closed()
            if found[3] is None:
                raise ValueError("a file was cut in other places than before; fix spark.sql.files.minPartitionNum")
            key, cutter, n, held = found, Cutter(*found[3:6]), 0, None
        # One record is held back: only the last of a file may lack its end.
        records = records if held is None else [held, *records]
        held = records.pop()
        for part in slices(records):
            yield from given(list(cutter.add(END.join(part) + END)))
    if key is not None:
        yield from closed()


def _bodies(parts: DataFrame) -> DataFrame:
    """Rows ``token, landed, landed_pos, payload``: one a job, and one a file for what is left."""
    blank = F.trim(F.regexp_replace("text", r"[\t\r\n]", " ")) == ""
    # A list without jobs is not a job; a gap between commas makes the body invalid.
    job = parts.where(~(blank & F.col("begins") & F.col("ends")))
    payload = F.concat(F.lit('{"jobs":['), F.when(blank, F.lit(",")).otherwise(F.col("text")), F.lit("]}"))
    return job.select("token", "landed", (F.col("at") + F.col("n")).alias("landed_pos"), payload.alias("payload"))


def _glued(parts: DataFrame) -> DataFrame:
    """Jobs from their pieces: each begins with a tail and takes what follows up to a head."""
    pieces = parts.where(F.col("kind").isin(HEAD, MIDDLE, TAIL))
    order = Window.partitionBy("landed").orderBy("at", "n")
    number = F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order)
    piece = F.struct("at", "n", "text", "begins", "ends")
    jobs = pieces.withColumn("job", number).groupBy("token", "landed", "job").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    first = F.get("p", F.lit(0))
    return jobs.select("token", "landed", first["at"].alias("at"), first["n"].alias("n"), text.alias("text"), first["begins"].alias("begins"), F.element_at("p", -1)["ends"].alias("ends"))


def _left(parts: DataFrame) -> DataFrame:
    """Bodies without their jobs."""
    rest = parts.where(F.col("kind") == REST)
    texts = F.array_sort(F.collect_list(F.struct("at", "text")))
    files = rest.groupBy("token", "landed").agg(texts.alias("p"))
    payload = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return files.select("token", "landed", F.lit(-1).cast("bigint").alias("landed_pos"), payload.alias("payload"))


def _files(spark: SparkSession, path: str, boards: Sequence[Board] | None) -> DataFrame:
    # Both readings must cut the files alike, also when executors come and go between.
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    reader = spark.read.format("text").schema("value string, board string").option("lineSep", END.decode())
    files = reader.load(path)
    if boards is not None:
        files = files.where(F.col("board").isin(sorted({b.token for b in boards})))
    place = F.col("_metadata.file_path").alias("landed"), F.col("_metadata.file_block_start").alias("at")
    return files.select(*place, F.col("board").alias("token"), F.col("_metadata.file_size").alias("file_size"), F.col("value"))


def read_split_bodies(spark: SparkSession, path: str, boards: Sequence[Board] | None = None) -> DataFrame:
    """Bodies landed as ``<path>/board=<token>/<name>.json``, one job a row, whatever their size.

    Gives the columns of a landed payload: each row holds a body of one job, and one row a
    file what the body is without its jobs (``landed_pos`` -1). Places grow along a file.
    Files must not be compressed, or one task reads each. The sums of the ranges are made
    when this is called; reading the result reads the files again, once for whole jobs
    and once for pieces.

    A body that is broken off or holds a job that is no JSON gives rejects, as when it is
    read whole; its other jobs are rows all the same, which matters to ``quarantine``
    alone. Of two lists named ``jobs`` in one body both are read.
    """
    files = _files(spark, path, boards)
    # Kept while their number is told and the states are made of them.
    sums = files.mapInArrow(_summed, _SUM).persist()
    try:
        portions = -(-sums.count() // MAX_RANGES) or 1
        states = range_states(sums)
        portion = F.pmod(F.xxhash64("landed"), F.lit(portions))
        shares = [states.where(portion == k).collect() for k in range(portions)]
    finally:
        sums.unpersist()
    found = [_split(files.where(portion == k), spark.createDataFrame(rows, states.schema)) for k, rows in enumerate(shares)]
    return reduce(DataFrame.unionByName, found)


def _split(files: DataFrame, states: DataFrame) -> DataFrame:
    """The rows of files, given the state at the beginning of each of their ranges."""
    known = files.join(F.broadcast(states), ["landed", "at"], "left")
    parts = known.select("landed", "at", "token", "inside", "depth", "listed", "closed", "value").mapInArrow(_cut, _PART)
    whole = parts.where(F.col("kind") == WHOLE)
    jobs = _bodies(whole.select("token", "landed", "at", "n", "text", "begins", "ends").unionByName(_glued(parts)))
    return jobs.unionByName(_left(parts))
