"""Near-duplicates by one-permutation MinHash with optimal densification.

A document's set holds its distinct shingles of five words. One permutation deals
the set into bins and keeps the least value of each; an empty bin borrows from a
bin that a fixed hash picks for it (optimal densification). A few bins make a band,
and documents that agree in a band meet in its bucket. There every member is
compared with one centre only, so a bucket of m members gives m - 1 pairs. A band is
as many bins as still leave a pair at the threshold without a common band less than
once in 200,000 times.

Documents with equal sets are one node, so thousands of copies cost one member.
The first pass takes the same centre in all bands, which makes its pairs coincide.
Later passes look only at buckets that still hold several components, and take other
centres, three in every band: two documents above the threshold share about a third
of the buckets, and a pair is tested as soon as either is a centre in one of them. Passes
end when one joins no two components. Buckets that hold several components even then are
finished exactly: all pairs of their members in different components are compared, in
tiles of two salted blocks each, so a crowded bucket spreads over tasks. Every link is
confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.llm import frames
from sift.llm.byte_bpe import ragged
from sift.llm.components import components
from sift.llm.words import SPACES, Texts, chunks, mix, sequence_hash, split_words, texts_of, window_hash

SHINGLE = 5
BINS = 256
#: Chance that a pair exactly at the threshold shares no band.
MISSED = 5e-6
#: Centres of a bucket in every pass but the first.
CENTRES = 3
#: Full sets in a block of a bucket that is finished exactly; a tile compares two blocks.
BLOCK_BYTES = 4 << 20
#: So many ids (16 MB) may be broadcast after they were counted; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_U = np.uint64
_SHIFT = _U(64 - BINS.bit_length() + 1)


def rows_per_band(percent: int) -> int:
    """As many bins a band as keep the chance of a miss at the threshold under ``MISSED``."""
    similar = percent / 100
    fits = [r for r in range(1, 17) if (1 - similar**r) ** (BINS // r) <= MISSED]
    return max(fits, default=1)


def shingle_sets(texts: Texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words = split_words(texts, SPACES, fold=True)
    value = window_hash(words, SHINGLE)
    out = []
    for s, e in zip(words.first[:-1], words.first[1:]):
        if e - s >= SHINGLE:
            own = np.sort(value[s : e - SHINGLE + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif e > s:
            out.append(np.array([sequence_hash(words.hash[s:e])]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def densified(sets: list[np.ndarray]) -> np.ndarray:
    """The least value per bin and set; the bin is the leading bits of a value."""
    edges = np.arange(BINS, dtype=np.uint64) << _SHIFT
    least = np.zeros((len(sets), BINS), dtype=np.uint64)
    empty = np.ones((len(sets), BINS), dtype=bool)
    for i, own in enumerate(sets):
        if len(own):
            at = np.searchsorted(own, edges)
            value = own[np.minimum(at, len(own) - 1)]
            empty[i] = (at == len(own)) | (value >> _SHIFT != np.arange(BINS, dtype=np.uint64))
            least[i] = value
    full = ~empty
    row, bin_ = np.nonzero(empty & full.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        pick = mix(bin_.astype(np.uint64) * _U(1 << 20) + _U(attempt)) >> _SHIFT
        pick = pick.astype(np.int64)
        hit = full[row, pick]
        least[row[hit], bin_[hit]] = least[row[hit], pick[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return least


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """One key per band, different for different bands."""
    bands = BINS // rows
    groups = least[:, : bands * rows].reshape(len(least), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), groups.shape[:2]).copy()
    for k in range(rows):
        key = mix(key ^ groups[:, :, k])
    return key.view(np.int64)


def set_names(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits that name a set."""
    out = []
    for own in sets:
        twice = np.array([mix(own).sum(), mix(own ^ _U(0x5851F42D4C957F2D)).sum() + _U(len(own))], dtype=np.uint64)
        out.append(twice.tobytes())
    return out


def _nested(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _sketches(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in chunks(texts_of(batch.column(1))):
                sets = shingle_sets(part)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                keys = band_keys(densified(sets)[size > 0], rows)
                bands = np.where(size > 0, keys.shape[1], 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(set_names(sets)), _nested(keys.ravel(), bands)],
                    names=["doc_id", "n_shingles", "node", "bands"],
                )

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of texts, where they are the sets that were asked for."""
    for batch in batches:
        for lo, hi, part in chunks(texts_of(batch.column(1))):
            asked = batch.column(0).slice(lo, hi - lo).to_pylist()
            sets = shingle_sets(part)
            right = [(name, own) for name, own, want in zip(set_names(sets), sets, asked) if name == want]
            values = np.concatenate([*(own for _, own in right), np.zeros(0, dtype=np.uint64)]).view(np.int64)
            lengths = np.array([len(own) for _, own in right], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name for name, _ in right], pa.binary()), _nested(values, lengths)], names=["node", "items"])


def _joined(df: DataFrame, keys: DataFrame, column: str, how: str) -> DataFrame:
    """A join on ``column``; few ``keys`` are broadcast, once counted."""
    if keys.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    return df.join(keys, column, how)


def _candidates(buckets: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """Pairs ``a, b`` of a member and a centre of its bucket, where their labels differ."""
    if labels is None:
        member = buckets.withColumn("label", F.col("node"))
    else:
        member = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ranks = [F.xxhash64("node")] if turn == 1 else [F.xxhash64("node", "band", F.lit(CENTRES * turn + k)) for k in range(CENTRES)]
    one = F.struct("node", "doc_id", "n_shingles", "label")
    centre = member.groupBy("band").agg(
        F.array(*(F.min(F.struct(rank.alias("rank"), one.alias("one"))) for rank in ranks)).alias("centres"),
        F.min("label").alias("low"), F.max("label").alias("high"),
    ).where("low <> high")
    pair = member.join(centre.select("band", "centres"), "band")
    pair = pair.select(one.alias("x"), F.explode("centres.one").alias("y")).where("x.label <> y.label")
    return pair.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("total"))
    return joined.where(100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).select("a", "b")


def _open_tiles(buckets: DataFrame, nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the buckets that hold untested pairs of several labels, once a tile.

    A bucket of two was tested by the first pass. ``own`` is the member's block, ``i``
    and ``j`` are the blocks of the tile.
    """
    member = buckets.withColumn("label", F.col("node"))
    if labels is not None:
        member = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    left = member.groupBy("band").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"), F.sum("n_shingles").alias("total")
    ).where("low <> high and members > 2").select("band", F.ceil(8 * F.col("total") / BLOCK_BYTES).alias("blocks"))
    member = member.join(left, "band").withColumn("own", F.pmod(F.xxhash64("node", F.lit(0)), "blocks"))
    member = member.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    tile = member.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "doc_id", "label")
    return tile.join(nodes.select("node", "bands"), "node")


def _tile_links(percent: int):
    """Links between different labels among the pairs of a tile.

    A pair that meets in several buckets is compared in the first of them only.
    """

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        n = tile.num_rows
        items = tile.column("items").combine_chunks()
        offsets = items.offsets.to_numpy().astype(np.int64)
        offsets, flat = offsets - offsets[0], items.values.to_numpy()[offsets[0] : offsets[-1]]
        size = np.diff(offsets)
        values, number = np.unique(flat, return_inverse=True)
        bands = tile.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)
        own, cross = tile.column("own").to_numpy(), tile.column("i")[0] != tile.column("j")[0]
        names = tile.column("node").to_pylist()
        place = {name: k for k, name in enumerate(dict.fromkeys(tile.column("label").to_pylist()))}
        label = np.array([place[name] for name in tile.column("label").to_pylist()])
        here = np.flatnonzero(bands[0] == tile.column("band")[0].as_py())[0]
        holds = np.zeros(len(values), dtype=bool)
        a, b = [], []
        for x in range(n - 1):
            y = np.arange(x + 1, n)
            fits = (label[y] != label[x]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
            if cross:
                fits &= own[y] != own[x]
            y = y[fits]
            y = y[~(bands[y, :here] == bands[x, :here]).any(axis=1)]
            if not len(y):
                continue
            mine = number[offsets[x] : offsets[x + 1]]
            holds[mine] = True
            at, length = ragged(offsets, y)
            both = np.add.reduceat(holds[number[at]], np.cumsum(length) - length, dtype=np.int64)
            holds[mine] = False
            for k in y[100 * both >= percent * (size[x] + length - both)]:
                if label[k] != label[x]:
                    label[label == label[k]] = label[x]
                    a.append(names[x])
                    b.append(names[k])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _finished(buckets: DataFrame, nodes: DataFrame, texts: DataFrame, labels: DataFrame | None, percent: int, folder: str, turn: int) -> DataFrame | None:
    """The labels after all untested pairs of every bucket were compared."""
    tiles = frames.stored(_open_tiles(buckets, nodes, labels), folder, "tiles")
    ends = frames.stored(tiles.select("doc_id", "node").distinct(), folder, "tile_ends", few=True)
    if ends.isEmpty():
        return labels
    asked = _joined(texts, ends, "doc_id", "inner").select("node", "text")
    sets = frames.stored(asked.mapInArrow(_full_sets, "node binary, items array<bigint>"), folder, "tile_sets")
    rows = tiles.join(sets, "node").select("band", "i", "j", "own", "node", "label", "bands", "items")
    found = frames.stored(rows.groupBy("band", "i", "j").applyInArrow(_tile_links(percent), "a binary, b binary"), folder, "tile_links")
    frames.remove(texts.sparkSession, f"{folder}/tile_sets")
    return labels if found.isEmpty() else merged(labels, found, folder, turn)


def merged(labels: DataFrame | None, links: DataFrame, folder: str, turn: int) -> DataFrame:
    """The labels of all linked nodes, after new ``links`` (``a, b``) between components.

    The links are first drawn between the labels, so that a late pass works on a graph
    as small as what it has found.
    """
    if labels is None:
        return components(links, f"{folder}/graph{turn}")
    for end in ("a", "b"):
        known = labels.withColumnRenamed("node", end)
        links = links.join(known, end, "left").withColumn(end, F.coalesce("label", end)).select("a", "b")
    fresh = components(links, f"{folder}/graph{turn}")
    renamed = fresh.select(F.col("node").alias("label"), F.col("label").alias("new"))
    old = labels.join(renamed, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return frames.stored(old.unionByName(fresh.join(labels, "node", "left_anti")), folder, f"labels{turn}", few=True)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``percent`` is the least similarity (100 * intersection / union) of a link.
    Null and blank texts have an empty set, link with nothing and are kept. Rows that
    repeat a ``doc_id`` are one node each and come out as often as they came in. A row
    without ``doc_id`` cannot be named: it takes part in no link, its ``component_id``
    is null and it is kept. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = frames.scratch(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    sketch = texts.mapInArrow(_sketches(rows_per_band(percent)), f"doc_id {kind}, n_shingles bigint, node binary, bands array<bigint>")
    sketch = frames.stored(sketch, folder, "sketch")
    named = sketch.where("n_shingles > 0 and doc_id is not null")
    nodes = named.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
    )
    nodes = frames.stored(nodes, folder, "nodes")
    banded = nodes.select("node", "doc_id", "n_shingles", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select("band")
    buckets = frames.stored(banded.join(shared, "band", "left_semi"), folder, "buckets")

    tested, labels, turn = None, None, 0
    while True:
        turn += 1
        pairs = _candidates(buckets, labels, turn)
        few, many = F.least("a.n_shingles", "b.n_shingles"), F.greatest("a.n_shingles", "b.n_shingles")
        pairs = pairs.where(100 * few >= percent * many)
        pairs = pairs.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.first("a.doc_id").alias("doc_a"), F.first("b.doc_id").alias("doc_b"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = frames.stored(pairs, folder, f"pairs{turn}", few=True)
        if pairs.isEmpty():
            break
        ends = pairs.select(F.explode(F.array(F.struct(F.col("doc_a").alias("doc_id"), F.col("a").alias("node")), F.struct(F.col("doc_b").alias("doc_id"), F.col("b").alias("node")))).alias("e"))
        ends = frames.stored(ends.select("e.*").distinct(), folder, f"ends{turn}", few=True)
        asked = _joined(texts, ends, "doc_id", "inner").select("node", "text")
        sets = frames.stored(asked.mapInArrow(_full_sets, "node binary, items array<bigint>"), folder, f"sets{turn}")
        found = frames.stored(_confirmed(pairs, sets, percent), folder, f"found{turn}")
        frames.remove(spark, f"{folder}/sets{turn}")
        if found.isEmpty():
            break
        pairs = pairs.select("a", "b")
        tested = pairs if tested is None else tested.union(pairs)
        labels = merged(labels, found, folder, turn)
    labels = _finished(buckets, nodes, texts, labels, percent, folder, turn + 1)

    # Only classes of several documents need a join; every other row is its own class.
    grouped = nodes.select("node", "doc_id", "copies")
    if labels is not None:
        grouped = grouped.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("copies")).where("copies > 1")
        grouped = grouped.select("node", "label").join(least, "label")
    else:
        grouped = grouped.withColumnRenamed("doc_id", "component_id").where("copies > 1")
    classes = frames.stored(grouped.select("node", "component_id"), folder, "classes", few=True)
    out = sketch.select("doc_id", "n_shingles", "node").join(classes, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns: of each group of near-duplicates the smallest ``doc_id``.

    Rows that repeat a ``doc_id`` count as one document, and one row stays. Rows without
    ``doc_id``, and those without words, stay.
    """
    spark = docs.sparkSession
    folder = frames.scratch(spark)
    found = frames.stored(near_duplicates(docs, percent).select("doc_id", "kept"), folder, "decisions")
    dropped = found.where("not kept").select("doc_id").distinct()
    columns = [F.col(frames.quoted(c)) for c in docs.columns]
    left = _joined(docs, dropped, "doc_id", "left_anti").select(*columns)
    repeated = frames.stored(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), folder, "repeated")
    if repeated.isEmpty():
        return left
    return left.join(repeated, "doc_id", "left_anti").unionByName(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*columns)
