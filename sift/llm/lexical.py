"""Ranked lexical search by two trees, one over the queries and one over the documents.

Documents become sparse vectors of their impacts: for each term of the query set how much
an occurrence pattern is worth there. Queries are sparse vectors of term weights, and a
score is the product of both. Queries and documents are ordered by halving, like with
like, and nodes above them hold the greatest value of every coordinate. The product of two
nodes' maxima bounds every score between them, so a pair of nodes whose bound lies below
the least of its queries' weakest kept scores is left out whole: no document in it can
be among the best of any of these queries. What is left is scored exactly, in numbers
that hold every sum exactly.

A task keeps the best documents of each query it has met, which raises the bounds as it
goes on. It starts from the scores that the best of a share of all documents reach: no
lower score can be among the best of all, so a task returns few rows besides, and
their number does not grow with the number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sift.llm import frames
from sift.llm.words import LOWER, NOT_ALNUM, Texts, chunks, split_words, texts_of

#: Query text that is searched for in one pass over the documents; more takes several.
ITEM_BYTES = 8 << 20
#: Queries of one root; its node and its documents' are compared first.
ROOT_ITEMS = 512
#: Documents of one root at most, and cells (documents by terms in them) of its matrix.
ROOT_DOCS, ROOT_CELLS = 1024, 1 << 22
#: Children of a node, in both trees.
FAN = 8
#: Times a set is halved anew along the difference of its halves.
ROUNDS = 4
#: One document in so many is searched first, for scores to start from.
SEED_SHARE = 64

LARGEST = np.iinfo(np.int64).max
#: Sums below are exact in doubles.
EXACT = 1 << 53


# ---- terms ----------------------------------------------------------------------


@dataclass
class Lexicon:
    """Terms of the queries: their bytes, in the order of their hashes."""

    key: np.ndarray
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def __len__(self) -> int:
        return len(self.key)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The term that each lower-cased ``data[start:end]`` is, -1 if none.

        The hash names the candidates, the bytes decide.
        """
        found = np.full(len(key), -1, dtype=np.int64)
        if not len(self.key):
            return found
        slot = np.searchsorted(self.key, key)
        open_ = np.arange(len(key))
        while len(open_):
            at = np.minimum(slot[open_], len(self.key) - 1)
            alike = (slot[open_] < len(self.key)) & (self.key[at] == key[open_])
            open_, at = open_[alike], at[alike]
            size = self.size[at]
            same = size == end[open_] - start[open_]
            size = np.where(same, size, 0)
            upto = np.concatenate([[0], np.cumsum(size)])
            step = np.arange(upto[-1]) - np.repeat(upto[:-1], size)
            unlike = LOWER[data[np.repeat(start[open_], size) + step]] != self.data[np.repeat(self.start[at], size) + step]
            same[np.searchsorted(upto, np.flatnonzero(unlike), side="right") - 1] = False
            found[open_[same]] = at[same]
            # Another term may have the same hash.
            open_ = open_[~same]
            slot[open_] += 1
        return found


@dataclass
class Items:
    """Queries as sparse rows of term numbers; those of query i are ``terms[first[i]:first[i + 1]]``."""

    ids: list
    first: np.ndarray
    terms: np.ndarray
    lexicon: Lexicon


def parse_items(ids: list, texts: list[str | None]) -> Items:
    """Rows of one id are one query, whose terms are those of all its texts, once each."""
    column = texts_of(pa.array(texts, pa.large_string()))
    words = split_words(column, NOT_ALNUM, fold=True)
    raw = LOWER[column.data].tobytes()
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first)).tolist()
    names = {name: n for n, name in enumerate(dict.fromkeys(ids))}
    held: list[set[bytes]] = [set() for _ in names]
    keys: dict[bytes, int] = {}
    for row, s, e, key in zip(owner, words.start.tolist(), words.end.tolist(), words.hash.tolist()):
        term = raw[s:e]
        keys[term] = key
        held[names[ids[row]]].add(term)
    terms = sorted(keys, key=lambda t: (keys[t], t))
    number = {t: n for n, t in enumerate(terms)}
    size = np.array([len(t) for t in terms], dtype=np.int64)
    lexicon = Lexicon(np.array([keys[t] for t in terms], dtype=np.uint64), np.frombuffer(b"".join(terms), dtype=np.uint8), np.cumsum(size) - size, size)
    lists = [sorted(number[t] for t in own) for own in held]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    return Items(list(names), first, np.array([t for x in lists for t in x], dtype=np.int64), lexicon)


# ---- document vectors -------------------------------------------------------------


def term_counts(texts: Texts, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per text with repeats, where each text's own begin, the query's terms in it, and how often."""
    words = split_words(texts, NOT_ALNUM, fold=True)
    n_terms = np.diff(words.first)
    term = lexicon.find(texts.data, words.start, words.end, words.hash)
    text = np.repeat(np.arange(len(n_terms)), n_terms)
    width = max(1, len(lexicon))
    key, count = np.unique((text * width + term)[term >= 0], return_counts=True)
    return n_terms, np.searchsorted(key // width, np.arange(len(n_terms) + 1)), key % width, count


def vectors(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document: its length, and the query's terms in it."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frames.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in chunks(texts_of(batch.column(1))):
                n, first, terms, tfs = term_counts(part, shared.value)
                at = pa.array(first.astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def statistics(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each of the query's.

    One row a term and task is shuffled, one a term reaches the driver; their number is
    bounded by the query text of a pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 2, dtype=np.int64)
        for batch in batches:
            n = batch.column(0).to_numpy()
            total[:n_terms] += np.bincount(batch.column(1).flatten().to_numpy(), minlength=n_terms)
            total[n_terms:] += [(n > 0).sum(), n.sum()]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["key", "n"])

    counted = found.select("n", "terms").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    total = np.zeros(n_terms + 2, dtype=np.int64)
    for row in counted.collect():
        total[row["key"]] = row["n"]
    return int(total[n_terms]), int(total[n_terms + 1]), total[:n_terms]


# ---- trees ------------------------------------------------------------------------


def halving_order(first: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Sparse rows in an order in which like rows are neighbours.

    A set is halved along the difference of its halves' sums, a few times over, starting
    from two of its rows that are unlike; and so on down to sets of ``FAN`` rows.
    """
    order, size = np.arange(len(first) - 1), np.diff(first)
    row = np.repeat(order, size)
    norm = np.sqrt(np.bincount(row, weights=values * values, minlength=len(order)))
    unit = values / norm[row]
    stack = [(0, len(order))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= FAN:
            continue
        rows = order[lo:hi]
        count = size[rows]
        upto = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(upto[-1]) + np.repeat(first[rows] - upto[:-1], count)
        own, value, term = np.repeat(np.arange(len(rows)), count), unit[at], terms[at]

        def towards(sign: np.ndarray) -> np.ndarray:
            """How much nearer each row is to the rows of positive than to those of negative sign."""
            axis = np.bincount(term, weights=value * sign[own], minlength=width)
            return np.bincount(own, weights=value * axis[term], minlength=len(rows))

        one = np.argmin(towards((np.arange(len(rows)) == 0) * 1.0))
        near = towards((np.arange(len(rows)) == one) * 1.0)
        near -= towards((np.arange(len(rows)) == np.argmin(near)) * 1.0)
        # A multiple of the fan, so that leaves and nodes are like within.
        half = -(-len(rows) // (2 * FAN)) * FAN
        for _ in range(ROUNDS):
            place = np.empty(len(rows), dtype=np.int64)
            place[np.argsort(-near, kind="stable")] = np.arange(len(rows))
            near = towards(np.where(place < half, 1.0, -half / max(1, len(rows) - half)))
        order[lo:hi] = rows[np.argsort(-near, kind="stable")]
        stack += [(lo, lo + half), (lo + half, hi)]
    return order


def _groups(n: int, size: int) -> np.ndarray:
    return np.arange(0, n, size)


def _maxima(rows: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(rows, _groups(len(rows), FAN), axis=0)


@dataclass
class Best:
    """The best documents of every query met so far, best first."""

    top: int
    score: np.ndarray
    doc: np.ndarray
    floor: np.ndarray

    @classmethod
    def above(cls, floor: np.ndarray, top: int) -> Best:
        """None yet; scores below ``floor`` (1 at least) are known to be beaten."""
        shape = (len(floor), top)
        return cls(top, np.zeros(shape, dtype=np.int64), np.full(shape, LARGEST), np.maximum(floor, 1))

    def weakest(self) -> np.ndarray:
        """Per query the least score that still counts."""
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Take in scored pairs; equal scores go by ascending document."""
        touched = np.unique(item)
        old = np.nonzero(self.score[touched])
        item = np.concatenate([item, touched[old[0]]])
        doc = np.concatenate([doc, self.doc[touched][old]])
        score = np.concatenate([score, self.score[touched][old]])
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < self.top
        item, doc, score, place = item[kept], doc[kept], score[kept], place[kept]
        self.score[touched], self.doc[touched] = 0, LARGEST
        self.score[item, place], self.doc[item, place] = score, doc


class Search:
    """One task's search: the tree of the queries, and the best of each."""

    def __init__(self, items: Items, weight: np.ndarray, floor: np.ndarray, top: int) -> None:
        size = np.diff(items.first)
        value = weight[items.terms]
        self.order = halving_order(items.first, items.terms, value.astype(np.float64), max(1, len(weight)))
        count = size[self.order]
        self.first = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(self.first[-1]) + np.repeat(items.first[self.order] - self.first[:-1], count)
        self.terms, self.value = items.terms[at], value[at]
        self.width = len(weight)
        self.best = Best.above(floor[self.order], top)
        # An impact is below a million.
        largest = int(np.add.reduceat(np.append(self.value, 0), np.minimum(self.first[:-1], len(self.value))).max()) if len(value) else 0
        self.kind = np.float64 if largest * 1_000_000 < EXACT else np.int64
        self.pairs = self.scored = 0

    def add(self, doc: np.ndarray, first: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> None:
        """Search documents, given as sparse rows, root by root."""
        order = halving_order(first, terms, impact.astype(np.float64), max(1, self.width))
        self._add(order, doc, first, terms, impact)

    def _add(self, order: np.ndarray, doc: np.ndarray, first: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> None:
        count = np.diff(first)[order]
        upto = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(upto[-1]) + np.repeat(first[order] - upto[:-1], count)
        columns, column = np.unique(terms[at], return_inverse=True)
        if not len(columns):
            return
        if len(order) > FAN and (len(order) > ROOT_DOCS or len(order) * len(columns) > ROOT_CELLS):
            half = -(-len(order) // (2 * FAN)) * FAN
            self._add(order[:half], doc, first, terms, impact)
            self._add(order[half:], doc, first, terms, impact)
            return
        rows = np.zeros((len(order), len(columns)), dtype=self.kind)
        rows[np.repeat(np.arange(len(order)), count), column] = impact[at]
        place = np.full(self.width, -1, dtype=np.int64)
        place[columns] = np.arange(len(columns))
        for lo in _groups(len(self.order), ROOT_ITEMS):
            self._root(lo, min(lo + ROOT_ITEMS, len(self.order)), place, doc[order], rows)

    def _root(self, lo: int, hi: int, place: np.ndarray, doc: np.ndarray, docs: np.ndarray) -> None:
        """All pairs of one root of queries and one of documents, from the roots down."""
        own = slice(self.first[lo], self.first[hi])
        column = place[self.terms[own]]
        there = column >= 0
        item = np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1]))[there]
        items = np.zeros((hi - lo, docs.shape[1]), dtype=self.kind)
        items[item, column[there]] = self.value[own][there]
        weakest = self.best.weakest()[lo:hi].astype(self.kind)
        if items.max(axis=0) @ docs.max(axis=0) < weakest.min():
            return
        item8, doc8 = _maxima(items), _maxima(docs)
        item64, doc64 = _maxima(item8), _maxima(doc8)
        bound64 = item64 @ doc64.T
        self.pairs += len(items) * len(docs)
        # The most promising documents first: what they score prunes the others.
        for k in np.argsort(-bound64.max(axis=0), kind="stable"):
            weakest = self.best.weakest()[lo:hi].astype(self.kind)
            weak8 = np.minimum.reduceat(weakest, _groups(len(weakest), FAN))
            weak64 = np.minimum.reduceat(weak8, _groups(len(weak8), FAN))
            # Leaves of queries and of documents below the pairs of nodes that are left.
            leaves = np.flatnonzero(np.repeat(bound64[:, k] >= weak64, FAN)[: len(item8)])
            if not len(leaves):
                continue
            alive = item8[leaves] @ doc8[k * FAN : (k + 1) * FAN].T >= weak8[leaves, None]
            found = []
            for j in np.flatnonzero(alive.any(axis=0)):
                near, rows = leaves[alive[:, j]], slice((k * FAN + j) * FAN, (k * FAN + j + 1) * FAN)
                # Then every document is a node of its own, and at last every query.
                pairs = item8[near] @ docs[rows].T >= weak8[near, None]
                near = near[pairs.any(axis=1)]
                some = (near[:, None] * FAN + np.arange(FAN)).ravel()
                some = some[some < len(items)]
                score = items[some] @ docs[rows].T
                self.scored += score.size
                i, d = np.nonzero(score >= weakest[some, None])
                found.append((lo + some[i], doc[rows][d], score[i, d].astype(np.int64)))
            if any(len(f[0]) for f in found):
                self.best.add(*map(np.concatenate, zip(*found)))

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, documents and scores of all that may be among the best."""
        item, place = np.nonzero(self.best.score)
        return self.order[item], self.best.doc[item, place], self.best.score[item, place]


def impacts(n: np.ndarray, first: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each term's count is worth in its document, by the document's length."""
    # Products beyond 64 bits are made of unbounded numbers.
    big = len(n) and int(n.max()) * 50 * n_docs > LARGEST
    length = np.array([50 + 50 * x * n_docs // n_terms for x in n.tolist()], dtype=np.int64) if big else 50 + 50 * n * n_docs // n_terms
    m, tf = np.repeat(length, np.diff(first)), tfs.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _searched(found: DataFrame, items: Items, weight: np.ndarray, floor: np.ndarray, top: int, n_docs: int, n_terms: int) -> DataFrame:
    """``item`` (a number), ``doc_id`` and ``score`` of each task's best."""
    shared = found.sparkSession.sparkContext.broadcast((items, weight, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value, top)
        for batch in batches:
            n = batch.column(1).to_numpy()
            lists = batch.column(2)
            first = lists.offsets.to_numpy().astype(np.int64)
            values = [batch.column(k).values.to_numpy()[first[0] : first[-1]] for k in (2, 3)]
            first = first - first[0]
            doc = batch.column(0).fill_null(LARGEST).to_numpy()
            search.add(doc, first, values[0].astype(np.int64), impacts(n, first, values[1], n_docs, n_terms))
        item, doc, score = search.results()
        ids = pa.array(doc, mask=doc == LARGEST)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), ids, pa.array(score)], names=["item", "doc_id", "score"])

    return found.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item int, doc_id bigint, score bigint")


def _best(rows: DataFrame, top: int) -> DataFrame:
    in_item = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(in_item)).where(F.col("rank") <= top)


def _search_pass(docs: DataFrame, items: Items, top: int, folder: str, name: str) -> DataFrame:
    found = frames.stored(vectors(docs, items.lexicon), folder, name)
    n_docs, n_terms, df = statistics(found, len(items.lexicon))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    floor = np.zeros(len(items.ids), dtype=np.int64)
    seeds = found.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED_SHARE)) == 0)
    reached = _best(_searched(seeds, items, weight, floor, top, n_docs, n_terms), top).where(F.col("rank") == top)
    for row in reached.select("item", "score").collect():
        floor[row["item"]] = row["score"]
    return _best(_searched(found, items, weight, floor, top, n_docs, n_terms), top)


def ranked(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every item, score above 0.

    Both tables need an id and ``text``; other columns are ignored. Rows of one
    ``item_id`` are one item (a null id is one as well); rows that repeat a document are
    documents of their own. A null or empty text has no terms: such an item has no rows,
    such a document is never found and not counted. Equal scores go by ascending
    ``doc_id``, a null id last. Empty tables give no rows.

    Items are taken in blocks of about ``ITEM_BYTES`` of text, by a hash of their id, and
    only one block is held by the driver and the tasks at a time.
    """
    spark = docs.sparkSession
    folder = frames.scratch(spark)
    own = items.select("item_id", F.col("text").cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // ITEM_BYTES) or 1
    kind = items.schema["item_id"].dataType.simpleString()
    result = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        parsed = parse_items([r["item_id"] for r in rows], [r["text"] for r in rows])
        if not len(parsed.lexicon):
            continue
        best = _search_pass(docs, parsed, top, folder, f"vectors-{block}")
        names = spark.createDataFrame(list(enumerate(parsed.ids)), f"item int, item_id {kind}")
        named = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        result = named if blocks == 1 else result.unionByName(named)
    return result
