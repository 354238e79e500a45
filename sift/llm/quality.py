"""Quality rules: exact rule statistics, and an isolation forest over them.

The statistics of a document are counts over its whole text. The forest sees ratios
of them: random splits isolate an unusual document after few steps, so a short mean
path over all trees marks an anomaly. All labelled rows take part, counted by tasks:
one half grows the forest, and the path length below which a document is rejected is
calibrated on the labels of the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.llm import frames
from sift.llm.words import SPACES, Texts, byte_class, continuation_free, mix, span_hash, split_words, window_hash

SYMBOLS = byte_class(b"#*$%&|<>")
DIGITS = byte_class(b"0123456789")
UPPER = byte_class(bytes(range(ord("A"), ord("Z") + 1)))
OTHER_MARKS = byte_class(b"!\"'()+,-./:;=?@[\\]^_`{}~")
REPEAT_WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_marks", "n_distinct")
FIELDS = ", ".join(f"{name} bigint" for name in COUNTS)

TREES = 128
#: Rows of a tree of the method; paths are means over all draws of so many.
TREE_ROWS = 128
DEPTH = 12
FEATURES = 9
#: Rows that walk down all trees at once.
WALK_ROWS = 1024
#: Share of good labelled rows that the threshold may reject.
FALSE_REJECTS = 0.001

_U = np.uint64


def _repeats(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur twice or more in their text, and which are not the first there."""
    own = mix(key + (doc.astype(np.uint64) + _U(1)) * _U(0xD1B54A32D192ED03))
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    later, twice = np.zeros(len(own), dtype=bool), np.zeros(len(own), dtype=bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def rule_counts(texts: Texts) -> dict[str, np.ndarray]:
    """``COUNTS`` of every text."""
    n = len(texts)
    data = texts.data
    words = split_words(texts, SPACES, fold=False)
    n_words = np.diff(words.first)
    doc = np.repeat(np.arange(n), n_words)

    def per_text(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return sums[texts.end] - sums[texts.start]

    points = np.concatenate([[0], np.cumsum(continuation_free(data), dtype=np.int64)])
    in_words = np.bincount(doc, weights=points[words.end] - points[words.start], minlength=n).astype(np.int64)

    # A line ends at \n or where its text ends; only lines with a word count.
    stop = np.zeros(len(data) + 1, dtype=bool)
    stop[:-1] = data == 10
    stop[texts.end[texts.end > texts.start]] = True
    line_end = np.flatnonzero(stop)
    line_of_word = np.searchsorted(line_end, words.start)
    first_word = np.flatnonzero(np.append(True, line_of_word[1:] != line_of_word[:-1])) if len(doc) else np.zeros(0, dtype=np.int64)
    line = line_of_word[first_word]
    line_doc = doc[first_word]
    begins = np.maximum(np.where(line > 0, line_end[line - 1] + (data[np.minimum(line_end[line - 1], len(data) - 1)] == 10), 0), texts.start[line_doc])
    _, repeated_line = _repeats(span_hash(data, begins, line_end[line]), line_doc)
    dup_lines = np.bincount(line_doc[repeated_line], minlength=n)

    value = window_hash(words, REPEAT_WINDOW)
    within = doc[: len(value)] == doc[REPEAT_WINDOW - 1 :] if len(value) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(within)
    twice, _ = _repeats(value[at], doc[at])
    cover = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT_WINDOW, -1)
    repeated = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n)

    _, again = _repeats(words.hash, doc)
    return dict(
        n_words=n_words, word_chars=in_words, n_symbols=per_text(SYMBOLS[data]), n_dup_lines=dup_lines, n_repeat_words=repeated,
        n_lines=np.bincount(line_doc, minlength=n), n_digits=per_text(DIGITS[data]), n_upper=per_text(UPPER[data]),
        n_marks=per_text(OTHER_MARKS[data]), n_distinct=n_words - np.bincount(doc[again], minlength=n),
    )


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Square roots of shares, which do not grow with the length of a text."""
    c = {k: v.astype(np.float64) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.sqrt(np.stack([
        np.minimum(c["n_symbols"] / words, 4), c["n_symbols"] / chars, np.minimum(c["word_chars"] / words, 64), c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_digits"] / chars, c["n_upper"] / chars, c["n_marks"] / chars, c["n_distinct"] / words,
    ], axis=1))


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), split value, left child (right: + 1), path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    threshold: float = 0.0

    def mean_path(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        root = np.arange(len(self.feature))[:, None] * self.feature.shape[1]
        feature, split, left, path = (v.ravel() for v in (self.feature, self.split, self.left, self.path))
        for lo in range(0, len(x), WALK_ROWS):
            own = x[lo : lo + WALK_ROWS]
            rows, at = np.arange(len(own)), np.repeat(root, len(own), axis=1)
            while True:
                f = feature[at]
                if (f < 0).all():
                    break
                down = root + left[at] + (own[rows, f] >= split[at])
                at = np.where(f < 0, at, down)
            # Tree by tree, so that a row's sum does not depend on the rows beside it.
            for one in path[at]:
                total[lo : lo + WALK_ROWS] += one
        return total / len(self.feature)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher: fewer splits isolate the row."""
        return 2.0 ** (-self.mean_path(x) / _expected(TREE_ROWS))


def _expected(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


@dataclass
class Splits:
    """Whole binary trees ``DEPTH`` splits deep; the children of node ``i`` are ``2i + 1`` and ``2i + 2``."""

    feature: np.ndarray
    split: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """How many rows end in each leaf, by tree."""
        inner = self.feature.shape[1]
        root = np.arange(len(self.feature))[:, None] * inner
        feature, split = self.feature.ravel(), self.split.ravel()
        total = np.zeros(len(self.feature) * (inner + 1), dtype=np.int64)
        for lo in range(0, len(x), WALK_ROWS):
            own = x[lo : lo + WALK_ROWS]
            rows, at = np.arange(len(own)), np.zeros((len(self.feature), len(own)), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (own[rows, feature[root + at]] >= split[root + at])
            # Before the leaves of a tree there are ``inner`` nodes, and ``inner + 1`` are its leaves.
            at += np.arange(len(self.feature))[:, None] * (inner + 1) - inner
            total += np.bincount(at.ravel(), minlength=len(total))
        return total.reshape(len(self.feature), -1)


def drawn(low: np.ndarray, high: np.ndarray, seed: int = 7) -> Splits:
    """``TREES`` trees of splits.

    A split is drawn from the box that the splits above leave of ``low`` to ``high``,
    not from the rows in it: where ordinary rows have a rule at zero, a row far from
    zero is alone after one such split.
    """
    rng = np.random.default_rng(seed)
    wide = np.flatnonzero(high > low)
    if not len(wide):
        wide = np.arange(len(low))
    features, splits = [], []
    least, most = np.tile(low, (TREES, 1, 1)), np.tile(high, (TREES, 1, 1))
    for depth in range(DEPTH):
        f = rng.choice(wide, (TREES, 1 << depth))
        pick = lambda box: np.take_along_axis(box, f[:, :, None], axis=2)[:, :, 0]
        at = rng.uniform(pick(least), pick(most))
        features.append(f.astype(np.int8)), splits.append(at)
        below, above = most.copy(), least.copy()
        np.put_along_axis(below, f[:, :, None], at[:, :, None], axis=2)
        np.put_along_axis(above, f[:, :, None], at[:, :, None], axis=2)
        least = np.stack([least, above], axis=2).reshape(TREES, -1, len(low))
        most = np.stack([below, most], axis=2).reshape(TREES, -1, len(low))
    return Splits(np.concatenate(features, axis=1), np.concatenate(splits, axis=1))


def _log_factorial(n: np.ndarray) -> np.ndarray:
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 32)))])
    m = np.maximum(n, 31).astype(np.float64)
    large = m * np.log(m) - m + 0.5 * np.log(2 * np.pi * m) + 1 / (12 * m) - 1 / (360 * m**3) + 1 / (1260 * m**5)
    return np.where(n < 32, small[np.minimum(n, 31)], large)


def _draws(counts: np.ndarray, rows: int, most: int) -> np.ndarray:
    """How likely a draw of ``TREE_ROWS`` of all rows holds 0 to ``most`` of the rows of a node, by node."""
    size = min(TREE_ROWS, rows)

    def ways(n: np.ndarray, k: np.ndarray) -> np.ndarray:
        can = (k >= 0) & (k <= n)
        n, k = np.where(can, n, 0), np.where(can, k, 0)
        return np.where(can, _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k), -np.inf)

    own, k = counts[:, None], np.arange(min(most, size) + 1)[None, :]
    return np.exp(ways(own, k) + ways(rows - own, size - k) - ways(np.array(rows), np.array(size)))


def pruned(trees: Splits, leaves: np.ndarray) -> Forest:
    """The forest of all rows that ``leaves`` counts.

    A tree of the method is grown over ``TREE_ROWS`` rows and splits a node that holds two
    of them. Its path lengths here are the means over all draws of that many rows, which
    follow from the counts of all rows: each split adds how likely a draw makes it.
    """
    rows = int(leaves[0].sum())
    levels = [leaves]
    while levels[0].shape[1] > 1:
        levels.insert(0, levels[0].reshape(len(leaves), -1, 2).sum(axis=2))
    count = np.concatenate(levels, axis=1)
    inner = trees.feature.shape[1]
    known, which = np.unique(count[:, :inner], return_inverse=True)
    splits = np.maximum(1 - _draws(known, rows, 1).sum(axis=1), 0.0)
    splits[known < 2] = 0.0
    known, last = np.unique(leaves, return_inverse=True)
    beyond = np.array([_expected(n) for n in range(min(TREE_ROWS, rows) + 1)])
    rest = np.concatenate([_draws(known[lo : lo + WALK_ROWS], rows, TREE_ROWS) @ beyond for lo in range(0, len(known), WALK_ROWS)])
    passed = np.concatenate([splits[which].reshape(len(leaves), inner), rest[last].reshape(leaves.shape)], axis=1)
    path = np.zeros(count.shape)
    for at in range(count.shape[1]):
        path[:, at] = passed[:, at] + (path[:, (at - 1) // 2] if at else 0.0)
    # What stays are the nodes whose parent holds two rows, in the order of the whole tree.
    split = np.concatenate([count[:, :inner] >= 2, np.zeros(leaves.shape, dtype=bool)], axis=1)
    stays = np.concatenate([np.ones((len(leaves), 1), dtype=bool), split[:, (np.arange(1, count.shape[1]) - 1) // 2]], axis=1)
    place = np.cumsum(stays, axis=1) - 1
    width = int(stays.sum(axis=1).max())
    forest = Forest(np.full((len(leaves), width), -1, dtype=np.int8), np.zeros((len(leaves), width)), np.zeros((len(leaves), width), dtype=np.int16), np.zeros((len(leaves), width)))
    tree, at = np.nonzero(stays)
    own = place[tree, at]
    forest.path[tree, own] = path[tree, at]
    tree, at = np.nonzero(split)
    own = place[tree, at]
    forest.feature[tree, own], forest.split[tree, own] = trees.feature[tree, at], trees.split[tree, at]
    forest.left[tree, own] = place[tree, 2 * at + 1]
    return forest


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 7) -> Forest:
    """The forest of the rows ``x``, within the box from ``low`` to ``high``."""
    trees = drawn(low, high, seed)
    return pruned(trees, trees.leaves(x))


def keeps_all() -> Forest:
    return Forest(*(np.array([[v]]) for v in (-1, 0.0, 0, 0.0)), threshold=-1.0)


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``row`` and the rule counts of every document."""

    def fn(texts: Texts) -> list[pa.Array]:
        counts = rule_counts(texts)
        return [pa.array(counts[name].astype(np.int64)) for name in COUNTS]

    return frames.annotated(docs, keep, "text", fn, FIELDS)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The features ``x0``, ``x1``, ... of every labelled document that passes the base rules.

    ``good`` is its label, ``fit`` its half, by a hash of its id. Labels (``doc_id,
    quality``) or ids that are null are left out; of contradicting labels the lower
    counts, of texts that share an id one. Texts are counted where they are: what is
    joined are their counts.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = counted(docs.select("doc_id", "text"), ["doc_id"]).where(~base_failed()).select("row.doc_id", *COUNTS)
    rows = rows.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("c"))
    fit = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = rows.select((F.col("quality") >= 1).alias("good"), fit.alias("fit"), "c.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({name: batch.column(name).to_numpy(zero_copy_only=False) for name in COUNTS})
            yield pa.RecordBatch.from_arrays([batch.column("good"), batch.column("fit"), *map(pa.array, x.T)], names=["good", "fit", *_VECTOR])

    return rows.mapInArrow(run, "good boolean, fit boolean, " + ", ".join(f"{name} double" for name in _VECTOR))


_VECTOR = [f"x{n}" for n in range(FEATURES)]


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(name).to_numpy(zero_copy_only=False) for name in _VECTOR], axis=1)


def _leaves(rows: DataFrame, trees: Splits) -> np.ndarray:
    """``trees.leaves`` of all rows: tasks count, and only leaves with rows move."""
    model = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((model.value.leaves(_vectors(batch)) for batch in batches), start=np.zeros(1, dtype=np.int64)).ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["leaf", "n"])

    found = rows.mapInArrow(run, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).toPandas()
    leaves = np.zeros((TREES, 1 << DEPTH), dtype=np.int64)
    leaves.ravel()[found["leaf"].to_numpy()] = found["n"].to_numpy()
    return leaves


def _paths(rows: DataFrame, forest: Forest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(forest.mean_path(_vectors(batch)))], names=["good", "path"])

    return rows.mapInArrow(run, "good boolean, path double")


def fitted(docs: DataFrame, labels: DataFrame) -> Forest:
    """A forest from all labelled documents that pass the base rules.

    It is grown on the good rows of one half; its threshold leaves those of the other
    alone, but for ``FALSE_REJECTS`` of them. With fewer than 16 good rows or no bad one
    to calibrate on, nothing is rejected.
    """
    folder = frames.scratch(docs.sparkSession)
    rows = frames.stored(labelled(docs, labels), folder, "labelled", few=True)
    fit, good = F.col("fit"), F.col("good")
    kinds = {"grown": fit & good, "safe": ~fit & good, "bad": ~fit & ~good}
    box = [end(F.when(fit, F.col(name))).alias(f"{end.__name__}_{name}") for end in (F.min, F.max) for name in _VECTOR]
    found = rows.agg(*(F.count_if(kind).alias(name) for name, kind in kinds.items()), *box).first()
    if found["grown"] < 2 or found["safe"] < 16 or not found["bad"]:
        forest = keeps_all()
    else:
        trees = drawn(*(np.array([found[f"{end}_{name}"] for name in _VECTOR]) for end in ("min", "max")))
        forest = pruned(trees, _leaves(rows.where(fit & good), trees))
        paths = frames.stored(_paths(rows.where(~fit), forest), folder, "paths", few=True)
        limit = paths.where(good).orderBy("path").offset(int(FALSE_REJECTS * found["safe"])).first()["path"]
        below = paths.where(~good & (F.col("path") < limit)).agg(F.max("path")).first()[0]
        # Halfway between the good rows that must stay and the bad rows beyond them.
        forest.threshold = -1.0 if below is None else (limit + below) / 2
    frames.remove(docs.sparkSession, folder)
    return forest


def judged(docs: DataFrame, forest: Forest, keep: list[str] | None = None) -> DataFrame:
    """For every row of ``docs``: ``row``, the counts, ``path``, ``base_failed``, ``kept``.

    ``row`` holds the columns ``keep`` (all, if not given) as a struct, so their names
    cannot clash. A null, empty or blank text has no words and fails the base rules.
    Equal texts get equal results; an empty table gives no rows. ``path`` is the mean
    path length in the forest; a document is kept if it passes the base rules and its
    path is not shorter than the forest's threshold.
    """

    def fn(texts: Texts) -> list[pa.Array]:
        counts = rule_counts(texts)
        path = forest.mean_path(features(counts))
        return [*(pa.array(counts[name].astype(np.int64)) for name in COUNTS), pa.array(path)]

    found = frames.annotated(docs, keep or docs.columns, "text", fn, f"{FIELDS}, path double")
    found = found.withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("path") >= forest.threshold))
