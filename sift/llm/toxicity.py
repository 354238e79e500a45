"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

The input of a word is a word vector beside a character vector, the sum of vectors of
its byte n-grams (hashed, with marks for a word's first and last). Two gated recurrent
layers read a window of words in both directions, attention pools their states, and
a logistic unit scores the window. A document's score is that of its highest window,
over all overlapping windows of its whole text.

Learning knows labels of documents only. Every window of a clean document is clean; of
a toxic one, first any windows and then those that score highest count as toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.llm import frames
from sift.llm.byte_bpe import ragged
from sift.llm.language import held_out, sampled
from sift.llm.words import LOWER, NOT_ALNUM, Texts, Words, chunks, mix, span_hash, split_words, texts_of

WINDOW = 32
STRIDE = 16
WORD_BUCKETS_LOG2, CHAR_BUCKETS_LOG2 = 14, 15
WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 8, 16, 12, 12
BYTE_GRAMS = (3, 4, 5, 6)
#: Documents of each label that the network learns from at most, the bytes of all of them
#: together, and of one. They are read whole; a longer one is not in the sample.
DOCS_PER_LABEL = 1000
LEARNED_BYTES, LONGEST_BYTES = 32 << 20, 4 << 20
#: Windows of one document that an epoch draws at random, besides those of highest score.
WINDOWS_PER_DOC = 6
EPOCHS = 6
BATCH = 256
SCORE_BATCH = 1024
WORD_BATCH = 1 << 13
#: Distinct words whose vectors a task remembers at most, 112 bytes each.
REMEMBERED = 1 << 19

_U = np.uint64


@dataclass
class Inputs:
    """Words of texts as numbers of distinct words, with the buckets of each distinct word."""

    which: np.ndarray
    first: np.ndarray
    key: np.ndarray
    word: np.ndarray
    gram: np.ndarray
    gram_at: np.ndarray


@dataclass
class Met:
    """Words of texts as numbers of distinct words, and what each of these adds to the gates."""

    which: np.ndarray
    first: np.ndarray
    gates: dict[str, np.ndarray]


def word_inputs(texts: Texts) -> Inputs:
    """Inputs of any number of texts; the memory besides the result is that of one chunk."""
    parts = [_inputs_of_chunk(part) for _, _, part in chunks(texts)] or [_inputs_of_chunk(texts)]
    if len(parts) == 1:
        return parts[0]
    key, sample = np.unique(np.concatenate([p.key for p in parts]), return_index=True)
    size = np.concatenate([[0], *(np.diff(p.gram_at) for p in parts)])
    place, size = ragged(np.cumsum(size), sample)
    which = np.concatenate([np.searchsorted(key, p.key)[p.which] for p in parts])
    count = np.concatenate([np.diff(p.first) for p in parts])
    gram = np.concatenate([p.gram for p in parts])[place]
    word = np.concatenate([p.word for p in parts])[sample]
    return Inputs(which, np.concatenate([[0], np.cumsum(count)]), key, word, gram, np.concatenate([[0], np.cumsum(size)]))


def _inputs_of_chunk(texts: Texts) -> Inputs:
    words = split_words(texts, NOT_ALNUM, fold=True)
    key, sample, which = np.unique(words.hash, return_index=True, return_inverse=True)
    word, gram, gram_at = _grams(texts, words, key, sample)
    return Inputs(which, words.first, key, word, gram, gram_at)


def _grams(texts: Texts, words: Words, key: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and n-gram buckets of distinct words, of which ``sample`` are occurrences."""
    # Only the bytes of these words, end to end: hashes do not depend on the place.
    size = words.end[sample] - words.start[sample]
    end = np.cumsum(size)
    start = end - size
    data = LOWER[texts.data[np.repeat(words.start[sample] - start, size) + np.arange(size.sum())]]
    # One place before the word's first byte to one behind its last: marks are spans cut short.
    counts = [np.maximum(end - start + 2 - n + 1, 0) for n in BYTE_GRAMS]
    gram_at = np.concatenate([[0], np.cumsum(sum(counts))])
    gram = np.empty(gram_at[-1], dtype=np.int32)
    filled = gram_at[:-1].copy()
    for n, count in zip(BYTE_GRAMS, counts):
        owner = np.repeat(np.arange(len(key)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        lo, hi = start[owner] - 1 + offset, start[owner] - 1 + offset + n
        mark = (lo < start[owner]) * 1 + (hi > end[owner]) * 2
        h = span_hash(data, np.maximum(lo, start[owner]), np.minimum(hi, end[owner])) + mark.astype(np.uint64) * _U(0xD1B54A32D192ED03)
        gram[filled[owner] + offset] = (mix(h + _U(n)) >> _U(64 - CHAR_BUCKETS_LOG2)).astype(np.int32)
        filled += count
    return (key >> _U(64 - WORD_BUCKETS_LOG2)).astype(np.int32), gram, gram_at


def windows_of(inputs: Inputs | Met) -> tuple[np.ndarray, np.ndarray]:
    """All windows as rows of distinct-word numbers (-1: nothing), and each window's text.

    Windows begin every ``STRIDE`` words; the last one ends with the text. A text has a
    window at least, an empty one if it has no words.
    """
    size = np.diff(inputs.first)
    count = 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(size)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(step * STRIDE, np.maximum(size[doc] - WINDOW, 0))
    column = np.arange(WINDOW)
    there = begin[:, None] + column < size[doc][:, None]
    at = np.minimum(inputs.first[doc][:, None] + begin[:, None] + column, max(0, len(inputs.which) - 1))
    rows = inputs.which[at] if len(inputs.which) else np.zeros(at.shape, dtype=np.int64)
    return np.where(there, rows, -1), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters in ``p``; everything is float32."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        size = WORD_SIZE + CHAR_SIZE
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": draw(1 << WORD_BUCKETS_LOG2, WORD_SIZE, scale=0.1), "char": draw(1 << CHAR_BUCKETS_LOG2, CHAR_SIZE, scale=0.1)}
        for d in ("f", "b"):
            self.p[f"in_{d}"] = draw(size, 3 * HIDDEN, scale=size**-0.5)
            self.p[f"state_{d}"] = draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
            self.p[f"bias_{d}"] = np.zeros(3 * HIDDEN, dtype=np.float32)
        self.p |= {"key": draw(2 * HIDDEN, ATTENTION, scale=0.2), "key_bias": np.zeros(ATTENTION, dtype=np.float32), "query": draw(ATTENTION, scale=0.2)}
        self.p |= {"out": draw(2 * HIDDEN, scale=0.2), "out_bias": np.zeros(1, dtype=np.float32)}

    def vectors(self, inputs: Inputs, distinct: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Input vectors of distinct words, and what their gradient needs."""
        place, size = ragged(inputs.gram_at, distinct)
        gram = inputs.gram[place]
        scale = (1 / np.sqrt(np.maximum(size, 1))).astype(np.float32)
        begin = np.cumsum(size) - size
        chars = np.zeros((len(distinct), CHAR_SIZE), dtype=np.float32)
        full = size > 0
        if full.any():
            chars[full] = np.add.reduceat(self.p["char"][gram], begin[full], axis=0)
        return np.concatenate([self.p["word"][inputs.word[distinct]], chars * scale[:, None]], axis=1), (gram, size, scale)

    def _read(self, x: np.ndarray, there: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States after every word in one direction; ``x`` is (steps, windows, 3 * HIDDEN)."""
        weight, steps = self.p[f"state_{d}"], range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)
        h = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        states, kept = np.empty((WINDOW, x.shape[1], HIDDEN), dtype=np.float32), []
        for t in steps:
            g = h @ weight
            zr = _sigmoid(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            kept.append((t, h, z, r, n, g[:, 2 * HIDDEN :]))
            h = np.where(there[t][:, None], new, h)
            states[t] = h
        return states, kept

    def projected(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """What each input vector adds to the gates of either direction."""
        return {d: vectors @ self.p[f"in_{d}"] + self.p[f"bias_{d}"] for d in ("f", "b")}

    def forward(self, gates: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of windows whose entries are rows of ``gates`` (-1: nothing)."""
        there = (rows >= 0).T
        at = np.maximum(rows.T, 0)
        c: dict = {"there": there, "at": at}
        both = []
        for d in ("f", "b"):
            states, c[f"kept_{d}"] = self._read(gates[d][at], there, d)
            both.append(states)
        h = np.concatenate(both, axis=2)
        k = np.tanh(h @ self.p["key"] + self.p["key_bias"])
        e = np.where(there, k @ self.p["query"], np.float32(-1e9))
        a = np.exp(e - e.max(axis=0)) * there
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", a, h)
        c |= {"h": h, "k": k, "a": a, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["out_bias"][0], c

    def backward(self, vectors: np.ndarray, c: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of all parameters but the two tables, and of ``vectors``."""
        p, g = self.p, {}
        there, at, h, k, a = c["there"], c["at"], c["h"], c["k"], c["a"]
        g["out"], g["out_bias"] = c["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_h = a[:, :, None] * d_pooled
        d_a = np.einsum("bh,tbh->tb", d_pooled, h)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["query"] = np.einsum("tb,tbk->k", d_e, k)
        d_k = d_e[:, :, None] * p["query"] * (1 - k * k)
        flat = d_k.reshape(-1, ATTENTION)
        g["key"], g["key_bias"] = h.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
        d_h = d_h + d_k @ p["key"].T
        d_vectors = np.zeros_like(vectors)
        for i, d in enumerate(("f", "b")):
            own = d_h[:, :, i * HIDDEN : (i + 1) * HIDDEN]
            weight = p[f"state_{d}"]
            d_weight = np.zeros_like(weight)
            d_x = np.zeros((*at.shape, 3 * HIDDEN), dtype=np.float32)
            flow = np.zeros((at.shape[1], HIDDEN), dtype=np.float32)
            for t, prior, z, r, n, gn in reversed(c[f"kept_{d}"]):
                d_new = own[t] + flow
                live = there[t][:, None]
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (prior - n) * z * (1 - z)
                d_r = d_n * gn * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_n * r], axis=1) * live
                d_x[t, :, : 2 * HIDDEN] = d_g[:, : 2 * HIDDEN]
                d_x[t, :, 2 * HIDDEN :] = d_n * live
                d_weight += prior.T @ d_g
                flow = np.where(live, d_new * z, d_new) + d_g @ weight.T
            g[f"state_{d}"] = d_weight
            flat = d_x.reshape(-1, 3 * HIDDEN)
            g[f"bias_{d}"] = flat.sum(axis=0)
            summed = np.zeros((len(vectors), 3 * HIDDEN), dtype=np.float32)
            order = np.argsort(at.ravel(), kind="stable")
            sorted_at = at.ravel()[order]
            head = np.flatnonzero(np.append(True, sorted_at[1:] != sorted_at[:-1]))
            summed[sorted_at[head]] = np.add.reduceat(flat[order], head, axis=0)
            g[f"in_{d}"] = vectors.T @ summed
            d_vectors += summed @ p[f"in_{d}"].T
        return g, d_vectors

    def gradients(self, inputs: Inputs, rows: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
        """Gradients of the mean logistic loss, and the loss."""
        distinct, at = np.unique(rows, return_inverse=True)
        shift = int(len(distinct) and distinct[0] < 0)
        vectors, (gram, size, scale) = self.vectors(inputs, distinct[shift:])
        if not len(vectors):
            vectors = np.zeros((1, WORD_SIZE + CHAR_SIZE), dtype=np.float32)
        logit, c = self.forward(self.projected(vectors), at.reshape(rows.shape) - shift)
        prob = _sigmoid(logit)
        d_logit = ((prob - label) / len(label)).astype(np.float32)
        g, d_vectors = self.backward(vectors, c, d_logit)
        d_vectors = d_vectors[: len(distinct) - shift]
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(g["word"], inputs.word[distinct[shift:]], d_vectors[:, :WORD_SIZE])
        np.add.at(g["char"], gram, np.repeat(d_vectors[:, WORD_SIZE:] * scale[:, None], size, axis=0))
        loss = -np.mean(np.log(np.where(label > 0, prob, 1 - prob) + 1e-9))
        return g, float(loss)

    def word_vectors(self, inputs: Inputs) -> np.ndarray:
        words = np.arange(len(inputs.word))
        vectors = [self.vectors(inputs, words[lo : lo + WORD_BATCH])[0] for lo in range(0, len(words), WORD_BATCH)]
        return np.concatenate([np.zeros((0, WORD_SIZE + CHAR_SIZE), dtype=np.float32), *vectors])

    def word_gates(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """What distinct words add to the gates of either direction; a row at least."""
        return self.projected(vectors if len(vectors) else np.zeros((1, WORD_SIZE + CHAR_SIZE), dtype=np.float32))

    def _states(self, x: np.ndarray, there: np.ndarray, d: str) -> np.ndarray:
        """The states of ``_read``, without what a gradient needs."""
        update, candidate = (np.ascontiguousarray(w) for w in np.split(self.p[f"state_{d}"], [2 * HIDDEN], axis=1))
        h = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        states, full = np.empty((WINDOW, x.shape[1], HIDDEN), dtype=np.float32), there.all(axis=1)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            zr = h @ update
            zr += x[t, :, : 2 * HIDDEN]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            n = h @ candidate
            n *= zr[:, HIDDEN:]
            n += x[t, :, 2 * HIDDEN :]
            np.tanh(n, out=n)
            new = np.subtract(h, n, out=states[t])
            new *= zr[:, :HIDDEN]
            new += n
            if not full[t]:
                new[~there[t]] = h[~there[t]]
            h = new
        return states

    def logits(self, gates: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
        """The logits of ``forward``, without what a gradient needs.

        Products with one column are sums of rows, so that rounding does not depend on how
        many windows there are.
        """
        there, at = (rows >= 0).T, np.maximum(rows.T, 0)
        h = np.concatenate([self._states(gates[d][at], there, d) for d in ("f", "b")], axis=2)
        k = (h.reshape(-1, 2 * HIDDEN) @ self.p["key"]).reshape(*at.shape, ATTENTION)
        k += self.p["key_bias"]
        np.tanh(k, out=k)
        e = np.where(there, (k * self.p["query"]).sum(axis=2), np.float32(-1e9))
        a = np.exp(e - e.max(axis=0)) * there
        a /= np.maximum(a.sum(axis=0), 1e-9)
        return (np.einsum("tb,tbh->bh", a, h) * self.p["out"]).sum(axis=1) + self.p["out_bias"][0]

    def window_logits(self, gates: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
        out = [self.forward(gates, rows[lo : lo + SCORE_BATCH])[0] for lo in range(0, len(rows), SCORE_BATCH)]
        return np.concatenate([np.zeros(0, dtype=np.float32), *out])


class Scorer:
    """A network that remembers the vectors of words of earlier texts."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.vectors = np.empty((REMEMBERED, WORD_SIZE + CHAR_SIZE), dtype=np.float32)
        #: Words in order of their hash, and the rows of their vectors.
        self.key, self.row = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def met(self, texts: Texts) -> Met:
        words = split_words(texts, NOT_ALNUM, fold=True)
        key, sample, which = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.key, key)
        old = at < len(self.key)
        old[old] = self.key[at[old]] == key[old]
        new = ~old
        added = Inputs(which, words.first, key[new], *_grams(texts, words, key[new], sample[new]))
        vectors = np.empty((len(key), WORD_SIZE + CHAR_SIZE), dtype=np.float32)
        vectors[old], vectors[new] = self.vectors[self.row[at[old]]], self.net.word_vectors(added)
        if len(self.key) + len(added.key) > REMEMBERED:
            # Full: the memory begins again with the words at hand.
            self.key, self.row, new = self.key[:0], self.row[:0], np.arange(min(len(key), REMEMBERED))
            at = np.zeros(len(key), dtype=np.int64)
        row = len(self.key) + np.arange(len(key[new]))
        self.vectors[row] = vectors[new]
        self.key, self.row = np.insert(self.key, at[new], key[new]), np.insert(self.row, at[new], row)
        return Met(which, words.first, self.net.word_gates(vectors))

    def scores(self, texts: Texts) -> np.ndarray:
        """The probability of each text's highest window; 0 for a text without words."""
        met = self.met(texts)
        rows, doc = windows_of(met)
        # Windows that lack words last, so that most batches have none.
        order = np.argsort(~(rows >= 0).all(axis=1), kind="stable")
        rows, doc = rows[order], doc[order]
        best = np.full(len(texts), -np.inf)
        for lo in range(0, len(rows), SCORE_BATCH):
            np.maximum.at(best, doc[lo : lo + SCORE_BATCH], self.net.logits(met.gates, rows[lo : lo + SCORE_BATCH]))
        return np.where(np.diff(met.first) > 0, _sigmoid(best), 0.0)


def train(texts: Texts, toxic: np.ndarray, seed: int = 11) -> Network:
    """A network from texts and labels; a fifth of the texts only calibrates its bias.

    Without texts of both labels every score is the share of toxic ones.
    """
    net = Network(seed)
    if not toxic.any() or toxic.all():
        for name in net.p:
            net.p[name] *= 0
        net.p["out_bias"][:] = 6.0 if len(toxic) and toxic.all() else -6.0
        return net
    rng = np.random.default_rng(seed)
    inputs = word_inputs(texts)
    rows, doc = windows_of(inputs)
    spare = np.arange(len(toxic)) % 5 == 4
    by_doc = np.split(np.arange(len(doc)), np.searchsorted(doc, np.arange(1, len(toxic))))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        score = net.window_logits(net.word_gates(net.word_vectors(inputs)), rows) if epoch >= 2 else None
        picked = []
        for i in np.flatnonzero(~spare):
            own = by_doc[i]
            some = rng.permutation(own)[:WINDOWS_PER_DOC]
            if score is not None:
                top = own[np.argsort(-score[own])[:2]]
                some = top if toxic[i] else np.concatenate([top, some[: WINDOWS_PER_DOC // 2]])
            picked.append(some)
        picked = rng.permutation(np.concatenate(picked))
        for lo in range(0, len(picked), BATCH):
            own = picked[lo : lo + BATCH]
            g, _ = net.gradients(inputs, rows[own], toxic[doc[own]].astype(np.float32))
            step += 1
            rate = 0.01 if epoch < EPOCHS - 2 else 0.003
            for k, (m, v) in moment.items():
                m += 0.1 * (g[k] - m)
                v += 0.001 * (g[k] * g[k] - v)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    # The bias moves to where most spare texts of either label are on the right side of one half.
    best = np.full(len(toxic), -np.inf)
    np.maximum.at(best, doc, net.window_logits(net.word_gates(net.word_vectors(inputs)), rows))
    use = spare if toxic[spare].any() and not toxic[spare].all() else np.ones(len(toxic), dtype=bool)
    logit, label = best[use], toxic[use]
    order = np.argsort(logit)
    right = np.concatenate([[0], np.cumsum(~label[order])]) + np.concatenate([np.cumsum(label[order][::-1])[::-1], [0]])
    # Of equally good places the middle one.
    places = np.flatnonzero(right == right.max())
    edge = np.concatenate([[logit.min() - 2], np.sort(logit), [logit.max() + 2]])
    middle = places[len(places) // 2]
    net.p["out_bias"] -= np.float32((edge[middle] + edge[middle + 1]) / 2)
    return net


def learned(docs: DataFrame, labels: DataFrame) -> Network:
    """A network from labelled documents (``doc_id, toxic``) that are not held out.

    At most ``DOCS_PER_LABEL`` of either label are read, those with the smallest hash of
    their id, and ``LEARNED_BYTES`` of text. Null labels and ids are left out; of
    contradicting labels the higher counts. Repeated ids give one text.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= LONGEST_BYTES)
    rows = texts.join(F.broadcast(sampled(known, "toxic", DOCS_PER_LABEL)), "doc_id")
    rows = rows.groupBy("doc_id", "toxic", "at").agg(F.max("text").alias("text"))
    sample, room = [], {True: LEARNED_BYTES, False: LEARNED_BYTES}
    # Labels take turns, so that the part that calibrates has both.
    for row in rows.orderBy("at", "toxic").toLocalIterator():
        room[row["toxic"]] -= len(row["text"].encode())
        if room[row["toxic"]] >= 0:
            sample.append(row)
    return train(texts_of(pa.array([r["text"] for r in sample], pa.string())), np.array([r["toxic"] for r in sample], dtype=bool))


def scored(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """For every row of ``docs``: ``row`` and ``score`` (0 to 1), from ``text`` alone.

    ``row`` holds the columns ``keep`` (all, if not given) as a struct, so their names
    cannot clash. A null or empty text, and one without words, has score 0; equal texts
    get equal scores; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(net.p)

    held: list[Scorer] = []

    def fn(texts: Texts) -> list[pa.Array]:
        if not held:
            own = Network.__new__(Network)
            own.p = model.value
            held.append(Scorer(own))
        return [pa.array(held[0].scores(texts))]

    return frames.annotated(docs, keep or docs.columns, "text", fn, "score double")
