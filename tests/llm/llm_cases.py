from __future__ import annotations

import pytest


@pytest.fixture
def documents(spark):
    """Documents from texts, or from (id, text) pairs; with columns whose names clash with results."""

    def make(*texts, **columns):
        rows = [t if isinstance(t, tuple) else (n, t) for n, t in enumerate(texts)]
        schema = "doc_id bigint, text string, score string, kept string, row string, n_words string, `a.b c` string"
        return spark.createDataFrame([(*r, "a", None, "b", "c", "d") for r in rows], schema).repartition(3)

    return make


@pytest.fixture
def rows():
    """Rows of a frame as tuples, sorted."""

    def collect(df, *columns):
        return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)

    return collect


#: Texts that every operator must take.
ODD = [None, "", " \t\n", "a", "word", "Ünï cödé 😀", "x" * 5000, "the same words again and again " * 400, "　\u0000\x1c", "<p>&amp;"]
