"""Decoders against enumeration."""

import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.operators.decoders import allowed, best_path, ctc_collapse, spans_of

LABELS = ["O", "B-x", "I-x", "E-x", "S-x", "S-y"]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4))
def test_best_path_is_best(seed, n):
    scores = np.random.default_rng(seed).normal(size=(n, len(LABELS)))
    opens, follow, closes = allowed(LABELS)
    well = [p for p in itertools.product(range(len(LABELS)), repeat=n) if opens[p[0]] and closes[p[-1]] and all(follow[a, b] for a, b in zip(p, p[1:], strict=False))]
    best = max(well, key=lambda p: sum(scores[t, i] for t, i in enumerate(p)))
    path = best_path(scores, LABELS)
    assert tuple(path) == best
    assert all(first <= last for first, last, _ in spans_of(path, LABELS))


def test_ctc(spark, rows):
    steps = spark.createDataFrame([(1, t, c, p) for t, (c, p) in enumerate([(0, 0.9), (3, 0.5), (3, 0.8), (0, 0.7), (3, 0.6), (2, 0.4)])], "seq int, step int, cls int, prob double")
    assert rows(ctc_collapse(steps)) == [(1, 0, 3, 0.8, 1, 2), (1, 1, 3, 0.6, 4, 4), (1, 2, 2, 0.4, 5, 5)]
    assert ctc_collapse(steps.limit(0)).count() == 0
