"""Vectors as matrices, without a Python object for each number."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from recollect.operators import vectors


def test_vectors_become_a_matrix_without_lists():
    x = np.random.default_rng(3).standard_normal((5000, 64))
    given = pa.chunked_array([pa.array(list(x[:2000])), pa.array(list(x[2000:]))])
    tracemalloc.start()
    got = vectors.unit(given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, x / np.linalg.norm(x, axis=1, keepdims=True), atol=0, rtol=1e-14)
    assert peak < 3.5 * x.nbytes  # lists of numbers take four times the matrix besides


def test_nulls_zeros_and_lengths():
    got = vectors.unit(pa.array([[3.0, 4.0], [0.0, 0.0]]).slice(0, 2))
    assert got.tolist() == [[0.6, 0.8], [0.0, 0.0]]
    assert vectors.unit(pa.array([[1.0, 1.0], [0.0, 2.0]]).slice(1)).tolist() == [[0.0, 1.0]]
    with pytest.raises(ValueError):
        vectors.unit(pa.array([[1.0], [1.0, 2.0], [1.0, 2.0, 3.0]]))
