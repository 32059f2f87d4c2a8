import time

import numpy as np
import pytest

from gridlark.llm.suffix import suffix_arrays


@pytest.mark.parametrize("seed", range(6))
def test_suffix_arrays_match_sorting(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(40):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 5))
        t = rng.integers(1, k + 1, n)
        if rng.random() < 0.3:
            t = np.tile(t[: max(1, n // 4)], 4)
        texts.append(np.append(t, 0))
    start = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = suffix_arrays(np.concatenate(texts), start)
    for i, t in enumerate(texts):
        want = sorted(range(len(t)), key=lambda j: t[j:].tolist())
        assert (got[start[i] : start[i + 1]] - start[i]).tolist() == want


def test_empty_and_single():
    assert len(suffix_arrays(np.zeros(0, np.int64), np.zeros(1, np.int64))) == 0
    assert suffix_arrays(np.array([0]), np.array([0, 1])).tolist() == [0]


def test_runs_of_one_symbol_take_time_in_proportion():
    took = []
    for n in (5000, 20000):
        began = time.process_time()
        got = suffix_arrays(np.append(np.ones(n, np.int64), 0), np.array([0, n + 1]))
        took.append(time.process_time() - began)
        assert got.tolist() == list(range(n, -1, -1))
    assert took[1] < 8 * took[0] + 1
