"""The packer against a plain best-fit version: windows, bounds and padding."""

import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("threadloom.llm")

from threadloom.llm.packing import Packer, powers  # noqa: E402


def _plain(lengths, window, most):
    """Lists of (document, start, length) of the full windows in order, and of those left open."""
    full, left = [], []
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= window:
            full.append([(d, at, window)])
            at += window
        while at < n:
            room = [window - sum(p[2] for p in w) for w in left]
            fitting = [i for i, r in enumerate(room) if r >= n - at]
            if not fitting and len(left) < most:
                left.append([(d, at, n - at)])
                break
            i = min(fitting or range(len(left)), key=lambda i: (room[i], i))  # best fit, or the fullest one
            take = min(room[i], n - at)
            left[i].append((d, at, take))
            at += take
            if take == room[i]:
                full.append(left.pop(i))
    return full, left


@pytest.mark.parametrize("most", [1, 2, 5, 16])
def test_packer(most):
    rng = random.Random(most)
    for _ in range(40):
        lengths = [rng.choice([1, rng.randrange(1, 30), rng.randrange(1, 200)]) for _ in range(rng.randrange(0, 120))]
        full = []
        p = Packer(full.append, window=64, open_windows=most)
        for d, n in enumerate(lengths):
            p.add(d, np.arange(n))
            assert len(p.open) <= most
        shape = lambda ws: [[(d, a, len(ids)) for d, a, ids, _ in w] for w in ws]
        want = _plain(lengths, 64, most)
        assert (shape(full), shape(p.left())) == want
        assert all(sum(x[2] for x in w) == 64 for w in want[0])
        ids = Counter()
        for w in [*full, *p.left()]:
            for d, a, own, n in w:
                assert n == lengths[d] and own.tolist() == list(range(a, a + len(own)))
                ids[d] += len(own)
        assert ids == Counter({d: n for d, n in enumerate(lengths)})


def test_powers():
    for n in range(300):
        assert sum(powers(n)) == n and all(x & (x - 1) == 0 for x in powers(n)) and powers(n) == sorted(powers(n), reverse=True)
