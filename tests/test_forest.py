"""Rows pass complete trees to the leaves of the grown ones."""

import numpy as np
import pytest

from millrace.operators import forest


def test_complete_trees_reach_the_same_leaves():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (20_000, 3)).astype(float)
    x[:5] = np.nan, np.inf, -np.inf
    grown = [forest.grow(x[10 + 90 * k : 100 + 90 * k], np.random.default_rng(k), 7) for k in range(5)]

    def reached(nodes, row):
        at = 0
        while nodes[at][0] >= 0:
            at = nodes[at][2] if row[nodes[at][0]] < nodes[at][1] else nodes[at][3]
        return nodes[at][4]

    got = forest.path_lengths([forest.complete(t, 8) for t in grown], 8, x)
    some = [*range(10), *range(8185, 8200), 19_999]
    assert got[some] == pytest.approx([sum(reached(t, x[i]) for t in grown) for i in some])
