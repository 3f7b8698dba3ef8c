"""Sums of nodes are put together before they come to the driver."""

import numpy as np

from ticketlab.operators import boosting


def test_each_node_comes_to_the_driver_once(spark):
    def part(i):
        return {0: np.arange(4) + i, 5: np.full(4, i)}, {7: [(i, "rows")] if i % 2 else []}

    for n in (2, 9, 40):
        sums, rows = boosting._gathered(spark.sparkContext.parallelize(range(n), n).map(part))
        assert sums[0].tolist() == [n * k + n * (n - 1) // 2 for k in range(4)]
        assert sums[5].tolist() == [n * (n - 1) // 2] * 4
        assert sorted(rows[7]) == [(i, "rows") for i in range(1, n, 2)]
