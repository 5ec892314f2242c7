"""Counters of percentiles are narrowed in the tasks."""

import numpy as np

from raritas.functions.array_quantiles import array_percentiles


def test_two_lines_a_place_reach_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    table = np.exp(rng.normal(size=(2000, 5)) * 20)
    df = spark.createDataFrame([(row.tolist(),) for row in table], "s array<double>").repartition(4)
    kind, lines = type(df), []
    taken = kind.collect

    def watched(self):
        lines.append(taken(self))
        return lines[-1]

    monkeypatch.setattr(kind, "collect", watched)
    found = array_percentiles(df, "s", 5, 0.77)
    assert np.allclose(found, np.quantile(table, 0.77, axis=0), rtol=1e-14, atol=0)
    assert lines and all(len(rows) <= 10 for rows in lines)


def test_ranks_that_share_a_counter_and_ranks_that_do_not(spark):
    """The two rows around the place: equal, in one counter, in neighbouring counters, and in far ones."""
    rows = [[1.0, 5.0, 1.0, -1e300], [1.0, 5.0 + 2**-50, 2.0, 1e300]]
    df = spark.createDataFrame([(r,) for r in rows], "s array<double>")
    assert array_percentiles(df, "s", 4, 0.0) == [1.0, 5.0, 1.0, -1e300]
    assert array_percentiles(df, "s", 4, 1.0) == [1.0, 5.0 + 2**-50, 2.0, 1e300]
    assert array_percentiles(df, "s", 4, 0.5)[2:] == [1.5, 0.0]
