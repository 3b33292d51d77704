"""Steps and later values of series that span several parts, against pandas."""

import numpy as np
import pandas as pd
import pytest

from snapforge.functions import losses, series


def events(spark, n=400, hot=0.7):
    r = np.random.default_rng(5)
    names = np.where(r.random(n) < hot, "hot", r.choice(["a", "b", "c"], n)).tolist()
    rows = [(None if s == "c" else s, int(t), float(v) if v > -1.5 else None, "note" if v > 0 else None, 1) for s, t, v in zip(names, r.permutation(n), r.normal(size=n), strict=True)]
    return rows, spark.createDataFrame(rows, "s string, t bigint, v double, _part string, step int")


@pytest.mark.parametrize("ranges,horizon", [(1, 1), (7, 1), (7, 3), (40, 30)])
def test_long_series_span_parts(spark, ranges, horizon):
    rows, table = events(spark)
    found = {r["t"]: r for r in series.with_later(table, "s", ["t"], "v", horizon, ranges=ranges).collect()}
    frame = pd.DataFrame(rows, columns=["s", "t", "v", "note", "n"]).fillna({"s": "none"}).sort_values("t")
    assert len(found) == len(rows)
    for _, own in frame.groupby("s"):
        for step, t in enumerate(own["t"]):
            there = step + horizon < len(own)
            wanted = own["v"].iloc[step + horizon] if there else None
            got = found[t]
            assert (got["step"], got["target_exists"]) == (step, there)
            assert got["target"] == (None if wanted is None or np.isnan(wanted) else wanted)
    assert {r["t"]: r["_part"] for r in found.values()} == {r[1]: r[3] for r in rows}


def test_ties_and_nothing(spark):
    same = spark.createDataFrame([("a", 1, float(i)) for i in range(50)] + [("a", None, -1.0)], "s string, t bigint, v double")
    found = series.with_steps(same, "s", ["t"], ranges=6).collect()
    assert sorted(r["step"] for r in found) == list(range(51))
    assert [r["v"] for r in found if r["step"] == 0] == [-1.0]
    pairs = losses.step_pairs(same, "s", ["t"], "v", 2).collect()
    assert len(pairs) == 49 and len({r["target"] for r in pairs}) == 49
    assert losses.step_pairs(same.limit(0), "s", ["t"], "v").count() == 0
    with pytest.raises(ValueError):
        series.with_later(same, "s", ["t"], "v", 0)


def test_grid_lines_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(series.grid_blocks, "__defaults__", (5,))
    values = {p: float(p * p * p % 17) for p in range(-8, 40) if p not in (4, 11, 20)}
    table = spark.createDataFrame([(1, p, v) for p, v in values.items()] + [(2, None, 1.0)], "line int, p bigint, v double")
    for r in losses.grid_derivatives(table, ["line"], "p", "v", 0.5).collect():
        p = r["p"]
        if p is None or p - 1 not in values or p + 1 not in values:
            assert r["first"] is None and r["second"] is None
        else:
            assert r["first"] == values[p + 1] - values[p - 1] and r["second"] == (values[p + 1] - 2 * values[p] + values[p - 1]) / 0.25
    assert losses.grid_derivatives(table, ["line"], "p", "v").count() == len(values) + 1
