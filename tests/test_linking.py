"""Anchored linking against a plain walk, with keys that are walked over and keys that are too large for it."""

import random

import pytest

from brinewell.operators import linking


def plain(rows, window):
    out = []
    for k in {r[1] for r in rows}:
        anchor = None
        for i, _, t in sorted((r for r in rows if r[1] == k and r[2] is not None), key=lambda r: r[2]):
            if anchor is None or t > anchor + window:
                anchor = t
            out.append((i, k, t, anchor))
    return sorted(out + [(*r, None) for r in rows if r[2] is None], key=repr)


@pytest.mark.parametrize("most", [20_000, 0, 7])
@pytest.mark.parametrize("window", [10, 1, 0])
def test_events(spark, monkeypatch, most, window):
    r = random.Random(most + window)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, r.randint(-300, 300), r.randint(0, 40)])) for i in range(400)]
    rows += [(1000 + i, "dense", i) for i in range(60)] + [(2000, "one", 5), (2001, "one", 5), (2002, "never", None), (2003, "far", -(10**12)), (2004, "far", 10**12)]
    monkeypatch.setattr(linking, "WALKED", most)
    out = linking.link_events(spark.createDataFrame(rows, "id long, k string, t long"), ["k"], "t", window)
    assert out.columns == ["id", "k", "t", "anchor"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain(rows, window)


def test_no_rows(spark):
    assert linking.link_events(spark.createDataFrame([], "id long, k string, t long"), ["k"], "t", 5).collect() == []
