"""Box joins of many rows with few boxes: boxes meet once, every pair of rows is there."""

from collections import Counter

import pytest

from quadrille.operators import more, resample

SOURCES = [(i, float(i % 5), float(i % 3), i % 5 + 2.5, i % 3 + 1.5) for i in range(60)] + [(7, 2.0, 1.0, 4.5, 2.5), (7, 2.0, 1.0, 4.5, 2.5), (60, None, 0.0, 1.0, 1.0), (61, -4.0, -4.0, 0.0, 0.0)]
TARGETS = [(i, i % 2 * 4.0, -(i % 2) * 4.0, i % 2 * 4.0 + 4, -(i % 2) * 4.0 + 4) for i in range(30)] + [(30, 4.0, 2.5, 4.5, 2.5), (31, 0.0, 0.0, None, 4.0)]


@pytest.fixture(params=[500_000, 0])
def seen(request, monkeypatch):
    """How many boxes meet; with and without broadcasts."""
    counts, real = [], resample._touching

    def touching(source, target, size):
        counts.append((source.count(), target.count()))
        return real(source, target, size)

    monkeypatch.setattr(resample, "_touching", touching)
    monkeypatch.setattr(resample, "BROADCAST_ROWS", request.param)
    return counts


def _tables(spark, name="source", other="target"):
    return (spark.createDataFrame(rows, f"{n} long, {p}_minx double, {p}_miny double, {p}_maxx double, {p}_maxy double") for rows, n, p in ((SOURCES, name, "s"), (TARGETS, other, "t")))


def _whole(rows):
    return [r for r in rows if None not in r]


def test_boxes_that_touch_meet_once(spark, seen):
    want = Counter((s[0], t[0]) for s in _whole(SOURCES) for t in _whole(TARGETS) if s[1] <= t[3] and s[3] >= t[1] and s[2] <= t[4] and s[4] >= t[2])
    got = resample.bin_join(*_tables(spark), 4.0).select("source", "target").collect()
    assert Counter((r.source, r.target) for r in got) == want and want[7, 0] == 3 and (61, 0) in want
    assert seen == [(17, 4)]


def test_cells_of_species_by_boxes(spark, seen):
    def side(s, t, low):
        return max(min(s[low + 2], t[low + 2]) - max(s[low], t[low]), 0.0)

    want = Counter()
    for s in _whole(SOURCES):
        for t in _whole(TARGETS):
            area = side(s, t, 1) * side(s, t, 2)
            if area > 0:
                want[s[0], t[0], round(area * 111.32**2, 6), round(area / 16 * 100, 6)] += 1
    got = more.species_cells(*_tables(spark, "species", "cell"), 4.0).collect()
    assert Counter(tuple(r) for r in got) == want
    assert seen == [(17, 4)]
