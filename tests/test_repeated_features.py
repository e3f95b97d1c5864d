"""Pair statistics of samples of which many are alike: what meets are the different vectors, results are those of all pairs."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import pairs

VECTORS = [(None, 1.0, 2.0), (3.0, None, None), (0.0, 0.0, 0.0), (-0.0, 0.0, None), (5.0, 1.0, 4.0), (4.0, 1.0, 4.0), (2.0, 7.5, None), (None, None, None)]


def _distance(a, b):
    both = [(u, v) for u, v in zip(a, b, strict=True) if u is not None and v is not None]
    den = sum(u + v for u, v in both)
    return None if len(both) < 2 else sum(abs(u - v) for u, v in both) / den if den > 0 else 0.0


def _rows(repeats):
    """(id, x, label); ids 0 to 59 and, with ``repeats``, a third of them again with other features, a few as they are, and one null."""
    rows = [(i, VECTORS[i * 7 % 30 % 8], i % 3) for i in range(60)]
    if repeats:
        rows += [(i, VECTORS[(i * 5 + 1) % 8], i % 3) for i in range(0, 60, 3)] + rows[:5] + [(None, VECTORS[4], 0)]
    return rows


def _pairs(rows):
    """Of each id its pairs as (own label, other label, distance)."""
    out = defaultdict(list)
    for i, x, li in rows:
        for j, y, lj in rows:
            if i is not None and j is not None and i != j:
                out[i].append((li, lj, _distance(x, y)))
    return out


@pytest.fixture
def seen(monkeypatch):
    """How many rows each call of ``met`` was given."""
    counts, real = [], pairs.met

    def met(rows, kernel, schema, block_rows=2048, **more):
        counts.append(rows.count())
        return real(rows, kernel, schema, 5, **more)

    monkeypatch.setattr(pairs, "met", met)
    return counts


def _table(spark, rows):
    return spark.createDataFrame(rows, "id long, x array<double>, label long")


def test_silhouette_meets_different_vectors(spark, seen):
    for repeats in (False, True):
        rows = _rows(repeats)
        scores = []
        for own in _pairs(rows).values():
            means = defaultdict(list)
            for li, lj, d in own:
                means[li == lj, lj].append(1.0 if d is None else d)
            a, b = (min(np.mean(v) for k, v in means.items() if k[0] == same) for same in (True, False))
            scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
        assert pairs.silhouette(_table(spark, rows)).first()[0] == pytest.approx(np.mean(scores))
    # Vectors with 3 labels each, not samples.
    assert seen[0] <= 3 * len(VECTORS) < 60


def _check_summary(spark, seen, limit):
    for repeats in (False, True):
        rows = _rows(repeats)
        want = {}
        for i, own in _pairs(rows).items():
            near = [d for _, _, d in own if d is not None and d <= limit]
            want[i] = [len(near), *((min(near), np.mean(near), max(near)) if near else (None, None, None))]
        got = {r.id: list(r)[1:] for r in pairs.distance_summary(_table(spark, rows), limit).collect()}
        assert got.keys() == want.keys()
        assert all(got[i] == [v if v is None else pytest.approx(v) for v in want[i]] for i in want)
    assert seen[0] <= len(VECTORS) < 60
    assert pairs.distance_summary(_table(spark, [(1, VECTORS[4], 0)]), limit).count() == 0


def test_near_pairs_meet_as_different_vectors(spark, seen):
    _check_summary(spark, seen, 0.3)


def test_all_pairs_meet_as_different_vectors(spark, seen):
    _check_summary(spark, seen, 1.0)


def test_beta_preservation_meets_different_vectors(spark, seen):
    for repeats in (False, True):
        rows = _rows(repeats)
        sums = {same: [d for own in _pairs(rows).values() for li, lj, d in own if (li == lj) == same and d is not None] for same in (True, False)}
        w, b = np.mean(sums[True]), np.mean(sums[False])
        assert pairs.beta_preservation(_table(spark, rows)).first()[0] == pytest.approx(max((b - w) / (b + w), 0))
        turned = [(i, x, VECTORS.index(x) // 3) for i, x, _ in rows]
        sums = {same: [d for own in _pairs(turned).values() for li, lj, d in own if (li == lj) == same and d is not None] for same in (True, False)}
        w, b = np.mean(sums[True]), np.mean(sums[False])
        assert pairs.beta_preservation(_table(spark, turned)).first()[0] == pytest.approx(max((b - w) / (b + w), 0))
    assert seen[0] <= 3 * len(VECTORS) < 60


@pytest.fixture
def unmasked(monkeypatch):
    """Fails where a pair looks for what either misses, though few different features are missing."""

    def looks(*_):
        raise AssertionError("each pair looks at what is missing")

    monkeypatch.setattr(pairs, "bray_curtis", looks)


def _kernel(monkeypatch, operator, *more):
    """The operator's kernel."""
    got = []

    class Taken(Exception):
        pass

    def met(rows, kernel, *_, **__):
        got.append(kernel)
        raise Taken

    class Frame:
        """Any frame: all calls give it again."""

        def __getattr__(self, _):
            return lambda *a, **k: self

        def __getitem__(self, _):
            return self

    monkeypatch.setattr(pairs, "met", met)
    monkeypatch.setattr(pairs, "_classes", lambda *a: (Frame(), Frame(), False))
    with pytest.raises(Taken):
        operator(Frame(), *more)
    return got[0]


def _block(rows):
    x = np.array([[np.nan if v is None else v for v in x] for x in rows], float)
    return {"id": np.arange(len(x)), "x": x, "n": np.ones(len(x), int), "again": np.zeros(len(x), bool)}


def _summary_unmasked(monkeypatch, limit):
    kernel = _kernel(monkeypatch, pairs.distance_summary, limit)
    a = _block(VECTORS)
    got = kernel(a, a)
    for i, x in enumerate(VECTORS):
        near = [d for j, y in enumerate(VECTORS) if j != i and (d := _distance(x, y)) is not None and d <= limit]
        at = list(got["id"]).index(i)
        assert (got["others"][at], got["n"][at]) == (len(VECTORS) - 1, len(near))
        assert got["s"][at] == pytest.approx(sum(near)) and got["low"][at] == min(near, default=np.inf) and got["high"][at] == max(near, default=0.0)


def test_near_pairs_do_not_look_for_missing_features(spark, monkeypatch, unmasked):
    _summary_unmasked(monkeypatch, 0.3)


def test_many_ways_to_miss_features():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, (300, 9)).astype(float)
    x[rng.random(x.shape) < 0.4] = np.nan
    y = np.array([[np.nan, 1, 2], [0, 0, 0], [-1, 1, np.nan], [-3, 1, 4], [np.nan] * 3])
    for side, least in ((x, 2), (x, 4), (y, 2), (y, 1)):
        a = pairs._by_missing({"x": side})
        assert (len(a["runs"]) > 64) == (side is x)
        got = np.concatenate([d for _, d in pairs._distances(a, a, least, 1000)])
        assert np.array_equal(got, pairs.bray_curtis(a["x"], a["x"], least))


def test_all_pairs_do_not_look_for_missing_features(spark, monkeypatch, unmasked):
    _summary_unmasked(monkeypatch, 1.0)


def test_beta_preservation_returns_a_row_for_two_labels(spark, monkeypatch, unmasked):
    rows, made, real = _rows(True), [], pairs.met

    def met(rows, kernel, schema, block_rows, **more):
        out = real(rows, kernel, schema, 1000, **more).persist()
        made.append(out.count())
        return out

    monkeypatch.setattr(pairs, "met", met)
    got = pairs.beta_preservation(_table(spark, rows)).first()[0]
    sums = {same: [d for own in _pairs(rows).values() for li, lj, d in own if (li == lj) == same and d is not None] for same in (True, False)}
    w, b = np.mean(sums[True]), np.mean(sums[False])
    assert got == pytest.approx(max((b - w) / (b + w), 0))
    assert made == [9]


def _plain(a, b, at):
    """Of row ``at`` of block a: number, sum, least and greatest of distances up to 1 to the samples of block b, itself apart."""
    x = [None if np.isnan(v) else v for v in a["x"][at]]
    near = [(d, n) for j, n in zip(b["x"], b["n"], strict=True) if (d := _distance(x, [None if np.isnan(v) else v for v in j])) is not None and d <= 1]
    if a is b and (0.0, a["n"][at]) in near:
        near.remove((0.0, a["n"][at]))
        if a["n"][at] > 1:
            near.append((0.0, a["n"][at] - 1))
    return sum(n for _, n in near), sum(d * n for d, n in near), min((d for d, _ in near), default=np.inf), max((d for d, _ in near), default=0.0)


def _compare_blocks(monkeypatch, x):
    kernel = _kernel(monkeypatch, pairs.distance_summary, 1.0)
    rng = np.random.default_rng(5)
    x = rng.permutation(x)
    blocks = []
    for part in (x[: len(x) // 2], x[len(x) // 2 :]):
        blocks.append({"id": np.arange(len(part)) + 10_000 * len(blocks), "x": part, "n": rng.integers(1, 4, len(part)), "again": np.zeros(len(part), bool)})
    for a, b in (blocks, blocks[:1] * 2):
        got = kernel(a, b)
        assert len(got["id"]) == len(a["id"]) + (len(b["id"]) if b is not a else 0)
        at = {i: k for k, i in enumerate(got["id"])}
        for side, other in ((a, b), (b, a)):
            for k in range(0, len(side["id"]), 7):
                n, s, low, high = _plain(side, other, k)
                g = at[side["id"][k]]
                assert got["n"][g] == n and got["others"][g] == other["n"].sum() - (a is b)
                assert got["s"][g] == pytest.approx(s) and got["low"][g] == pytest.approx(low) and got["high"][g] == pytest.approx(high)


def _grid():
    """Different vectors of three features of 0 to 8; some miss one or two."""
    x = np.array(np.meshgrid(*[np.arange(9.0)] * 3)).reshape(3, -1).T
    missing = [x[x[:, k] == 0] for k in range(3)]
    for k, rows in enumerate(missing):
        rows[:, k] = np.nan
    return np.concatenate([np.random.default_rng(4).permutation(x)[:250], *missing, [[np.nan, np.nan, 1.0], [np.nan] * 3]])


def test_all_pairs_of_repeated_values_meet_by_their_sums(spark, monkeypatch):
    def meets(*_):
        raise AssertionError("each pair's distance is made")

    monkeypatch.setattr(pairs, "_distances", meets)
    _compare_blocks(monkeypatch, _grid())


def test_all_pairs_of_other_values_meet(spark, monkeypatch):
    x = _grid()
    # x - 1 has negative ones, whose distances may be over 1 and then don't count.
    for other in (x / 7, x * 9_000, x + np.random.default_rng(6).random(x.shape), np.where(x == 3, 1e6, x), x - 1):
        _compare_blocks(monkeypatch, other)


def test_rows_meet_by_their_sums_in_pieces():
    rng = np.random.default_rng(7)
    q = rng.integers(0, 5, (33, 3)).astype(float)
    p = np.concatenate([q, rng.integers(0, 5, (40, 3))]).astype(float)
    for a, n, itself in ((p, rng.integers(1, 4, len(p)).astype(float), False), (q, np.ones(len(q)), True)):
        d = pairs.bray_curtis(a, q, 2)
        want = (d + np.where(np.eye(len(q)), np.inf, 0) if itself else d).min(axis=0), d.max(axis=0), n @ d
        values = [np.unique(column, return_inverse=True) for column in a.T]
        for pieces in ((5, 7), (1, 1), (128, 1024)):
            got = pairs._by_sum(a, values, n, q, itself, *pieces)
            assert all(g == pytest.approx(w) for g, w in zip(got, want, strict=True))


def test_blocks_are_dealt_without_lambdas(spark):
    rows = spark.range(40).select("id")

    def kernel(a, b):
        i, j = (np.repeat(a["id"], len(b["id"])), np.tile(b["id"], len(a["id"])))
        return {"i": i, "j": j}

    for once in (False, True):
        out = pairs.met(rows, kernel, "i long, j long", 7, once=once)
        got = [(r.i, r.j) for r in out.collect()]
        # With ``once`` ids of two blocks meet in one order, those of one block in both.
        assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == {(i, j) for i in range(40) for j in range(i, 40)}
        assert once or len(got) == 1600
        assert "lambda" not in out._jdf.queryExecution().toString()


def test_tables_of_many_values_are_not_made():
    p = np.repeat(np.arange(600.0), 4)[:, None]
    assert pairs._by_sum(p, [np.unique(p[:, 0], return_inverse=True)], np.ones(len(p)), p[:10], False) is None
    p %= 200
    assert pairs._by_sum(p, [np.unique(p[:, 0], return_inverse=True)], np.ones(len(p)), p[:10], False) is not None
