"""All pairs of a table's rows, met block by block in Arrow kernels that return few rows (KM12-KM14, MT02, MT03, SA01).

Rows are dealt into blocks of about ``block_rows`` by a hash of their id; two blocks meet in one task, so no task grows
with the table. The number of meetings grows with the square of the rows, as the operators' definition does; what is
returned grows with the rows alone, but for ``pairwise``, whose pairs are its result. Where features alone make the
distance (KM12-KM14, MT02), what meets are the different feature vectors with the number of their samples, each two
blocks once for both directions: the work grows with the square of the different vectors. Where all distances count and
values are small whole numbers (KM14), vectors meet by the sums of their features (``_by_sum``), at a small part of the work.
"""

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.cluster import bray_curtis

#: Above all sums of small whole numbers.
NEVER = 65535


def met(rows: DataFrame, kernel: Callable[[dict, dict], dict], schema: str, block_rows: int = 2048, key: str = "id", once: bool = False, spread: int = 10) -> DataFrame:
    """``kernel(a, b)`` of all ordered pairs of blocks of ``rows`` (id, ...); a, b and the result are columns as arrays.

    An array of structs comes as the arrays of its fields, and ``row``, the row of each. Rows of one ``key`` are in one block. With ``once``, two blocks meet once; ``b is a`` where a block meets itself.
    """
    n = rows.count()
    # With ``once`` a table of a few blocks has some more (``spread``), so that there is work for many cores.
    blocks = max(1, -(-n // block_rows), min(spread, n // 1024) if once else 1)
    own = F.pmod(F.xxhash64(key), F.lit(blocks))
    # A row is in its block's meetings as ``a`` (side 0), and as ``b`` (side 1). With ``once`` a is no later block than b.
    copy = F.col("__copy")
    one, other = (copy <= F.col("__own"), F.when(copy <= F.col("__own"), copy).otherwise(copy - 1)) if once else (copy >= blocks, copy % blocks)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks if once else 2 * blocks - 1).cast("long")))
    a, b = (F.when(one, x).otherwise(y) for x, y in ((other, F.col("__own")), (F.col("__own"), other)))
    names = rows.columns

    def arrays(table: pa.Table) -> dict:
        out = {}
        for name in names:
            column = table.column(name).combine_chunks()
            if pa.types.is_list(column.type) and pa.types.is_struct(column.type.value_type):
                flat = column.flatten()
                out[name] = {"row": np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())}
                out[name] |= {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
            elif pa.types.is_list(column.type):
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
                out[name] = flat.reshape(len(column), -1)
            else:
                out[name] = column.to_numpy(zero_copy_only=False)
        return out

    def run(table: pa.Table) -> pa.Table:
        side = table.column("__side").to_numpy()
        sides = [table.filter(pa.array(side == s)) for s in (0, 1)]
        made = None
        if sides[0].num_rows and sides[1].num_rows:
            a = arrays(sides[0])
            made = kernel(a, a if once and table.column("__a")[0] == table.column("__b")[0] else arrays(sides[1]))
        kinds = {f.split()[0]: {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]] for f in schema.split(", ")}
        return pa.table([pa.array(made[c] if made else [], k) for c, k in kinds.items()], names=list(kinds))

    both = rows.select(*names, own.alias("__own"), copies.alias("__copy")).select(*names, a.alias("__a"), b.alias("__b"), one.cast("int").alias("__side"))
    if once:
        # By number, so that few bytes with much work on them aren't put together into a few tasks.
        both = both.repartition(min(blocks * (blocks + 1) // 2, 4096), "__a", "__b")
    return both.groupBy("__a", "__b").applyInArrow(run, schema)


def pairwise(samples: DataFrame, limit: float, least: int = 2) -> DataFrame:
    """KM13, KM14: pairs (i < j, distance) of samples (id, x) with enough shared features and a distance of at most ``limit``."""

    def kernel(a, b):
        d = bray_curtis(a["x"], b["x"], least)
        i, j = np.nonzero((d <= limit) & (a["id"][:, None] < b["id"][None, :]))
        return {"i": a["id"][i], "j": b["id"][j], "distance": d[i, j]}

    return met(samples.select("id", "x"), kernel, "i long, j long, distance double")


def _classes(samples: DataFrame, *by: str) -> tuple[DataFrame, DataFrame, bool]:
    """Samples (id, x, *by) with ``__id``, their id if it repeats; classes (id, x, *by, n, again) of them; whether ids repeat.

    A class has equal features: ``id`` is the least of its samples', ``n`` their number. Samples of one id aren't each
    other's pairs, so those of a repeated id are classes of their own (``again``). Samples without an id have no pairs.
    """
    rows = samples.where("id IS NOT NULL")
    repeated = rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("__id"))
    some = not repeated.isEmpty()
    rows = rows.join(repeated, F.col("id") == F.col("__id"), "left") if some else rows.withColumn("__id", F.lit(None).cast("long"))
    classes = rows.groupBy("x", *by, "__id").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return rows, classes.withColumn("again", F.col("__id").isNotNull()).drop("__id"), some


def _by_missing(side: dict) -> dict:
    """``side`` with its rows in order of which features they miss, and ``runs``: (from, to, features there) of rows that miss the same."""
    x = side["x"]
    have = ~np.isnan(x)
    order = np.lexsort(have.T) if x.size else np.arange(len(x))
    have = have[order]
    edges = np.flatnonzero(np.r_[True, (have[1:] != have[:-1]).any(axis=1), True]) if len(x) else np.zeros(1, int)
    runs = [(u, v, have[u]) for u, v in zip(edges[:-1], edges[1:], strict=True)]
    return {name: column[order] for name, column in side.items()} | {"runs": runs}


def _distances(a: dict, b: dict, least: int, cells: int = 1 << 16):
    """(slice of a's rows, their partial Bray-Curtis distances to b's) for a few rows at a time, which a processor's cache holds.

    a and b come from ``_by_missing``: rows that miss the same features meet without a look at what is missing. Where they
    miss too many different ones for that, each pair looks.
    """
    x, y = a["x"], b["x"]
    step = max(1, cells // max(1, len(y)))
    if len(b["runs"]) > 64 or len(a["runs"]) > 64:
        for at in range(0, len(x), step):
            d = bray_curtis(x[at : at + step], y, least)
            yield slice(at, at + len(d)), d
        return
    columns = np.ascontiguousarray(y.T)
    for start, stop, have in a["runs"]:
        shared = [(u, v, np.flatnonzero(have & other)) for u, v, other in b["runs"]]
        for at in range(start, stop, step):
            rows = x[at : min(at + step, stop)]
            d = np.empty((len(rows), len(y)))
            for u, v, features in shared:
                if len(features) < max(least, 1):
                    d[:, u:v] = np.inf if least > 0 else 0.0
                    continue
                num, den, gap, sums = None, None, np.empty((len(rows), v - u)), np.empty((len(rows), v - u))
                for k in features:
                    p, q = rows[:, k, None], columns[k, None, u:v]
                    np.abs(np.subtract(p, q, out=gap), out=gap)
                    np.add(p, q, out=sums)
                    if num is None:
                        num, den, gap, sums = gap, sums, np.empty_like(gap), np.empty_like(sums)
                    else:
                        num += gap
                        den += sums
                none = den <= 0
                if none.any():
                    num[none], den[none] = 0.0, 1.0
                np.divide(num, den, out=d[:, u:v])
            yield slice(at, at + len(rows)), d


def _by_sum(p: np.ndarray, values: list, n: np.ndarray, q: np.ndarray, itself: bool, rows: int = 128, width: int = 1024, kinds: int = 512) -> tuple | None:
    """Of each row of q the least and greatest distances to rows of p and the sum of ``n`` times them; None where few of p's ``values`` repeat, or tables of them (of ``kinds`` rows) would take much memory.

    For small whole numbers, none missing. Rows of p with one sum of their features have one denominator, so that their
    least, greatest and summed numerators are enough. Gaps are taken from tables of each feature's different values
    (``values``: they, and which one each row has), in 16 bits. With ``itself`` p is q, and a row is not met with itself.
    """
    total, group = np.unique(p.sum(axis=1), return_inverse=True)
    if len(total) + sum(len(v) for v, _ in values) > min(len(p), kinds):
        return None
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[order], np.arange(len(total) + 1)).tolist()
    sums, tables = np.zeros((len(total), len(q))), []
    for (v, at), column in zip(values, q.T, strict=True):
        gap = np.abs(v[:, None] - column[None, :])
        sums += np.bincount(group * len(v) + at, n, len(total) * len(v)).reshape(len(total), len(v)) @ gap
        tables.append((gap.astype(np.uint16), at[order]))
    low, high = (np.empty(sums.shape, np.uint16) for _ in range(2))
    first = 0
    while first < len(total):
        # As many sums and columns at a time as a processor's cache holds.
        last = max(first + 1, bisect_right(edges, edges[first] + rows) - 1)
        start, stop = edges[first], edges[last]
        for left in range(0, len(q), width):
            right = min(left + width, len(q))
            num = tables[0][0][:, left:right][tables[0][1][start:stop]]
            for gap, at in tables[1:]:
                num += gap[:, left:right][at[start:stop]]
            parts = [(g, num[edges[g] - start : edges[g + 1] - start]) for g in range(first, last)]
            for g, part in parts:
                np.maximum.reduce(part, axis=0, out=high[g, left:right])
            if itself:
                own = order[start:stop]
                here = np.flatnonzero((own >= left) & (own < right))
                num[here, own[here] - left] = NEVER
            for g, part in parts:
                np.minimum.reduce(part, axis=0, out=low[g, left:right])
        first = last
    den = total[:, None] + q.sum(axis=1)
    den[den <= 0] = 1.0
    least = low / den
    if itself:
        least[low == NEVER] = np.inf
    return least.min(axis=0), (high / den).max(axis=0), (sums / den).sum(axis=0)


def _all_near(a: dict, b: dict, least: int):
    """(rows of a, rows of b, two sides' least, greatest and summed distances) of runs of ``_by_missing`` with enough shared features.

    For features that aren't negative, all of whose distances count. Where a is b, each two runs come once, and of a run that
    meets itself the first side alone.
    """
    sides = (a,) if b is a else (a, b)
    x = [np.nan_to_num(side["x"]) for side in sides]
    whole = all((v == np.floor(v)).all() and v.max(axis=0, initial=0.0).sum() < NEVER for v in x)
    of = [[{k: np.unique(v[start:stop, k], return_inverse=True) for k in np.flatnonzero(have)} if whole else {} for start, stop, have in side["runs"]] for side, v in zip(sides, x, strict=True)]
    for i, (start, stop, have) in enumerate(a["runs"]):
        for j, (u, v, other) in enumerate(b["runs"]):
            features = np.flatnonzero(have & other)
            if len(features) < least or b is a and j < i:
                continue
            itself = b is a and i == j
            p, q, m, n = a["x"][start:stop, features], b["x"][u:v, features], a["n"][start:stop].astype(float), b["n"][u:v].astype(float)
            found = [_by_sum(q, [of[-1][j][k] for k in features], n, p, itself)] if whole else [None]
            if whole and not itself:
                found.append(_by_sum(p, [of[0][i][k] for k in features], m, q, itself))
            if any(f is None for f in found):
                found = [[np.full(len(x), np.inf), np.zeros(len(x)), np.zeros(len(x))] for x in ((p,) if itself else (p, q))]
                every = np.ones(len(features), bool)
                for at, d in _distances({"x": p, "runs": [(0, len(p), every)]}, {"x": q, "runs": [(0, len(q), every)]}, least):
                    own = np.arange(at.start, at.stop) if itself else np.arange(0)
                    for axis, (_, high, s) in enumerate(found):
                        to = slice(None) if axis else at
                        np.maximum(high[to], d.max(axis=1 - axis), out=high[to])
                        s[to] += m[at] @ d if axis else d @ n
                    d[own - at.start, own] = np.inf
                    for axis, (low, _, _) in enumerate(found):
                        to = slice(None) if axis else at
                        np.minimum(low[to], d.min(axis=1 - axis), out=low[to])
            yield slice(start, stop), slice(u, v), found


def distance_summary(samples: DataFrame, limit: float = 1.0, least: int = 2) -> DataFrame:
    """KM13, KM14: of each sample (id, x) the others within ``limit``: their number, least, mean and greatest distance.

    There is no row where no sample has another id.
    """
    sums, start = ("others", "n", "s"), {"others": 0.0, "n": 0.0, "s": 0.0, "low": np.inf, "high": 0.0}

    def add(to, at, low, high, *more):
        for name, value in zip(sums, more, strict=True):
            to[name][at] += value
        to["low"][at], to["high"][at] = np.minimum(to["low"][at], low), np.maximum(to["high"][at], high)

    def kernel(a, b):
        itself = b is a
        a = _by_missing(a)
        b = a if itself else _by_missing(b)
        sides = (a,) if itself else (a, b)
        found = [{name: np.full(len(side["id"]), value) for name, value in start.items()} for side in sides]
        na, nb = a["n"].astype(float), b["n"].astype(float)
        repeats = bool(a["again"].any() and b["again"].any())
        x = [side["x"][~np.isnan(side["x"])] for side in sides]
        # Up to 1 is every distance of features that aren't negative.
        every = limit >= 1 and least >= 1 and not repeats and max(len(a["runs"]), len(b["runs"])) <= 64 and all(((v >= 0) & (v < 1e300)).all() for v in x)
        if every:
            for side, other, f in zip((a, b), (b, a), found, strict=False):
                f["others"] += other["n"].sum() - (side["n"] if itself else 0)
            for rows, columns, distances in _all_near(a, b, least):
                ends = (rows, columns)
                for k, (low, high, s) in enumerate(distances):
                    side, other = (a, b) if k == 0 else (b, a)
                    met_n = other["n"][ends[1 - k]].sum() - (side["n"][rows] if itself and rows == columns else 0)
                    add(found[0 if itself else k], ends[k], low, high, 0.0, met_n, s)
        for at, d in () if every else _distances(a, b, least):
            # The class itself (and with repeated ids all of the id) is no other: the rest of its samples come below.
            if repeats:
                same = a["id"][at, None] == b["id"][None, :]
                d[same] = np.inf
                others = [nb.sum() - same @ nb, na[at].sum() - na[at] @ same]
            else:
                others = [np.full(len(d), nb.sum()), na[at].sum()]
                if b is a:
                    own = np.arange(at.start, at.stop)
                    d[own - at.start, own] = np.inf
                    others[0] -= nb[at]
            low = [np.fmin.reduce(d, axis=k, initial=np.inf) for k in (1, 0)[: len(sides)]]
            near = d <= limit
            if near.all():
                pairs = [np.full(len(d), nb.sum()), na[at].sum()]
            else:
                np.copyto(d, 0.0, where=~near)
                near = near.astype(float)
                pairs = [near @ nb, na[at] @ near if b is not a else None]
            low = [np.where(v <= limit, v, np.inf) for v in low]
            add(found[0], at, low[0], d.max(axis=1, initial=0.0), others[0], pairs[0], d @ nb)
            if b is not a:
                add(found[1], slice(None), low[1], d.max(axis=0, initial=0.0), others[1], pairs[1], na[at] @ d)
        if b is a:
            # The other samples of the same class.
            rest = np.where(a["again"], 0.0, na - 1)
            near = (rest > 0) & ((~np.isnan(a["x"])).sum(axis=1) >= least) & (limit >= 0)
            add(found[0], slice(None), np.where(near, 0.0, np.inf), 0.0, rest, rest * near, 0.0)
        for side, f in zip(sides, found, strict=True):
            for name in sums:
                f[name] *= np.where(side["again"], side["n"], 1)
        out = {name: np.concatenate([f[name] for f in found]) for name in start}
        return {"id": np.concatenate([side["id"] for side in sides]), **out, "others": out["others"].astype(np.int64), "n": out["n"].astype(np.int64)}

    rows, classes, some = _classes(samples.select("id", "x"))
    # Where all distances count a pair costs little, and a meeting as much as many pairs.
    size = {"block_rows": 8192, "spread": 6} if limit >= 1 else {"block_rows": 4096}
    found = met(classes, kernel, "id long, others long, n long, s double, low double, high double", key="x", once=True, **size)
    out = found.groupBy(F.col("id").alias("__c")).agg(F.sum("others").alias("others"), F.sum("n").alias("pairs"), F.min("low").alias("least"), F.sum("s").alias("s"), F.max("high").alias("greatest")).where("others > 0")
    rows = rows.join(classes.where("NOT again").select("x", F.col("id").alias("__c")), "x", "left").select("id", F.coalesce("__id", "__c").alias("__c"))
    near = F.col("pairs") > 0
    out = (rows.distinct() if some else rows).join(out, "__c")
    return out.select("id", "pairs", F.when(near, F.col("least")).alias("least"), F.when(near, F.col("s") / F.col("pairs")).alias("mean"), F.when(near, F.col("greatest")).alias("greatest"))


def _equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a's and b's values are equal: all such places in a and in b."""
    order = np.argsort(b, kind="stable")
    first, last = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    i = np.repeat(np.arange(len(a)), last - first)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[i]]


def _by_label(samples: DataFrame, least: int, undefined: float | None, each: bool = True) -> DataFrame:
    """(i, li, lj, s, n, w): of each class of samples (id, x, label) the sum and number of a sample's distances to the others of each label; w samples have them.

    Without ``each`` (li, lj, s, n) of all samples of a label, of which kernels return no more than the labels' pairs.
    """

    def kernel(a, b):
        one = _by_missing({"x": a["x"], "of": np.arange(len(a["x"]))})
        two = one if b is a else _by_missing({"x": b["x"], "of": np.arange(len(b["x"]))})
        xa, xb = one["x"], two["x"]
        ia, ib = (np.argsort(v["of"])[side["of"]["row"]] for v, side in ((one, a), (two, b)))
        a, b = a["of"], a["of"] if b is a else b["of"]
        sides = (a,) if b is a else (a, b)
        of, sizes = [], []
        for side, x, at in ((a, xa, ia), (b, xb, ib)):
            labels, label = np.unique(side["label"], return_inverse=True)
            size = np.zeros((len(x), len(labels)))
            np.add.at(size, (at, label), side["n"])
            of.append((labels, label))
            sizes.append(size)
        s, n = ([np.zeros((len(xa), len(of[1][0]))), np.zeros((len(xb), len(of[0][0])))] for _ in range(2))
        same = b is a or a["again"].any() and b["again"].any()
        i, j = _equal(a["id"], b["id"]) if same else (np.zeros(0, int), np.zeros(0, int))
        own, own_n = np.zeros(len(i)), np.zeros(len(i))
        for at, d in _distances(one, two, least):
            known = np.isfinite(d)
            every = known.all()
            if not every:
                np.copyto(d, undefined or 0.0, where=~known)
            counted = None if every or undefined is not None else known.astype(float)
            s[0][at] += d @ sizes[1]
            n[0][at] += sizes[1].sum(axis=0) if counted is None else counted @ sizes[1]
            if b is not a:
                s[1] += d.T @ sizes[0][at]
                n[1] += sizes[0][at].sum(axis=0) if counted is None else counted.T @ sizes[0][at]
            k = (ia[i] >= at.start) & (ia[i] < at.stop)
            own[k], own_n[k] = d[ia[i[k]] - at.start, ib[j[k]]], 1.0 if counted is None else counted[ia[i[k]] - at.start, ib[j[k]]]
        out = {c: [] for c in (("i", "li", "lj", "s", "n", "w") if each else ("li", "lj", "s", "n"))}
        for k, (side, other, at, labels, label, i, j) in enumerate(((a, b, ia, of[1][0], of[1][1], i, j), (b, a, ib, of[0][0], of[0][1], j, i))[: len(sides)]):
            sums, counts = s[k][at], n[k][at]
            # A sample itself, or all of its id.
            out_of = np.where(side["again"][i], other["n"][j], 1)
            np.subtract.at(sums, (i, label[j]), out_of * own)
            np.subtract.at(counts, (i, label[j]), out_of * own_n)
            if not each:
                totals = [np.zeros((len(of[k][0]), len(labels))) for _ in range(2)]
                for total, v in zip(totals, (sums, counts), strict=True):
                    np.add.at(total, of[k][1], v * side["n"][:, None])
                row, column = np.nonzero(totals[1])
                for c, v in (("li", of[k][0][row]), ("lj", labels[column]), ("s", totals[0][row, column]), ("n", totals[1][row, column])):
                    out[c].append(v)
                continue
            times = np.where(side["again"], side["n"], 1)
            row, column = np.nonzero(counts)
            for c, v in (("i", side["id"][row]), ("li", side["label"][row]), ("lj", labels[column]), ("s", (sums * times[:, None])[row, column]), ("n", (counts * times[:, None])[row, column]), ("w", np.where(side["again"], 1, side["n"])[row])):
                out[c].append(v)
        out = {c: np.concatenate(v) for c, v in out.items()}
        return out | {"n": out["n"].astype(np.int64)}

    _, classes, _ = _classes(samples.select("id", "x", F.col("label").cast("long").alias("label")), "label")
    vectors = classes.groupBy("x").agg(F.collect_list(F.struct("id", "label", "n", "again")).alias("of"))
    if not each:
        return met(vectors, kernel, "li long, lj long, s double, n long", 4096, key="x", once=True).groupBy("li", "lj").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    found = met(vectors, kernel, "i long, li long, lj long, s double, n long, w long", 4096, key="x", once=True)
    return found.groupBy("i", "li", "lj").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("w").alias("w"))


def silhouette(samples: DataFrame, least: int = 2) -> DataFrame:
    """KM12: mean silhouette of labelled samples (id, x, label), with partial Bray-Curtis; undefined distances are 1, a sample alone in its label counts 0."""
    mean = F.col("s") / F.col("n")
    rows = _by_label(samples, least, 1.0).groupBy("i").agg(F.max("w").alias("w"), F.min(F.when(F.col("li") == F.col("lj"), mean)).alias("a"), F.min(F.when(F.col("li") != F.col("lj"), mean)).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return rows.agg((F.sum(s * F.col("w")) / F.sum("w")).alias("silhouette"))


def beta_preservation(samples: DataFrame, least: int = 2) -> DataFrame:
    """MT02: (between - within) / (between + within) of mean defined distances, at least 0."""
    same = F.col("li") == F.col("lj")
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("s"))), F.sum(F.when(c, F.col("n"))))
    out = _by_label(samples, least, None, each=False).agg(mean(same).alias("w"), mean(~same).alias("b"))
    return out.select(F.greatest(F.coalesce(F.try_divide(F.col("b") - F.col("w"), F.col("b") + F.col("w")), F.lit(0.0)), F.lit(0.0)).alias("preservation"))


def planar_weights(points: DataFrame, threshold: float | None = None) -> DataFrame:
    """SA01, MT03: of each point (id, lon, lat, z) the sums over all others of w, w * w and w * z.

    ``w`` is the inverse planar distance, or 1 up to ``threshold``. Points at the same place have no inverse distance
    and take no part in it.
    """

    def kernel(a, b):
        d = np.hypot(a["lon"][:, None] - b["lon"][None, :], a["lat"][:, None] - b["lat"][None, :])
        other = a["id"][:, None] != b["id"][None, :]
        if threshold is None:
            w = np.where(other & (d > 0), 1 / np.where(d > 0, d, 1.0), 0.0)
        else:
            w = (other & (d <= threshold)).astype(float)
        return {"id": a["id"], "w": w.sum(axis=1), "ww": (w * w).sum(axis=1), "wz": w @ b["z"]}

    return met(points.select("id", "lon", "lat", "z"), kernel, "id long, w double, ww double, wz double").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("w", "ww", "wz")))


def centred(points: DataFrame) -> DataFrame:
    """``points`` (id, lon, lat, value) and ``z``, the value less its mean."""
    mean = points.agg(F.avg("value").alias("__m"))
    return points.crossJoin(mean).withColumn("z", F.col("value") - F.col("__m")).drop("__m")


def planar_moran(points: DataFrame, threshold: float | None = None) -> DataFrame:
    """SA01: Moran's I of points (id, lon, lat, value) with row-standardised planar weights, its expectation, z-score and two-sided normal p-value.

    The variance is that of the randomisation assumption as the reference has it, with the squares of the standardised
    weights for both of its weight sums. Without a positive variance the p-value is 1.
    """
    z = centred(points).persist()
    rows = planar_weights(z, threshold).where("w > 0").join(z.select("id", "z"), "id")
    lag, square = F.col("wz") / F.col("w"), F.col("ww") / (F.col("w") * F.col("w"))
    sums = rows.agg(F.coalesce(F.sum(F.col("z") * lag), F.lit(0.0)).alias("num"), F.count(F.lit(1)).cast("double").alias("w"), F.coalesce(F.sum(square), F.lit(0.0)).alias("s")).first()
    moments = z.agg(F.count("z").alias("n"), F.sum(F.col("z") ** 2).alias("m2"), F.sum(F.col("z") ** 4).alias("m4")).first()
    z.unpersist()
    n, w, s = moments.n, sums.w, sums.s
    value, expected, score, p = 0.0, None, None, 1.0
    if n and w and moments.m2:
        value = n * sums.num / (w * moments.m2)
    if n > 1:
        expected = -1 / (n - 1)
    if n > 3 and w and moments.m2:
        kurtosis = moments.m4 / n / (moments.m2 / n) ** 2
        randomised = n * ((n * n - 3 * n + 3) * s - n * w * w + 3 * w * w) - kurtosis * ((n * n - n) * s - 2 * n * s + 6 * w * w)
        variance = randomised / ((n - 1) * (n - 2) * (n - 3) * w * w)
        if variance > 0:
            from quadrille.operators.spatial import p_value

            score = (value - expected) / variance**0.5
            p = p_value(score)
    return points.sparkSession.createDataFrame([(n, value, expected, score, p)], "n long, moran_i double, expected double, z_score double, p_value double")


def gradient_detection(cells: DataFrame) -> DataFrame:
    """MT03: (moran, strength, score) of a grid (row_idx, col_idx, value): how well it is ordered, from 0 to 1.

    ``moran`` is Moran's I with inverse planar distances of cells, moved to 0 to 1 (0.5 without variance); ``strength``
    is twice the mean slope over the values' range, at most 1; the score is their mean.
    """
    from quadrille.operators.more import gradient

    points = centred(cells.select((F.col("row_idx") * (1 << 20) + F.col("col_idx")).cast("long").alias("id"), F.col("col_idx").cast("double").alias("lon"), F.col("row_idx").cast("double").alias("lat"), "value"))
    sums = planar_weights(points).join(points.select("id", "z"), "id").agg(F.sum(F.col("z") * F.col("wz")).alias("num"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.sum(F.col("z") ** 2).alias("ss"))
    moran = F.when((F.col("ss") > 0) & (F.col("n") >= 3), (F.col("n") / F.col("w") * F.col("num") / F.col("ss") + 1) / 2).otherwise(F.when(F.col("n") < 3, 0.0).otherwise(0.5))
    across = gradient(cells).withColumnRenamed("gradient", "gx")
    slopes = gradient(across, "col_idx", "row_idx").withColumnRenamed("gradient", "gy")
    strength = F.least(F.lit(1.0), 2 * F.avg(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)) / (F.max("value") - F.min("value") + 1e-8))
    both = sums.select(moran.alias("moran")).crossJoin(slopes.agg(strength.alias("strength")))
    return both.withColumn("score", F.least(F.greatest((F.col("moran") + F.col("strength")) / 2, F.lit(0.0)), F.lit(1.0)))
