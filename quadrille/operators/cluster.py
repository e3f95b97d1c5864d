"""K-means and self-organising maps on samples with missing features (KM01-KM11, SM01-SM13, WN11).

Each pass is one scan: samples are assigned to the model's centres by an Arrow kernel that holds the (small) model, and
partial sums by centre are aggregated. Only the model reaches the driver.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions.distance import valid_count


def prefiltered(samples: DataFrame, least: int = 2, features: str = "x") -> DataFrame:
    """KM01, KM02: rows with enough features, and their stratum."""
    n = valid_count(features)
    return samples.withColumn("stratum", F.when(n >= 3, "high").when(n == 2, "medium").when(n == 1, "low").otherwise("none")).where(n >= least)


def feature_weights(samples: DataFrame, columns: list[str], method: str = "auto") -> dict[str, float]:
    """KM03: completeness (at least 0.01), variance (log1p), or automatic; they sum to the number of features."""
    row = samples.agg(F.count(F.lit(1)).alias("n"), *(x for c in columns for x in (F.count(c).alias(f"{c}|n"), F.var_pop(c).alias(f"{c}|v"))), F.count_if(F.lit(True) if not columns else sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0).alias("complete")).first()
    n = max(1, row.n)
    if method == "auto":
        method = "completeness" if row.complete / n < 0.2 else "fixed"
    raw = {c: {"completeness": max(row[f"{c}|n"] / n, 0.01), "variance": math.log1p(row[f"{c}|v"] or 0.0)}.get(method, 1.0) for c in columns}
    total = sum(raw.values()) or 1.0
    return {c: w / total * len(columns) for c, w in raw.items()}


def _matrix(column, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(-1, width)


def bray_curtis(x: np.ndarray, y: np.ndarray, least: int, weights: np.ndarray | None = None, zero: float = 0.0) -> np.ndarray:
    """Partial distances, samples x centres; infinite with fewer than ``least`` shared features, ``zero`` where all of them are 0 (maps have no distance there)."""
    w = np.ones(x.shape[1]) if weights is None else weights
    num, den, shared = (np.zeros((len(x), len(y))) for _ in range(3))
    for k in range(x.shape[1]):
        a, b = x[:, k : k + 1], y[:, k][None, :]
        both = ~np.isnan(a) & ~np.isnan(b)
        num += np.where(both, w[k] * np.abs(a - b), 0)
        den += np.where(both, w[k] * (a + b), 0)
        shared += both
    return np.where(shared >= least, np.where(den > 0, num / np.where(den > 0, den, 1), zero), np.inf)


def _haversine(lon: np.ndarray, lat: np.ndarray, places: np.ndarray) -> np.ndarray:
    x, y, u, v = np.radians(lon)[:, None], np.radians(lat)[:, None], *np.radians(places).T[:, None, :]
    h = np.sin((v - y) / 2) ** 2 + np.cos(y) * np.cos(v) * np.sin((u - x) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def assign(samples: DataFrame, centres: np.ndarray, least: int = 2, weights: np.ndarray | None = None, features: str = "x", places: np.ndarray | None = None, spatial: float = 0.3, zero: float = 0.0) -> DataFrame:
    """KM08, SM02: ``samples`` with label (least index wins ties, -1 without any), distance, and the second nearest label.

    With ``places`` (lon, lat) of the centres, samples have lon and lat too and ``spatial`` of the distance is the great
    circle's in 20,000 km, where the features have a distance at all.
    """
    shared = samples.sparkSession.sparkContext.broadcast((centres, weights, places))
    schema = T.StructType([*samples.schema.fields, T.StructField("label", T.IntegerType()), T.StructField("distance", T.DoubleType()), T.StructField("second", T.IntegerType())])
    at, names = samples.columns.index(features), [f.name for f in schema]
    lon, lat = (samples.columns.index(c) for c in ("lon", "lat")) if places is not None else (0, 0)

    def run(batches):
        model, w, where = shared.value
        for batch in batches:
            x = _matrix(batch.column(at), model.shape[1]) if batch.num_rows else np.zeros((0, model.shape[1]))
            d = bray_curtis(x, model, least, w, zero)
            if where is not None:
                km = _haversine(*(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (lon, lat)), where)
                d = np.where(np.isfinite(d), (1 - spatial) * d + spatial * km / 20_000, np.inf)
            order = np.argsort(d, axis=1, kind="stable")[:, :2]
            near = d[np.arange(len(d)), order[:, 0]]
            found = np.isfinite(near)
            second = order[:, 1] if order.shape[1] > 1 else np.full(len(d), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(found, order[:, 0], -1).astype(np.int32)), pa.array(near, mask=~found), pa.array(np.where(found, second, -1).astype(np.int32))], names)

    return samples.mapInArrow(run, schema)


def centre_means(labelled: DataFrame, width: int, features: str = "x") -> dict[int, np.ndarray]:
    """KM06: means of each label's features that aren't missing; as many rows as the model has centres."""
    rows = labelled.where("label >= 0").groupBy("label").agg(F.array(*(F.avg(F.get(features, F.lit(k))) for k in range(width))).alias("m")).collect()
    return {r.label: np.array([np.nan if v is None else v for v in r.m]) for r in rows}


def kmeans_step(samples: DataFrame, centres: np.ndarray, least: int = 2) -> np.ndarray:
    """KM06: one pass of assignment and update; a centre without samples, or a feature without values, stays."""
    out = centres.copy()
    for label, mean in centre_means(assign(samples, centres, least), centres.shape[1]).items():
        out[label] = np.where(np.isnan(mean), centres[label], mean)
    return out


def _place(step: int, seed: int):
    """A number between 0 and 1 for each row, by a hash of its id: the same each time, and another one for each step."""
    return F.greatest(F.xxhash64("id", F.lit(seed), F.lit(step)) / F.lit(2.0**64) + 0.5, F.lit(2.0**-64))


def initial_centres(samples: DataFrame, k: int, seed: int = 42, features: str = "x", method: str = "k-means++", least: int = 2) -> np.ndarray:
    """KM05: k complete samples, drawn by hashes: the same ones each time.

    With ``k-means++`` a sample is drawn next with a probability in proportion to the square of its distance to the
    nearest centre so far: it has an exponential waiting time at that rate, and the shortest wins, which is one
    aggregation for each centre. Where all distances are 0 or undefined, and with ``random``, any sample is drawn.
    """
    complete = samples.where(valid_count(features) == F.size(features))
    if method != "k-means++":
        rows = complete.orderBy(F.xxhash64("id", F.lit(seed))).limit(k).select(features).collect()
        return np.array([[float(v) for v in r[0]] for r in rows])
    centres: list[list[float]] = []
    for step in range(k):
        wait, any_wait = -F.log(_place(step, seed)), F.struct(_place(step, seed), F.col("id"))
        if not centres:
            found = complete.agg(F.min_by(features, any_wait).alias("any"), F.lit(None).cast("array<double>").alias("next")).first()
        else:
            rate = F.col("distance") * F.col("distance")
            far = F.when(rate > 0, F.struct(wait / rate, F.col("id")))
            rows = assign(complete.select("id", features), np.array(centres), least, features=features)
            found = rows.agg(F.min_by(features, any_wait).alias("any"), F.min_by(features, far).alias("next")).first()
        if found["any"] is None:
            break
        centres.append([float(v) for v in found["next"] or found["any"]])
    return np.array(centres)


def kmeans(samples: DataFrame, k: int, *, iterations: int = 20, seed: int = 42, least: int = 2, init: str = "k-means++") -> tuple[np.ndarray, DataFrame, float]:
    """KM06, KM09: (centres, labelled samples, inertia)."""
    samples = samples.persist()
    centres = initial_centres(samples, k, seed, method=init)
    for _ in range(iterations):
        moved = kmeans_step(samples, centres, least)
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    labelled = assign(samples, centres, least)
    inertia = labelled.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0] or 0.0
    samples.unpersist()
    return centres, labelled, inertia


def best_k(scores: dict[int, float], method: str = "elbow") -> int:
    """KM11: the largest silhouette (``silhouette``; the first of equal ones), the elbow of inertias (largest second difference; the middle with fewer than three), else the middle of the range."""
    ks = sorted(scores)
    if method == "silhouette":
        return max(ks, key=lambda k: (scores[k], -k))
    if method != "elbow" or len(ks) < 3:
        return ks[len(ks) // 2]
    second = np.abs(np.diff([scores[k] for k in ks], 2))
    return ks[int(np.argmax(second)) + 1]


def choose_k(samples: DataFrame, ks: list[int], method: str = "silhouette", *, iterations: int = 20, sample_rows: int = 1000, seed: int = 42) -> tuple[int, dict[int, float]]:
    """KM11: (best k, score by k). The silhouette is that of about ``sample_rows`` labelled samples taken by a hash (a documented bound); inertias are of all."""
    from quadrille.operators.pairs import silhouette

    scores: dict[int, float] = {}
    if method in ("silhouette", "elbow"):
        share = min(1.0, sample_rows / max(1, samples.count()))
        for k in ks:
            _, labelled, inertia = kmeans(samples, k, iterations=iterations, seed=seed)
            drawn = labelled.where("label >= 0").where(_place(-1, seed) <= share)
            scores[k] = inertia if method == "elbow" else silhouette(drawn.select("id", "x", "label")).first()[0] or 0.0
    else:
        scores = dict.fromkeys(ks, 0.0)
    return best_k(scores, method), scores


def grid_size(n: int) -> int:
    """SM11."""
    return min(50, max(5, int(math.sqrt(int(math.sqrt(n))))))


def neighbourhood(shape: tuple[int, int], radius: float, kind: str = "gaussian") -> np.ndarray:
    """SM03, SM07: influence of each unit on each other by their distance d on the map: exp(-d^2 / 2 r^2), 1 up to r, or a Mexican hat."""
    at = np.array([(k // shape[1], k % shape[1]) for k in range(shape[0] * shape[1])], float)
    squares = ((at[:, None] - at[None, :]) ** 2).sum(-1) / (radius * radius)
    if kind == "bubble":
        return (squares <= 1.0).astype(float)
    if kind == "mexican_hat":
        return 2 * np.exp(-squares / 2) - np.exp(-squares / 8)
    return np.exp(-squares / 2)


def unit_sums(samples: DataFrame, neurons: np.ndarray, least: int = 2, features: str = "x") -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """SM03, SM05: sums and counts of each feature by best unit, samples by unit, and the quantisation error, in one pass."""
    width = neurons.shape[1]
    sums, counts, hits, error, n = np.zeros(neurons.shape), np.zeros(neurons.shape), np.zeros(len(neurons)), 0.0, 0
    rows = assign(samples, neurons, least, features=features, zero=np.inf).where("label >= 0").groupBy("label")
    parts = [f(F.array(*(g(F.get(features, F.lit(k))) for k in range(width)))) for f, g in ((lambda x: x.alias("s"), F.sum), (lambda x: x.alias("n"), F.count))]
    for r in rows.agg(*parts, F.count(F.lit(1)).alias("hits"), F.sum("distance").alias("d")).collect():
        sums[r.label], counts[r.label], hits[r.label] = [v or 0.0 for v in r.s], r.n, r.hits
        error, n = error + r.d, n + r.hits
    return sums, counts, hits, error / n if n else 0.0


def moved(neurons: np.ndarray, sums: np.ndarray, counts: np.ndarray, influence: np.ndarray, step: float) -> np.ndarray:
    """SM03: units moved towards the mean of what they and their neighbours won. Influence depends on the best unit alone, so smearing its sums is exact."""
    num, den = influence @ sums, influence @ counts
    known = np.abs(den) > 1e-12
    return neurons + step * (np.where(known, num / np.where(known, den, 1), neurons) - neurons)


def train_som(samples: DataFrame, shape: tuple[int, int], *, epochs: int = 10, rate: float = 0.5, seed: int = 42) -> tuple[np.ndarray, list[float]]:
    """SM03, SM05: neurons from random samples and the quantisation error after each epoch; the radius falls linearly, the rate stays."""
    samples = samples.persist()
    neurons = som_start(samples, shape, "random", seed)
    errors, first = [], max(shape) / 2
    sums, counts, _, _ = unit_sums(samples, neurons)
    for e in range(epochs):
        neurons = moved(neurons, sums, counts, neighbourhood(shape, max(0.5, first * (1 - e / epochs))), rate * 0.5)
        sums, counts, _, error = unit_sums(samples, neurons)
        errors.append(error)
    samples.unpersist()
    return neurons, errors


def _filled(samples: DataFrame, features: str = "x") -> tuple[DataFrame, np.ndarray]:
    """Samples whose missing features are their means, and the means."""
    width = len(samples.select(features).first()[0])
    means = samples.agg(*(F.coalesce(F.avg(F.get(features, F.lit(k))), F.lit(0.0)).alias(str(k)) for k in range(width))).first()
    filled = F.array(*(F.coalesce(F.get(features, F.lit(k)).cast("double"), F.lit(float(means[k]))) for k in range(width)))
    return samples.withColumn(features, filled), np.array(means, float)


def pca_plane(samples: DataFrame, shape: tuple[int, int], features: str = "x") -> np.ndarray:
    """SM01: units on a lattice over the plane of the first two principal components, mapped back and not below 0.

    Missing features are means. The covariance and the scores' range are one aggregation each; a component's sign is
    that which makes its largest loading positive.
    """
    filled, means = _filled(samples, features)
    width = len(means)
    dev = [F.get(features, F.lit(k)) - float(means[k]) for k in range(width)]
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    row = filled.agg(F.count(F.lit(1)).alias("n"), *(F.sum(dev[i] * dev[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    covariance = np.zeros((width, width))
    for i, j in pairs:
        covariance[i, j] = covariance[j, i] = row[f"c{i}_{j}"] / max(1, row.n - 1)
    axes = np.linalg.eigh(covariance)[1][:, ::-1][:, :2].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    scores = [sum((dev[k] * float(axis[k]) for k in range(width)), F.lit(0.0)) for axis in axes]
    ends = filled.agg(*(f(x) for x in scores for f in (F.min, F.max))).first()
    across, down = np.linspace(ends[0], ends[1], shape[1]), (np.linspace(ends[2], ends[3], shape[0]) if len(axes) > 1 else np.zeros(shape[0]))
    second = axes[1] if len(axes) > 1 else np.zeros(width)
    return np.array([np.maximum(means + a * axes[0] + b * second, 0) for b in down for a in across])


def som_start(samples: DataFrame, shape: tuple[int, int], method: str = "pca", seed: int = 42, trials: int = 5) -> np.ndarray:
    """SM01: first units: ``pca`` plane, ``stratified`` (k-means centres of mean-filled samples), ``best_of`` (the least quantisation error of ``trials`` random draws) or ``random`` complete samples."""
    n = shape[0] * shape[1]
    if method == "pca":
        return pca_plane(samples, shape)
    if method == "stratified":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = _filled(samples)[0].select(array_to_vector("x").alias("features"))
        found = np.array(KMeans(k=n, seed=seed, maxIter=10).fit(rows).clusterCenters())
        return np.resize(found, (n, found.shape[1]))
    drawn = [initial_centres(samples, n, seed + t, method="random") for t in range(trials if method == "best_of" else 1)]
    drawn = [np.resize(x, (n, x.shape[1])) for x in drawn]
    return min(drawn, key=lambda x: unit_sums(samples, x)[3]) if len(drawn) > 1 else drawn[0]


def neuron_places(points: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """SM01: (lon, lat) of units on a lattice over the points' box."""
    r = points.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    lon, lat = np.linspace(r[0], r[1], shape[1]), np.linspace(r[2], r[3], shape[0])
    return np.array([(x, y) for y in lat for x in lon])


#: SM04: fixed values of the reference: limits of the rate, overall and where the error is high or low, and steps by improvement.
RATE_LIMITS, HIGH_ERROR, LOW_ERROR = (0.01, 0.8), (0.5, (0.5, 0.8)), (0.1, (0.01, 0.1))
RATE_STEPS = ((0.05, 1.05), (0.0, 1.0), (-0.05, 0.98))
WORST_STEP, FINAL_RADIUS, COHERENT, STABLE, PATIENCE, IMPROVED = 0.95, 1.0, 0.7, 0.02, 50, 0.001


def next_rate(rate: float, error: float, best: float) -> float:
    """SM04: the rate after an epoch, by the share that the error fell below the best so far. Against no best (infinity) nothing is an improvement."""
    gain = (best - error) / best if 0 < best < math.inf else (0.0 if best <= 0 else -math.inf)
    step = next((s for least, s in RATE_STEPS if gain > least), WORST_STEP)
    rate = min(max(rate * step, RATE_LIMITS[0]), RATE_LIMITS[1])
    for low, high in ([HIGH_ERROR[1]] if error > HIGH_ERROR[0] else [LOW_ERROR[1]] if error < LOW_ERROR[0] else []):
        rate = min(max(rate, low), high)
    return rate


def rate_stability(history: DataFrame, window: int = 10) -> DataFrame:
    """WN11: ``history`` (run, epoch, rate) with mean, population deviation and their ratio over the last ``window`` epochs; NULL before there are more than that."""
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("epoch")
    last = w.rowsBetween(1 - window, 0)
    enough = F.row_number().over(w) > window
    mean, std = F.avg("rate").over(last), F.stddev_pop("rate").over(last)
    return history.withColumns({"rate_mean": F.when(enough, mean), "rate_std": F.when(enough, std), "stability": F.when(enough, std / mean)})


def converged(rates: list[float], coherence: float, idle: int) -> str | None:
    """SM04: why training ends, if it does: coherent geography, a stable rate, or too many epochs without improvement."""
    if coherence > COHERENT:
        return "coherence"
    if len(rates) > 10 and np.std(rates[-10:]) / np.mean(rates[-10:]) < STABLE:
        return "stable rate"
    return "patience" if idle >= PATIENCE else None


def train_geo_som(samples: DataFrame, shape: tuple[int, int], *, epochs: int = 100, init: str = "pca", rate: float = 0.5, seed: int = 42, coherence=None, every: int = 10) -> tuple[np.ndarray, list[dict], str | None]:
    """SM01, SM03, SM04: (neurons, history by epoch, why it ended before ``epochs`` or None).

    The rate varies with the error, the radius falls linearly from a third of the map to 1. Every ``every`` epochs
    ``coherence(neurons)``, if given, and the rules of ``converged`` are asked. An epoch is one pass over the samples.
    """
    samples = samples.persist()
    neurons = som_start(samples, shape, init, seed)
    first, best, idle, history, ended = max(shape) / 3, math.inf, 0, [], None
    sums, counts, _, _ = unit_sums(samples, neurons)
    for epoch in range(epochs):
        radius = first * (1 - epoch / epochs) + FINAL_RADIUS * epoch / epochs
        neurons = moved(neurons, sums, counts, neighbourhood(shape, radius), rate * 0.5)
        sums, counts, _, error = unit_sums(samples, neurons)
        rate = next_rate(rate, error, best)
        idle = 0 if error < best and (best == math.inf or (best - error) / best >= IMPROVED) else idle + 1
        best = min(best, error)
        history.append({"epoch": epoch, "error": error, "rate": rate, "radius": radius})
        if epoch and epoch % every == 0:
            ended = converged([h["rate"] for h in history], coherence(neurons) if coherence else 0.0, idle)
            if ended:
                break
    samples.unpersist()
    return neurons, history, ended


def train_legacy_som(samples: DataFrame, shape: tuple[int, int], *, epochs: int = 10, kind: str = "gaussian", rate: tuple[float, float] = (0.5, 0.01), radius: tuple[float, float] | None = None, seed: int = 42) -> tuple[np.ndarray, list[dict]]:
    """SM07, as batches: (neurons, history). Rate and radius decay exponentially from their first to their last value; online training is serial and left out."""
    radius = radius or (max(shape) / 2, 1.0)
    decayed = lambda ends, e: max(ends[0] * (ends[1] / ends[0]) ** (e / epochs), ends[1])
    samples = samples.persist()
    neurons, history = som_start(samples, shape, "random", seed), []
    sums, counts, _, _ = unit_sums(samples, neurons)
    for e in range(epochs):
        influence = np.maximum(neighbourhood(shape, decayed(radius, e), kind), 0)  # the reference skips influence that isn't positive
        neurons = moved(neurons, sums, counts, influence, decayed(rate, e))
        sums, counts, _, error = unit_sums(samples, neurons)
        history.append({"epoch": e, "error": error, "rate": decayed(rate, e), "radius": decayed(radius, e)})
    samples.unpersist()
    return neurons, history


def quantisation_error(labelled: DataFrame) -> float:
    """SM05."""
    return labelled.agg(F.avg("distance")).first()[0] or 0.0


def topographic_error(labelled: DataFrame, columns: int) -> DataFrame:
    """SM08: share of samples whose two best units are farther apart than the root of two."""
    d = lambda f: f(F.col("label")) - f(F.col("second"))
    row, column = d(lambda c: F.floor(c / columns)), d(lambda c: c % columns)
    return labelled.where("label >= 0").agg(F.avg((row * row + column * column > 2).cast("int")).alias("topographic_error"))


def u_matrix(neurons: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """SM09: mean distance of each neuron to its up to eight neighbours."""
    grid = neurons.reshape(*shape, -1)
    out = np.zeros(shape)
    for r in range(shape[0]):
        for c in range(shape[1]):
            near = [np.linalg.norm(grid[r, c] - grid[a, b]) for a in range(max(0, r - 1), min(shape[0], r + 2)) for b in range(max(0, c - 1), min(shape[1], c + 2)) if (a, b) != (r, c)]
            out[r, c] = np.mean(near) if near else 0.0
    return out


def importance(neurons: np.ndarray) -> np.ndarray:
    """SM13: each feature's share of the neurons' variance."""
    v = neurons.var(axis=0)
    return v / v.sum() if v.sum() else v
