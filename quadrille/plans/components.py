"""Registry of components by kind and name, with capabilities (EX01-EX03, EX05-EX07, EX13)."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Component:
    name: str
    make: Callable
    formats: frozenset[str] = frozenset()
    capabilities: frozenset[str] = frozenset()
    resolutions: tuple[float, float] = (0.0, float("inf"))


@dataclass
class Registry:
    """EX01, EX02: components by kind; ``register`` is a decorator."""

    kinds: dict[str, dict[str, Component]] = field(default_factory=dict)

    def register(self, kind: str, name: str, *, formats=(), capabilities=(), resolutions=(0.0, float("inf"))):
        def add(make):
            self.kinds.setdefault(kind, {})[name] = Component(name, make, frozenset(formats), frozenset(capabilities), resolutions)
            return make

        return add

    def get(self, kind: str, *names: str) -> Callable:
        """The first of ``names`` that is registered: a fallback chain."""
        for name in names:
            if name in self.kinds.get(kind, {}):
                return self.kinds[kind][name].make
        raise KeyError(f"no {kind} named {' or '.join(names)}; there are {sorted(self.kinds.get(kind, {}))}")

    def find(self, kind: str, *, format: str | None = None, capability: str | None = None, resolution: float | None = None) -> list[str]:
        return [c.name for c in self.kinds.get(kind, {}).values() if (format is None or format in c.formats) and (capability is None or capability in c.capabilities) and (resolution is None or c.resolutions[0] <= resolution <= c.resolutions[1])]


    def decorator(self, kind: str) -> Callable:
        """EX02: ``@registry.decorator("model")("name", formats=...)``: a registering decorator of one kind; a name that is taken is an error."""

        def named(name: str, **what):
            if name in self.kinds.get(kind, {}):
                raise ValueError(f"{kind} {name} is registered already")
            return self.register(kind, name, **what)

        return named

    def listed(self) -> list[tuple[str, str, str, float, float]]:
        """EX02: (kind, name, formats and capabilities, least and greatest resolution)."""
        return sorted((kind, c.name, ",".join(sorted(c.formats | c.capabilities)), *c.resolutions) for kind, by in self.kinds.items() for c in by.values())


#: EX02: the kinds that have decorators of their own.
KINDS = ("raster_source", "resampler", "tile_processor", "model", "features", "cv", "imputer")


def output_exists(spark: SparkSession, path: str) -> bool:
    """EX13: whether a stage's output is complete."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: EX03: analyzers by method name; the module is imported when one is made.
ANALYZERS = {"kmeans": ("quadrille.operators.cluster", "kmeans"), "som": ("quadrille.operators.cluster", "train_som"), "geo_som": ("quadrille.operators.cluster", "train_geo_som"), "legacy_som": ("quadrille.operators.cluster", "train_legacy_som")}


def analyzer(method: str) -> Callable:
    """EX03."""
    from importlib import import_module

    if method not in ANALYZERS:
        raise ValueError(f"no analyzer {method!r}; there are {', '.join(sorted(ANALYZERS))}")
    module, name = ANALYZERS[method]
    return getattr(import_module(module), name)


def fresh(spark: SparkSession, path: str, now: float, days: float | None = None) -> bool:
    """EX13: whether a stage may be skipped: its output is complete and, with ``days``, no older than that at ``now`` (seconds)."""
    if not output_exists(spark, path):
        return False
    p = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    written = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime() / 1000
    return days is None or now - written <= days * 86400


def default_registry() -> Registry:
    from quadrille.operators import cluster, features, models, resample, splits

    r = Registry()
    for name in ("area_weighted", "sum", "sum_legacy", "average", "majority", "nearest", "bilinear", "mean", "max", "min", "median"):
        r.register("resampler", name, capabilities=("upsample",) if name in ("nearest", "bilinear") else ("downsample",))(lambda pixels, ratio, source, nodata=None, method=name: resample.resample(pixels, method, ratio, source, nodata))
    r.register("analyzer", "kmeans")(cluster.kmeans)
    r.register("analyzer", "som")(cluster.train_som)
    r.register("model", "linear_regression")(models.ridge)
    r.register("features", "richness")(features.richness_features)
    r.register("features", "spatial")(features.spatial_features)
    r.register("features", "ecological")(features.ecological_features)
    r.register("imputer", "knn")(features.knn_impute)
    r.register("cv", "spatial_block")(splits.checkerboard)
    r.register("cv", "environmental")(splits.quantile_bands)
    return r
