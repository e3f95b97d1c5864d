"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Tokens are runs of ASCII letters, digits and non-ASCII characters, and runs of other characters but white space, in
ASCII lower case. Features are hashed single tokens and pairs of neighbours, each with its share of the text's tokens
times ``SCALE`` (a pair of equal tokens is one feature, whatever the token: repetition); a score is the logistic function of a sparse dot product with a fixed-size weight table.

The model is fitted on at most about ``sample_rows`` labelled rows, taken by a hash of doc_id (a documented bound: one
task trains on them). Everything else covers all rows.

Defined results: null and empty texts, and texts without tokens, get the score of the bias alone; without usable labels
the score is 0.5; a doc_id with several labels counts with the largest; repeated documents each get a row; equal texts
get equal scores; very long texts are read whole; extra columns are kept, and one that has the output's name is replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm import text as tx
from quadrille.llm.arrow import shielded, with_kernel

BITS, SCALE = 18, 24.0


def _classes() -> np.ndarray:
    kinds = np.full(256, 2, np.uint8)
    kinds[~tx.NON_ALNUM] = 1
    kinds[[*range(0x41, 0x5B)]] = 1
    kinds[tx.SPACE] = 0
    return kinds


_KIND = _classes()
_REPEAT = tx.mix(np.array([1], np.uint64))[0]  # the one pair feature of all tokens that come twice in a row


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, offsets by text) of a chunk."""
    data = tx.lower(data)
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[off] = True
    cuts = np.flatnonzero(edge)
    word = kind[cuts[:-1]] > 0 if len(data) else np.zeros(0, bool)
    starts, ends = cuts[:-1][word], cuts[1:][word]
    tokens = np.searchsorted(starts, off)
    h = tx.SpanHash(data)(starts, ends)
    n = np.diff(tokens)
    pairs = np.where(h[:-1] == h[1:], _REPEAT, tx.combine(h[:-1], h[1:])) if len(h) else h
    within = np.ones(len(pairs), bool)
    last = tokens[1:][n > 0] - 1
    within[last[last < len(pairs)]] = False
    # Singles and pairs side by side: a text's features are one range.
    both = np.empty(2 * len(h), np.uint64)
    both[0::2] = h
    both[1::2][: len(pairs)] = pairs
    real = np.ones(2 * len(h), bool)
    real[1::2] = np.append(within, False)[: len(h)]
    counts = np.concatenate([[0], np.cumsum(real)])
    return (both[real] >> np.uint64(64 - BITS)).astype(np.int32), counts[2 * tokens]


def margins(column, weights: np.ndarray, bias: float) -> np.ndarray:
    data, off = tx.string_buffers(column)
    out = [np.zeros(0)]
    for _, _, d, o in tx.chunks(data, off):
        at, by_text = features(d, o)
        sums = np.concatenate([[0.0], np.cumsum(weights[at], dtype=np.float64)])
        n = np.maximum(np.diff(by_text), 1)
        out.append(bias + SCALE * (sums[by_text[1:]] - sums[by_text[:-1]]) / n)
    return np.concatenate(out)


def ftrl(rows: list[tuple[np.ndarray, int]], *, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal updates, one example after another."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        found = z[at]
        return np.where(np.abs(found) <= l1, 0.0, -(found - np.sign(found) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for features_of, y in rows:  # a text's distinct features are found anew each time: holding them all takes more room
            used, counts = np.unique(features_of, return_counts=True)
            at, x = np.append(used, size), np.append(SCALE * counts / max(1, len(features_of)), 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = weights(np.arange(size + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample_rows: int = 12_000) -> tuple[np.ndarray, float]:
    """Weights and bias from about ``sample_rows`` labelled documents, the same ones each time."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    share = min(1.0, sample_rows / max(1, known.count()))
    # xxhash64 is even over all longs: a share of its range is a share of the rows, at most a few hundred more.
    chosen = known.where(F.xxhash64(F.col(doc_id), F.lit(20)) <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text")).join(F.broadcast(chosen), "__id").select("__id", "__text", "__label")

    def featurise(batches):
        for b in batches:
            data, off = tx.string_buffers(b.column(1))
            made = []
            for _, _, d, o in tx.chunks(data, off):
                at, by_text = features(d, o)
                made += [at[by_text[i] : by_text[i + 1]].tobytes() for i in range(len(o) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(made, pa.binary()), b.column(2)], ["id", "features", "label"])

    def train(batches):
        found = sorted((i, f, y) for b in batches for i, f, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        order = np.random.default_rng(1).permutation(len(found))
        w, bias = ftrl([(np.frombuffer(found[k][1], np.int32), found[k][2]) for k in order]) if found else (np.zeros(1 << BITS, np.float32), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])

    model = rows.mapInArrow(featurise, "id long, features binary, label int").repartition(1).mapInArrow(train, "weights binary, bias double").first()
    return np.frombuffer(bytes(model["weights"]), np.float32), model["bias"]


@shielded("text")
def with_quality(docs: DataFrame, model: tuple[np.ndarray, float], *, text: str = "text", out: str = "quality_score", keep=None) -> DataFrame:
    """``docs`` and the probability of label 1 of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        weights, bias = shared.value
        return lambda column: 1 / (1 + np.exp(-np.clip(margins(column, weights, bias), -35, 35)))

    return with_kernel(docs, text, out, T.DoubleType(), start, keep)


def held_out(doc_id: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    scored = with_quality(docs, model, out="score", keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
