"""Toxicity from two class-conditional Kneser-Ney models of expressions, with shared backoff counts.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. An expression is a word, or one of
its stems: its first bytes, at the lengths of ``LEVELS``. In each class (toxic, ordinary) an expression's probability is
its absolutely discounted count in the class, and what the discount frees, given to the probability of the next shorter
expression and the expression's share of it. The shares, and the shortest stem's probability, are continuation counts
of both classes together: distinct words before the words that the expression stands for. So an expression that one
class never had is judged by its stem, and a rare stem by the common counts, not by chance.

A toxic text is an ordinary one in which about one word in ``1 / MIXED`` comes from the toxic model: a word's toxic
probability is that mixture's. A text's score is a logistic function of its difference of the two log-likelihoods,
normalised by its length in words (and ``PRIOR`` words without evidence, which keep short texts from the ends). Its two
coefficients are fitted on training rows that the counts leave out.

``DISCOUNT`` is 2: what a class had at most twice is no evidence, so an expression counts for itself only where a class
had it more often, and else its stem does. Only such expressions need a place in the model, and nothing is lost by that.
Probabilities of a word after the word before it were measured and left out: on documents with many near copies they
learn the copies (held out on sf0.1, 108 of 144 toxic rows found and 10 of 1,200 others flagged with them, 129 and 2
without). The words before a word count as its continuations.

Counts are taken from all labelled training rows but the calibration rows, and grow with them; an expression is known by
a 64-bit hash, and no other shares its count. At most ``held`` expressions, the most frequent ones, are broadcast (a
documented bound of memory); any others stay a table, and the words that need them are joined with it by key. Both ways
give the same scores.

Defined results: null and empty texts, and texts without words, have a difference of 0 and so the score of the intercept
alone; very long texts are read whole; without labels of both classes all scores are 0; repeated documents each get a
row, and count each time; a doc_id with several labels counts with the largest; equal texts get equal scores; extra
columns are kept, and one that has the output's name is replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm import text as tx
from quadrille.llm.arrow import shielded, with_kernel
from quadrille.llm.quality import held_out
from quadrille.llm.storage import bounded, drop_stored, stored

#: Bytes of an expression at each level; 0 is the whole word.
LEVELS = (0, 7, 5)
DISCOUNT, MIXED, PRIOR = 2, 0.003, 50
#: Expressions that are broadcast, 16 bytes each, and bits of the filter of those that are joined.
HELD, FILTER = 4_000_000, 27
#: Coefficients where no calibration row tells: 0.5 for a fiftieth.
PLAIN = np.array([200.0, -4.0])
_U = np.uint64


def _words(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words' expressions at each level, and word offsets by text."""
    data = tx.lower(data)
    starts, ends, words = tx.word_bounds(data, off, tx.NON_ALNUM)
    spans = tx.SpanHash(data)
    return [spans(starts, ends if not n else np.minimum(ends, starts + n)) for n in LEVELS], words


def _before(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The word before each word; a fixed value at the start of a text."""
    out = np.ones_like(h)
    out[1:] = h[:-1]
    first = words[:-1]
    out[first[first < len(h)]] = _U(1)
    return out


COUNTED = "e long, a long, b long, n0 long, n1 long"


def _counted(batches):
    """For each word (e, its stems a and b, n by class), and for each pair (e, the word before it as a, b null), distinct in a chunk."""
    for batch in batches:
        data, off = tx.string_buffers(batch.column(0))
        label = batch.column(1).to_numpy()
        for i, j, d, o in tx.chunks(data, off, 4 * tx.CHUNK):
            (h, *stems), words = _words(d, o)
            distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(at, minlength=len(distinct))
            n1 = np.bincount(at, weights=np.repeat(label[i:j], np.diff(words)), minlength=len(distinct)).astype(np.int64)
            # Pairs by the number of the word: they come out sorted, which compresses well.
            # A word before is known by 48 bits: of a million different ones about 0.002 share them with another.
            context, before = np.unique(_before(h, words) >> _U(16), return_inverse=True)
            pairs = np.unique(at.astype(np.int64) * max(1, len(context)) + before)
            own, none = pa.array(distinct.view(np.int64)), pa.nulls(len(pairs), pa.int64())
            zero = pa.array(np.zeros(len(pairs), np.int64))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(s[first].view(np.int64)) for s in stems), pa.array(n - n1), pa.array(n1)], ["e", "a", "b", "n0", "n1"])
            yield pa.RecordBatch.from_arrays([own.take(pa.array(pairs // max(1, len(context)))), pa.array(context[pairs % max(1, len(context))].view(np.int64)), none, zero, zero], ["e", "a", "b", "n0", "n1"])


def counted(rows: DataFrame) -> DataFrame:
    """(e, s1, s2, n0, n1, k) of each word of ``rows`` (text, label): its stems, counts by class, distinct words before it."""
    found = rows.mapInArrow(_counted, COUNTED).groupBy("e", "a", "b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    word = F.col("b").isNotNull()
    return found.groupBy("e").agg(F.max(F.when(word, F.col("a"))).alias("s1"), F.max("b").alias("s2"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count_if(~word).alias("k"))


def ratios(words: DataFrame) -> tuple[DataFrame, np.ndarray] | None:
    """(level, key, ratio, n) of the expressions that a class had more than ``DISCOUNT`` times, and the levels' ratios of what the discount frees.

    ``ratio`` is log P(expression | toxic) - log P(expression | ordinary). That of any other expression is its level's
    and its stem's, or its level's alone. None without words of both classes.
    """
    counts = ["n0", "n1", "k"]
    levels = [words.select(F.col("e").alias("key"), F.col("s1").alias("above"), *counts), None, None]
    sums = [F.sum(c).alias(c) for c in counts]
    levels[1] = words.groupBy(F.col("s1").alias("key")).agg(F.max("s2").alias("above"), *sums)
    levels[2] = words.groupBy(F.col("s2").alias("key")).agg(*sums)
    low = lambda c: F.sum(F.least(F.col(c), F.lit(DISCOUNT))).alias(f"m{c[1]}")
    totals = [level.agg(*sums, low("n0"), low("n1")).first() for level in levels]
    if not (totals[0].n0 and totals[0].n1):
        return None
    freed = [np.array([t.m0 / t.n0, t.m1 / t.n1]) for t in totals]
    out, above = None, None
    for number in (2, 1, 0):
        held = levels[number].where(F.greatest("n0", "n1") > DISCOUNT)
        if above is not None:  # an expression that is held has a stem that is held
            held = held.join(above.select(F.col("key").alias("above"), F.col("p0").alias("q0"), F.col("p1").alias("q1"), F.col("k").alias("whole")), "above")
        share = F.col("k") / (F.lit(float(totals[number].k)) if above is None else F.col("whole"))
        p = [(F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0)) / float(totals[number][f"n{c}"]) + F.lit(float(freed[number][c])) * share * (F.col(f"q{c}") if above is not None else F.lit(1.0))).alias(f"p{c}") for c in (0, 1)]
        above = held.select("key", *counts, *p)
        entries = above.select(F.lit(number).alias("level"), "key", (F.log("p1") - F.log("p0")).alias("ratio"), (F.col("n0") + F.col("n1")).alias("n"))
        out = entries if out is None else out.unionByName(entries)
    return out, np.array([np.log(f[1] / f[0]) for f in freed])


def _bits(keys: np.ndarray, level: int) -> np.ndarray:
    return tx.mix(keys + _U(level)) >> _U(64 - FILTER)


class Model:
    """Ratios of the expressions that are held, by level; ``rest``, if any, filters the expressions that are left to a join."""

    def __init__(self, held: list[tuple[np.ndarray, np.ndarray]], rest: np.ndarray | None, freed: np.ndarray):
        self.held, self.rest, self.freed = held, rest, freed

    def looked_up(self, h: list[np.ndarray]) -> list[np.ndarray]:
        """The ratios held for words' expressions, by level; NaN where there is none."""
        out = []
        for (keys, values), own in zip(self.held, h, strict=True):
            at = np.searchsorted(keys, own)
            known = at < len(keys)
            known[known] = keys[at[known]] == own[known]
            found = np.full(len(own), np.nan)
            found[known] = values[at[known]]
            out.append(found)
        return out

    def ratio(self, found: list[np.ndarray]) -> np.ndarray:
        out = 0.0
        for own, freed in zip(found[::-1], self.freed[::-1], strict=True):
            out = np.where(np.isnan(own), out + freed, own)
        return out

    def measured(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each text: the difference of its log-likelihoods, words, and of words left to the join offsets by text and (keys, ratios held, n, difference so far)."""
        data, off = tx.string_buffers(column)
        sums, lengths, counts, rests = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], []
        for _, _, d, o in tx.chunks(data, off):
            levels, words = _words(d, o)
            distinct, first, at = np.unique(levels[0], return_index=True, return_inverse=True)
            own = [level[first] for level in levels]
            found = self.looked_up(own)
            value = mixed(self.ratio(found))
            total = np.concatenate([[0.0], np.cumsum(value[at])])
            sums.append(total[words[1:]] - total[words[:-1]])
            lengths.append(np.diff(words))
            if self.rest is None:
                continue
            left = np.zeros(len(distinct), bool)
            for k, (h, f) in enumerate(zip(own, found, strict=True)):
                bit = _bits(h, k)
                left |= np.isnan(f) & ((self.rest[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63)) & _U(1)) > 0)
            left &= np.isnan(found[0])  # a word that is held needs no stem
            text = np.repeat(np.arange(len(o) - 1), np.diff(words))
            chosen = np.flatnonzero(left[at])
            pairs, n = np.unique(text[chosen] * max(1, len(distinct)) + at[chosen], return_counts=True)
            word = pairs % max(1, len(distinct))
            counts.append(np.bincount(pairs // max(1, len(distinct)), minlength=len(o) - 1))
            rests.append([*(h[word] for h in own), *(f[word] for f in found), n, value[word]])
        rest = [np.concatenate(x) for x in zip(*rests, strict=True)]
        return np.concatenate(sums), np.concatenate(lengths), np.cumsum(np.concatenate(counts)), rest


def mixed(ratio: np.ndarray) -> np.ndarray:
    """What a word adds to a text's difference: the toxic model is the ordinary one but for one word in 1 / MIXED."""
    return np.log1p(MIXED * np.expm1(np.minimum(ratio, 600.0)))


_MEASURED = [T.StructField("difference", T.DoubleType()), T.StructField("words", T.LongType())]
_REST = [*((f"k{n}", pa.int64()) for n in range(3)), *((f"r{n}", pa.float64()) for n in range(3)), ("n", pa.int64()), ("so_far", pa.float64())]
MEASURED = T.StructType(_MEASURED)
JOINED = T.StructType([*_MEASURED, T.StructField("rest", T.ArrayType(T.StructType([T.StructField(c, T.LongType() if pa.types.is_integer(kind) else T.DoubleType()) for c, kind in _REST])))])


def _measured(docs: DataFrame, shared: Broadcast, tail: DataFrame | None, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``__f``, the normalised difference of each text; expressions that the model leaves to ``tail`` are joined."""

    joined = tail is not None

    def kernel(column):
        difference, words, off, rest = shared.value.measured(column)
        out = [pa.array(difference), pa.array(words)]
        if joined:
            rest = [x.view(np.int64) if x.dtype == np.uint64 else x for x in rest] if rest else [[] for _ in _REST]
            parts = [pa.array(x, kind, from_pandas=True) for x, (_, kind) in zip(rest, _REST, strict=True)]
            off = off if len(off) > len(words) else np.zeros(len(words) + 1)
            out.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.StructArray.from_arrays(parts, names=[c for c, _ in _REST])))
        return pa.StructArray.from_arrays(out, names=["difference", "words", "rest"][: len(out)])

    names, words = [F.col(f"`{c}`") for c in keep], F.col("__m.words") + PRIOR
    if tail is None:
        return with_kernel(docs, text, "__m", MEASURED, lambda: kernel, keep).select(*names, (F.col("__m.difference") / words).alias("__f"))
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    rows = stored(with_kernel(numbered, text, "__m", JOINED, lambda: kernel, [*keep, "__row"]), "measured")
    left = rows.select("__row", F.explode("__m.rest").alias("r")).select("__row", "r.*")
    freed = shared.value.freed
    ratio = F.lit(0.0)
    for n in (2, 1, 0):
        own = tail.where(F.col("level") == n).select(F.col("key").alias(f"k{n}"), F.col("ratio").alias(f"t{n}"))
        left = left.join(own, f"k{n}", "left")
        ratio = F.coalesce(f"r{n}", f"t{n}", ratio + float(freed[n]))
    more = F.col("n") * (F.log1p(MIXED * F.expm1(F.least(ratio, F.lit(600.0)))) - F.col("so_far"))
    gains = left.groupBy("__row").agg(F.sum(more).alias("__gain"))
    return rows.join(gains, "__row", "left").select(*names, ((F.col("__m.difference") + F.coalesce("__gain", F.lit(0.0))) / words).alias("__f"))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method with a small ridge on the standardised feature."""
    mean, scale = x.mean(), x.std() or 1.0
    x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.array([w[0] / scale, w[1] - w[0] * mean / scale])


def _arrays(entries: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and ratios by level."""
    found = entries.select("level", "key", "ratio").toArrow()
    level, key, ratio = (found.column(c).to_numpy() for c in ("level", "key", "ratio"))
    out = []
    for n in range(len(LEVELS)):
        keys, values = key[level == n].view(np.uint64), ratio[level == n]
        order = np.argsort(keys)
        out.append((keys[order], values[order]))
    return out


def _filtered(tail: DataFrame) -> np.ndarray:
    """The bits of the keys of ``tail``."""
    mark = lambda batches: (pa.RecordBatch.from_arrays([pa.array(bits >> _U(6)).cast(pa.int32()), pa.array((_U(1) << (bits & _U(63))).view(np.int64))], ["at", "bits"]) for b in batches for bits in [_bits(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().astype(np.uint64))])
    found = tail.select("key", "level").mapInArrow(mark, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", calibration_rows: int = 5000, held: int = HELD) -> tuple[Broadcast, np.ndarray, DataFrame | None] | None:
    """The broadcast model, the coefficients of the score and the expressions left to a join, if any; None without rows of both classes.

    About ``calibration_rows`` labelled rows (a documented bound), at most a fifth of them, fit the coefficients; all
    others are counted. At most ``held`` expressions are broadcast, the most frequent ones.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("__label"))
    known = stored(known, "known")
    fifth = F.pmod(F.xxhash64("__id", F.lit(8)), F.lit(5)) == 0
    share = min(1.0, calibration_rows / max(1, known.where(fifth).count()))
    left_out = fifth & (F.xxhash64("__id", F.lit(9)) <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text"))
    words = stored(counted(texts.join(bounded(known.where(~left_out)), "__id").select("__text", "__label")), "words")
    found = ratios(words)
    if found is None:
        drop_stored(words, known)
        return None
    entries = stored(found[0], "expressions")
    drop_stored(words)
    sizes = entries.groupBy(F.least("n", F.lit(10_000)).alias("times")).count().orderBy(F.desc("times")).collect()
    least, room = 10_001, held
    for times, size in sizes:
        if size > room:
            break
        least, room = times, room - size
    tail = entries.where(F.col("n") < least) if sizes and sizes[-1].times < least else None
    model = Model(_arrays(entries.where(F.col("n") >= least)), None if tail is None else _filtered(tail), found[1])
    shared = spark.sparkContext.broadcast(model)
    others = _measured(texts.join(F.broadcast(known.where(left_out)), "__id"), shared, tail, "__text", ["__label"]).collect()
    drop_stored(known, *([entries] if tail is None else []))
    y = np.array([r["__label"] for r in others], float)
    w = _logistic(np.array([r["__f"] for r in others]), y) if len(set(y.tolist())) == 2 else PLAIN
    return shared, w, tail


@shielded("text")
def with_toxicity(docs: DataFrame, fitted: tuple[Broadcast, np.ndarray, DataFrame | None] | None, *, text: str = "text", out: str = "toxicity", keep=None) -> DataFrame:
    """``docs`` and the probability that each whole text is toxic."""
    if fitted is None:
        return with_kernel(docs, text, out, T.DoubleType(), lambda: lambda column: np.zeros(len(column)), keep)
    names = [c for c in (keep if keep is not None else docs.columns) if c != out]
    shared, w, tail = fitted
    z = F.col("__f") * float(w[0]) + float(w[1])
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return _measured(docs, shared, tail, text, names).select(*(F.col(f"`{c}`") for c in names), score.alias(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fitted = fit(docs, labels.where(~held_out("doc_id", 3, 1)))
    scored = with_toxicity(docs, fitted, out="score", keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
