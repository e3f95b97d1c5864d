"""Conflict-constrained best-fit packing of documents into bins of ``capacity`` tokens.

A document of more tokens than a bin holds is cut into full pieces, each alone in a bin, and a rest. Rests are placed
in order of falling length: each goes to the open bin with the least residual that holds it and that has no document of
its source and none of its duplicate cluster, else to a new bin. Bins are ordered by residual in a tree over residuals;
a bin's sources and clusters are bitmaps, and each node of the tree has the bitmap that all bins below share, so the
search for the successor passes over whole ranges of bins that conflict and goes on until the tightest that doesn't.

Documents are dealt by a hash of their row into shards of about ``shard_rows``; each shard is packed by itself, so no
task grows with the corpus and a hot source or cluster is spread over all shards. Rows that are the same in everything
are counted before they are dealt, and each copy's number is part of its hash, so that they are spread as well. A bin
belongs to one shard, so its constraints hold exactly.

Defined results: documents that are null or have no tokens are returned with bin null; null sources and null clusters
conflict with nothing; repeated rows are packed one by one (their cluster keeps them apart); very long texts are counted whole and cut into full
pieces; ties go by id, then hash; extra columns are ignored, whatever their names.
"""

from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm import text as tx
from quadrille.llm.arrow import with_kernel
from quadrille.llm.storage import stored

SCHEMA = "doc_id long, piece int, first_token long, n_tokens long, bin string, slot int, residual long"


class _Residuals:
    """Open bins by residual. Each node has the AND of the bitmaps below it; -1, all ones, where there are none."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.common = [-1] * (2 * self.size)
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def _update(self, residual: int) -> None:
        at, common = residual + self.size, -1
        for _, bitmap in self.bins.get(residual, ()):
            common &= bitmap
        while True:
            self.common[at] = common
            at >>= 1
            if not at:
                return
            common = self.common[2 * at] & self.common[2 * at + 1]
            if common == self.common[at]:
                return

    def add(self, residual: int, number: int, bitmap: int) -> None:
        insort(self.bins.setdefault(residual, []), (number, bitmap))
        self._update(residual)

    def take(self, need: int, own: int) -> tuple[int, int, int] | None:
        """Removes and returns (residual, number, bitmap) of the tightest bin that holds ``need`` and shares no bit."""
        least = need
        while (residual := self._successor(1, 0, self.size, least, own)) is not None:
            for k, (number, bitmap) in enumerate(self.bins[residual]):
                if not bitmap & own:
                    del self.bins[residual][k]
                    if not self.bins[residual]:
                        del self.bins[residual]
                    self._update(residual)
                    return residual, number, bitmap
            least = residual + 1
        return None

    def _successor(self, node: int, low: int, width: int, least: int, own: int) -> int | None:
        """The least residual from ``least`` whose bins don't all have one of the bits ``own`` in common."""
        if low + width <= least or self.common[node] & own:
            return None  # -1 & own is true as well where there are no bins and own has a bit
        if self.common[node] == -1:
            return None
        if width == 1:
            return low
        half = width // 2
        found = self._successor(2 * node, low, half, least, own)
        return found if found is not None else self._successor(2 * node + 1, low + half, half, least, own)


def best_fit(sizes: list[int], bitmaps: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin of each item, residual of each bin); items come in the order in which they are placed."""
    open_bins, placed, residuals = _Residuals(capacity), [], []
    for size, own in zip(sizes, bitmaps, strict=True):
        found = open_bins.take(size, own)
        if found is None:
            found = (capacity, len(residuals), 0)
            residuals.append(capacity)
        residual, number, bitmap = found
        residuals[number] = residual - size
        placed.append(number)
        if residual > size:
            open_bins.add(residual - size, number, bitmap | own)
    return placed, residuals


def _pack_shard(table: pa.Table, capacity: int) -> pa.Table:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("n", "doc_id", "row", "source", "cluster")), strict=True), key=lambda r: (-(r[0] % capacity), r[1] is None, r[1] or 0, r[2]))
    shard = table.column("shard")[0].as_py()
    bits: dict = {}
    bit = lambda kind, value: 0 if value is None else 1 << bits.setdefault((kind, value), len(bits))
    rests = [r for r in rows if r[0] % capacity]
    placed, residuals = best_fit([r[0] % capacity for r in rests], [bit("s", r[3]) | bit("c", r[4]) for r in rests], capacity)
    slots, out = [0] * len(residuals), []
    for r, number in zip(rests, placed, strict=True):
        out.append((r[1], r[0] // capacity, r[0] // capacity * capacity, r[0] % capacity, f"{shard}-{number}", slots[number], residuals[number]))
        slots[number] += 1
    number = len(residuals)
    for r in rows:
        for piece in range(r[0] // capacity):
            out.append((r[1], piece, piece * capacity, capacity, f"{shard}-{number}", 0, 0))
            number += 1
    names = ["doc_id", "piece", "first_token", "n_tokens", "bin", "slot", "residual"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds, strict=True)], names=names)


def pack(docs: DataFrame, *, capacity: int = 2048, tokens: str = "n_tokens", doc_id: str = "doc_id", source: str = "source", cluster: str = "cluster", shard_rows: int = 4096) -> DataFrame:
    """One row for each piece: doc_id, piece, first_token, n_tokens, bin, slot (its place in the bin), residual of the bin."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("n"), F.xxhash64(F.col(source)).alias("source_hash"), F.col(source).alias("source"), F.col(cluster).cast("long").alias("cluster"))
    rows = rows.select("doc_id", "n", F.when(F.col("source").isNotNull(), F.col("source_hash")).alias("source"), "cluster")
    rows = stored(rows.groupBy("doc_id", "n", "source", "cluster").agg(F.count(F.lit(1)).alias("copies")), "lengths")
    shards = max(1, -(-(rows.where("n > 0").agg(F.sum("copies")).first()[0] or 0) // shard_rows))
    dealt = F.xxhash64("doc_id", "n", "source", "cluster", "copy")
    work = _copies(rows.where("n > 0")).select("*", dealt.alias("row")).select("*", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(shards)).alias("shard"))
    packed = work.groupBy("shard").applyInArrow(lambda t: _pack_shard(t, capacity), SCHEMA)
    nothing = _copies(rows.where("n <= 0")).select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("bin"), F.lit(0).alias("slot"), F.lit(None).cast("long").alias("residual"))
    return packed.unionByName(nothing)


def _copies(rows: DataFrame, block: int = 4096) -> DataFrame:
    """A row for each of ``copies``, with its number as ``copy``; rows of more than ``block`` copies are written out by several tasks."""
    numbered = lambda df, first, n: df.withColumn("copy", F.explode(F.sequence(first, first + n - 1))).drop("copies", "block")
    one = F.lit(1).cast("long")
    few = numbered(rows.where(F.col("copies") <= block), one, F.col("copies"))
    blocks = rows.where(F.col("copies") > block).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / F.lit(block)))))
    spread = blocks.repartition("doc_id", "cluster", "block")
    first = F.col("block") * block + 1
    return few.unionByName(numbered(spread, first, F.least(F.lit(block).cast("long"), F.col("copies") - first + 1)))


def _measure(column) -> pa.Array:
    data, off = tx.string_buffers(column)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    counts, same = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, _, d, o in tx.chunks(data, off):
        d = tx.lower(d)
        starts, ends, words = tx.word_bounds(d, o, tx.SPACE)
        n = np.diff(words)
        place = (np.arange(len(starts)) - np.repeat(words[:-1], n)).astype(np.uint64)
        sums = np.zeros(len(starts) + 1, np.uint64)
        np.cumsum(tx.combine(tx.SpanHash(d)(starts, ends), place), out=sums[1:])
        counts.append(n)
        same.append(tx.mix(sums[words[1:]] - sums[words[:-1]]).view(np.int64))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(counts)), pa.array(np.concatenate(same), mask=~known)], names=["n_tokens", "cluster"])


MEASURED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("cluster", T.LongType())])


def measured(docs: DataFrame, keep, text: str = "text") -> DataFrame:
    """``docs[keep]``, n_tokens (words between ASCII white space) and cluster (same words but for ASCII case: same cluster; null texts have none)."""
    return with_kernel(docs, text, "__measured", MEASURED, lambda: _measure, keep).select(*keep, "__measured.n_tokens", "__measured.cluster")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(measured(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "source"]))


