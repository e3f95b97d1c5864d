"""Exact top-k by integer inner product, with a KD-tree for each shard.

Components become ``floor(256 * x)``. Shards are the leaves of a KD-tree over a bounded sample of ``sample_rows``
vectors, so that a shard's box is tight; a leaf of more than ``shard_rows`` rows (equal vectors fall into one) is dealt on
by a hash of the id. Each shard is split once, at the median of its widest component, down to ``leaf`` rows, and stored in
the order of its tree; every node has its tight bounding box and least id. A query visits nodes best first, by the
largest inner product that a vector in the box can have, until no box can better its kth result.

Each query first searches the shard whose box promises most; its kth score there is propagated: the query goes only to
the other shards whose box can reach it, and their searches start with it. A shard's queries are searched in blocks of
about ``block_rows``; a task holds one shard and one block, so neither grows with the table, and what is shuffled are the
queries of a shard and a shard's rows for each of its blocks. The best k of all shards are the result. Boxes of up to
``max_boxes`` shards are broadcast (a documented bound); with more, queries go to all shards, for the same result.

Defined results: vectors that are null or have null or non-finite components take no part, as queries or candidates; ids
that are null take no part; rows that repeat an id count once, with the vector that sorts first; vectors of different
lengths aren't compared; ties go to the smaller id; fewer than k candidates give fewer rows; an empty table gives none;
extra columns are ignored. Scores beyond a long are held at its ends.
"""

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.storage import bounded, drop_stored, stored

RESULT = "query_id long, vec_id long, score long"


def _depth(rows: int, leaf: int) -> int:
    return max(0, int(np.ceil(np.log2(rows / leaf)))) if rows > leaf else 0


def _ranges(rows: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of each node's rows: halves of its parent's."""
    begin, end = np.zeros(2 ** (depth + 1) - 1, np.int64), np.zeros(2 ** (depth + 1) - 1, np.int64)
    end[0] = rows
    for node in range(2**depth - 1):
        middle = begin[node] + (end[node] - begin[node]) // 2
        begin[2 * node + 1], end[2 * node + 1], begin[2 * node + 2], end[2 * node + 2] = begin[node], middle, middle, end[node]
    return begin, end


def tree_order(vectors: np.ndarray, leaf: int) -> np.ndarray:
    """Row numbers in the order of a KD-tree: each node is split at the median of its widest component."""
    order, depth = np.arange(len(vectors)), _depth(len(vectors), leaf)
    begin, end = _ranges(len(vectors), depth)
    for node in range(2**depth - 1):
        a, b = begin[node], end[node]
        rows = vectors[order[a:b]]
        widest = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
        order[a:b] = order[a:b][np.argpartition(rows[:, widest], (b - a) // 2)]
    return order


class KDTree:
    """Nodes in arrays over rows in tree order: bounding box, least id, range of rows; children of node i are at 2i + 1 and 2i + 2."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int):
        depth = _depth(len(ids), leaf)
        self.ids, self.vectors, self.first_leaf = ids, vectors, 2**depth - 1
        self.begin, self.end = _ranges(len(ids), depth)
        count = len(self.begin)
        self.low, self.high, self.least = np.zeros((count, vectors.shape[1])), np.zeros((count, vectors.shape[1])), np.zeros(count, np.int64)
        for node in range(count - 1, -1, -1):
            if node < self.first_leaf:
                left, right = 2 * node + 1, 2 * node + 2
                self.low[node], self.high[node], self.least[node] = np.minimum(self.low[left], self.low[right]), np.maximum(self.high[left], self.high[right]), min(self.least[left], self.least[right])
            else:
                a, b = self.begin[node], self.end[node]
                self.low[node], self.high[node], self.least[node] = vectors[a:b].min(axis=0), vectors[a:b].max(axis=0), ids[a:b].min()

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of inner products, queries x nodes."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: float, score) -> list[tuple]:
        """The best k (score, -id) with a score of at least ``floor``."""
        best: list[tuple] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            bound = -bound
            if bound < floor or len(best) == k and bound < best[0][0]:
                break  # so is every other box in the heap
            if len(best) == k and bound == best[0][0] and self.least[node] > -best[0][1]:
                continue  # it could only tie, with larger ids
            if node < self.first_leaf:
                heapq.heappush(heap, (-bounds[2 * node + 1], 2 * node + 1))
                heapq.heappush(heap, (-bounds[2 * node + 2], 2 * node + 2))
                continue
            a, b = self.begin[node], self.end[node]
            scores, ids = score(self.vectors[a:b], query), self.ids[a:b]
            able = np.flatnonzero((scores >= (best[0][0] if len(best) == k else floor)) & (ids != query_id))
            if len(able) > k:
                able = able[np.lexsort((ids[able], -scores[able]))[:k]]
            for i in able.tolist():
                entry = (int(scores[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return best


def _vectors(column, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)


def _splits(sample: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """(component, value) of each inner node of a KD-tree with about ``leaves`` leaves, a power of two."""
    depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
    parts, out = [sample], []
    for _ in range(depth):
        below = []
        for part in parts:
            widest = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if len(part) else 0
            value = float(np.median(part[:, widest])) if len(part) else 0.0
            out.append((widest, value))
            side = part[:, widest] < value if len(part) else np.zeros(0, bool)
            below += [part[side], part[~side]]
        parts = below
    return out


def _leaf_of(vectors: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(vectors), np.int64)
    if splits:
        component, value = np.array([c for c, _ in splits]), np.array([v for _, v in splits])
        while node.min(initial=len(splits)) < len(splits):
            node = 2 * node + 1 + (vectors[np.arange(len(vectors)), component[node]] >= value[node])
    return node - len(splits)


def _arranged(table: pa.Table, leaf: int) -> pa.Table:
    """A shard's rows in tree order; its first has the shard's box."""
    vectors = _vectors(table.column("v"), table.num_rows)
    order = tree_order(vectors, leaf)
    box = lambda row: pa.array([row, *[None] * (len(order) - 1)], pa.list_(pa.float64()))
    columns = [table.column(c).take(pa.array(order)) for c in ("dim", "shard", "id", "v")]
    return pa.table([*columns, pa.array(np.arange(len(order))), box(vectors.min(axis=0)), box(vectors.max(axis=0))], names=["dim", "shard", "id", "v", "at", "low", "high"])


def _search_group(table: pa.Table, k: int, leaf: int, step: int = 256) -> pa.Table:
    found: list[tuple] = []
    shard, block = table.filter(pc.is_valid(table.column("at"))).sort_by("at"), table.filter(pc.is_null(table.column("at")))
    if shard.num_rows and block.num_rows:
        ids, vectors = shard.column("id").to_numpy(), _vectors(shard.column("v"), shard.num_rows)
        query_ids, queries, floors = block.column("id").to_numpy(), _vectors(block.column("v"), block.num_rows), block.column("floor").to_pylist()
        tree = KDTree(ids, vectors, leaf)
        exact = vectors.shape[1] * max(1.0, np.abs(vectors).max()) * max(1.0, np.abs(queries).max()) < 2**53  # sums in doubles are exact
        if exact:
            score = lambda rows, q: rows @ q
        else:
            as_int = lambda x: np.array([int(c) for c in x.ravel()], object).reshape(x.shape)
            score = lambda rows, q: np.clip(as_int(rows) @ as_int(q), -(2**63), 2**63 - 1)
        for first in range(0, len(query_ids), step):
            bounds = tree.bounds(queries[first : first + step])
            if not exact:
                bounds = np.full(bounds.shape, np.inf)
            for i, bound in enumerate(bounds, first):
                floor = floors[i]
                best = tree.search(int(query_ids[i]), queries[i], bound, k, -np.inf if floor is None else floor, score)
                found += [(int(query_ids[i]), -minus, s) for s, minus in best]
    columns = list(zip(*found, strict=True)) if found else [[], [], []]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _routed(batches, boxes: dict, seeds: bool, all_shards: dict):
    """A row for each shard that a query goes to: with ``seeds`` the one whose box promises most, else the others that can reach its floor."""
    names = ["dim", "shard", "id", "v", "floor", "seed"]
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = pa.table(batch.filter(pa.array(dims == dim)))
            queries, shards = _vectors(part.column("v"), part.num_rows), all_shards.get(dim, np.zeros(0, np.int64))
            step = max(1, 65_536 // max(1, len(shards)))
            for first in range(0, len(queries) if len(shards) else 0, step):
                q = queries[first : first + step]
                some = part.slice(first, step)
                if dim in boxes:
                    low, high = boxes[dim]
                    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    bounds = np.where(np.abs(bounds) < 2**52, bounds, np.inf)  # beyond, sums in doubles aren't exact
                else:
                    bounds = np.full((len(q), len(shards)), np.inf)
                if seeds:
                    row, at = np.arange(len(q)), np.argmax(bounds, axis=1)
                else:
                    floor = np.array([-np.inf if f is None else f for f in some.column("floor").to_pylist()])
                    row, at = np.nonzero((bounds >= floor[:, None]) & (shards[None, :] != some.column("seed").to_numpy()[:, None]))
                taken = some.take(pa.array(row))
                went = pa.array(shards[at])
                columns = [taken.column("dim"), went, taken.column("id"), taken.column("v"), taken.column("floor"), went if seeds else taken.column("seed")]
                yield from pa.table(columns, names=names).combine_chunks().to_batches()


def top_k(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 50, k: int = 5, shard_rows: int = 16_384, block_rows: int = 8192, leaf: int = 256, sample_rows: int = 32_768, max_boxes: int = 16_384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows whose id is divisible by ``every``, against all other rows."""
    x = F.col(embedding).cast("array<double>")
    usable = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    # Integers are kept as doubles: floor(256 x) of a large x has no long, but is a whole double.
    whole = F.transform(x, lambda c: F.rint(F.lit(256.0) * c) - F.when(F.rint(F.lit(256.0) * c) > F.lit(256.0) * c, 1.0).otherwise(0.0))
    rows = vectors.where(usable).select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"), F.size(embedding).cast("long").alias("dim"))
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v").cast("long"))

    # Shards: leaves of a tree over a sample, dealt on by a hash where a leaf is large.
    totals = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}
    splits = {}
    for dim, total in totals.items():
        some = rows.where(F.col("dim") == dim)
        share = min(1.0, sample_rows / total)
        sampled = some if share == 1 else some.where(F.xxhash64("id", F.lit(6)) <= F.lit(int(-(2**63) + share * (2**64 - 1))))
        leaves = min(-(-total // shard_rows), sample_rows // 16)
        splits[dim] = _splits(np.array([r.v for r in sampled.select("v").collect()]).reshape(-1, dim), leaves) if leaves > 1 else []

    def placed(batches):
        for batch in batches:
            dims, leaves = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                leaves[mine] = _leaf_of(_vectors(batch.column("v").take(pa.array(mine)), len(mine)), splits[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves)], ["id", "v", "dim", "leaf"])

    whole_tables = all(total <= shard_rows for total in totals.values())  # a length's vectors are one shard: nothing to deal
    leaves = None if whole_tables else stored(rows.mapInArrow(placed, "id long, v array<double>, dim long, leaf long"), "vectors")
    if whole_tables:
        dealt = rows.withColumn("shard", F.lit(0).cast("long"))
    else:
        parts = leaves.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).alias("parts"))
        many = bounded(stored(parts.where("parts > 1"), "large"))
        dealt = leaves.join(many, ["dim", "leaf"], "left").withColumn("shard", F.col("leaf") + F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0).cast("long")) * (1 << 32)).drop("leaf", "parts")
    schema = "dim long, shard long, id long, v array<double>, at long, low array<double>, high array<double>"
    trees = stored(dealt.select("dim", "shard", "id", "v").groupBy("dim", "shard").applyInArrow(lambda t: _arranged(t, leaf), schema), "trees")
    if leaves is not None:
        drop_stored(leaves)

    heads = trees.where("at = 0").select("dim", "shard").collect()
    shards = {dim: np.array(sorted(r.shard for r in heads if r.dim == dim), np.int64) for dim in {r.dim for r in heads}}
    boxes = {}
    if len(shards) < len(heads) <= max_boxes:
        found = {(r.dim, r.shard): (r.low, r.high) for r in trees.where("at = 0").select("dim", "shard", "low", "high").collect()}
        boxes = {dim: tuple(np.array([found[dim, s][side] for s in own]) for side in (0, 1)) for dim, own in shards.items()}
    sent = vectors.sparkSession.sparkContext.broadcast((boxes, shards))
    queries = trees.where(F.col("id") % every == 0).select("dim", "id", "v")
    routes = "dim long, shard long, id long, v array<double>, floor long, seed long"

    def routed(asked, seeds):
        return asked.mapInArrow(lambda batches: _routed(batches, sent.value[0], seeds, sent.value[1]), routes)

    def searched(asked):
        """The best k of each of ``asked`` in its shard; a shard meets each block of its queries in one task."""
        blocks = asked.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("blocks"))
        blocks = bounded(stored(blocks, "blocks"))
        block = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks"))
        left = trees.select("dim", "shard", "id", "v", "at").join(blocks, ["dim", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        right = asked.join(blocks, ["dim", "shard"]).withColumn("block", block)
        both = left.select("dim", "shard", "block", "id", "v", "at", F.lit(None).cast("long").alias("floor")).unionByName(right.select("dim", "shard", "block", "id", "v", F.lit(None).cast("long").alias("at"), "floor"))
        return both.groupBy("dim", "shard", "block").applyInArrow(lambda t: _search_group(t, k, leaf), RESULT)

    seeded = stored(routed(queries.withColumns({"floor": F.lit(None).cast("long"), "seed": F.lit(None).cast("long")}), True), "seeded")
    first = stored(searched(seeded), "first")
    if len(shards) == len(heads):  # no other shard to ask
        return _best(first, k)
    floors = first.groupBy("query_id").agg(F.count("score").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "least")
    asked = seeded.join(floors, "id", "left").select("dim", "id", "v", F.col("least").alias("floor"), "seed")
    rest = stored(routed(asked, False), "routed")
    return _best(first.unionByName(searched(rest)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k of all shards; each shard gives at most k rows for a query, all but the seeded ones above the propagated bound."""
    packed = found.select("query_id", F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("vec_id"), F.col("score").alias("score")).alias("r"))
    best = packed.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("r")), 1, k).alias("r"))
    return best.select("query_id", F.posexplode("r").alias("at", "r")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH usable AS (
  SELECT DISTINCT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT))) AS x FROM usable),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
