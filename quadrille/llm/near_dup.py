"""MinHash near-duplicates with sequential Bayesian verification.

Words are runs of anything but ASCII white space, after A-Z are lower-cased; a text's set is its distinct runs of
``size`` words (the whole sequence where it has fewer). Two documents are linked if their sets' Jaccard similarity is at
least ``percent`` / 100; a component is what links reach.

Documents with the same set are one node. A signature has 128 MinHash values of 16 bits in 32 bands of 4 (a pair at 0.8
shares no band with a probability of 5e-8) and 384 values of 8 bits that only verification uses. Candidates are verified in two rounds, so that a bucket of a third of all
documents costs no square of pairs: first each member against the bucket's least member; then, in buckets that still
span several components, each member outside the bucket's largest component against the members of other components,
in blocks. Members that are connected already need no comparison, so no link between components is left out; a pair is
compared only in the bucket of the first band that it shares.

A candidate pair's signatures are compared batch by batch; it is dropped as soon as the posterior probability (uniform
prior) that its similarity reaches the threshold is under ``miss``. What survives is confirmed on the full sets.

Defined results: null, empty and blank texts have no set and link with nothing; rows that share a doc_id are one
document, linked by any of their texts; rows with a null doc_id link with nothing, have a null component and are kept;
extra columns are ignored. Empty tables give empty results.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm import text as tx
from quadrille.llm.arrow import with_kernel
from quadrille.llm.components import components
from quadrille.llm.storage import bounded, drop_stored, stored

BANDS, ROWS = 32, 4
BANDED, HASHES = BANDS * ROWS, 512
BYTES = 2 * BANDED + HASHES - BANDED
_BATCHES = (16, 32, 64, 128, 256, 512)
_rng = np.random.default_rng(42)
_XOR, _ODD = _rng.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2), _rng.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = T.StructType([T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("signature", T.ArrayType(T.LongType()))])


def _distinct(column, size: int):
    """(sorted distinct shingle hashes, offsets by text) for each chunk of texts."""
    data, off = tx.string_buffers(column)
    for _, _, d, o in tx.chunks(data, off):
        d = tx.lower(d)
        starts, ends, words = tx.word_bounds(d, o, tx.SPACE)
        hashes, by_text = tx.shingle_hashes(tx.SpanHash(d)(starts, ends), words, size)
        parts = [np.unique(hashes[by_text[i] : by_text[i + 1]]) for i in range(len(o) - 1)]
        counts = np.array([len(p) for p in parts], np.int64)
        yield np.concatenate(parts) if parts else hashes, np.concatenate([[0], np.cumsum(counts)])


def _sign(column, size: int) -> pa.Array:
    n, sums, signatures = [], [[], []], []
    for h, off in _distinct(column, size):
        counts = np.diff(off)
        full = counts > 0
        at = off[:-1][full]
        n.append(counts)
        mins = np.zeros((len(counts), BYTES), np.uint8)
        for k in range(2):
            made = np.zeros(len(counts), np.uint64)
            if len(h):
                made[full] = np.add.reduceat(tx.mix(h ^ np.uint64(0x5851F42D4C957F2D * (k + 1) % 2**64)), at)
            sums[k].append(made.view(np.int64))
        if len(h):
            for k in range(HASHES):
                least = tx.mix(np.minimum.reduceat((h ^ _XOR[k]) * _ODD[k], at))
                if k < BANDED:
                    mins.view(np.uint16)[full, k] = least >> np.uint64(48)
                else:
                    mins[full, BANDED + k] = least >> np.uint64(56)
        signatures.append(mins.view(np.int64))
    n = np.concatenate(n) if n else np.zeros(0, np.int64)
    flat = np.concatenate(signatures).ravel() if signatures else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (BYTES // 8)), pa.array(flat))
    return pa.StructArray.from_arrays([pa.array(n), *(pa.array(np.concatenate(s) if s else np.zeros(0, np.int64)) for s in sums), lists], names=["n", "s1", "s2", "signature"])


def _sets(column, size: int) -> pa.Array:
    values, offsets = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for h, off in _distinct(column, size):
        offsets.append(off[1:] + offsets[-1][-1])
        values.append(h)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(np.concatenate(values).view(np.int64)))


def least_matches(percent: int, miss: float) -> dict[int, int]:
    """By signature values compared: the fewest matches with which the pair may still reach the threshold."""
    x = (np.arange(200_000) + 0.5) / 200_000
    out = {}
    for n in _BATCHES:
        for m in range(n + 1):
            density = m * np.log(x) + (n - m) * np.log1p(-x)
            density = np.exp(density - density.max())
            if density[x >= percent / 100].sum() >= miss * density.sum():
                out[n] = m
                break
    return out


def _survivors(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Rows of ``a`` and ``b`` (signatures; ``a`` may be one) that aren't pruned."""
    alive, matches, before = np.arange(len(b)), np.zeros(len(b), np.int64), 0
    values = lambda x, i, j: x.view(np.uint16)[:, i:j] if j <= BANDED else x[:, BANDED + i : BANDED + j]
    for n in _BATCHES:
        matches = matches + (values(a[alive] if len(a) == len(b) else a, before, n) == values(b[alive], before, n)).sum(axis=1)
        left = matches >= least[n]
        alive, matches, before = alive[left], matches[left], n
        if not len(alive):
            break
    return alive


def _signatures(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).view(np.uint8).reshape(len(column), BYTES)


def _pruned(pairs: DataFrame, signed: DataFrame, least: dict[int, int]) -> DataFrame:
    """The distinct pairs (a, b) whose signatures aren't pruned."""
    found = pairs.join(signed.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a").join(signed.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.select([0, 1]).take(pa.array(_survivors(_signatures(batch.column(2)), _signatures(batch.column(3)), least)))

    return found.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _compared(blocks: DataFrame, least: dict[int, int], parts: int) -> DataFrame:
    """Pairs of a minor row and a row of another component in the same group that aren't pruned.

    A group is (k, i, j); rows come sorted, so a task holds one group at a time.
    """

    def group(band, minor, ids, comps, sigs):
        bands = sigs.view(np.int64)[:, :BANDS]
        for p in np.flatnonzero(minor):
            other = np.flatnonzero((comps != comps[p]) & ~(minor & (ids < ids[p])))
            if len(other) and band:
                other = other[~(bands[other, :band] == bands[p, :band]).any(axis=1)]
            if len(other):
                for q in other[_survivors(sigs[p : p + 1], sigs[other], least)]:
                    yield int(min(ids[p], ids[q])), int(max(ids[p], ids[q]))

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([table.column(c).to_numpy() for c in ("k", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if len(cuts):
                yield from emit(table.slice(0, cuts[-1]), cuts)
            held = table.slice(cuts[-1] if len(cuts) else 0)
        if held is not None and held.num_rows:
            yield from emit(held, np.array([held.num_rows]))

    def emit(table, cuts):
        ids, comps, minor, band, sigs = (*(table.column(c).to_numpy() for c in ("id", "comp", "minor", "band")), _signatures(table.column("signature")))
        fresh = []
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
            fresh += group(int(band[a]), minor[a:b], ids[a:b], comps[a:b], sigs[a:b])
        if fresh:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in fresh], pa.int64()), pa.array([p[1] for p in fresh], pa.int64())], ["a", "b"])

    dealt = blocks.repartition(parts, "k", "i", "j").sortWithinPartitions("k", "i", "j")
    return dealt.select("k", "i", "j", "band", "minor", "id", "comp", "signature").mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    pairs = stored(pairs, "candidates")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.join(bounded(wanted), "id", "left_semi")
    sets = stored(with_kernel(texts, "text", "set", T.ArrayType(T.LongType()), lambda: lambda c: _sets(c, size), ["id"]), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    linked = both.where((F.size("x") > 0) & (100 * shared >= percent * (F.size("x") + F.size("y") - shared)))
    out = stored(linked.select("a", "b"), "links")
    drop_stored(pairs, sets)
    return out


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, miss: float = 1e-5, block: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    least = least_matches(percent, miss)
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signed = with_kernel(docs, "text", "s", SIGNED, lambda: lambda c: _sign(c, size), ["id"])
    signed = stored(signed.select("id", "s.*"), "signed")
    sizes = stored(signed.select("id", "n", "s1", "s2"), "sizes")
    usable = sizes.where("n > 0 AND id IS NOT NULL")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # Nodes are distinct sets, by their least doc_id.
    nodes = stored(usable.groupBy("s1", "s2", "n").agg(F.min("id").alias("id")), "nodes")
    reps = signed.where("n > 0 AND id IS NOT NULL").join(nodes.select("s1", "s2", "id"), ["s1", "s2", "id"], "left_semi").dropDuplicates(["id", "s1", "s2"]).select("id", "signature")
    reps = stored(reps, "reps")
    drop_stored(signed)
    banded = reps.select("id", F.posexplode(F.slice("signature", 1, BANDS)).alias("band", "key")).select(F.xxhash64("band", "key").alias("k"), "band", "id")
    buckets = banded.groupBy("k").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("k", "least")
    members = stored(banded.join(buckets, "k"), "members")

    stars = members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = _confirmed(_pruned(stars, reps, least), docs, size, percent)
    labels = stored(components(links), "labels")

    placed = members.join(labels.withColumnRenamed("component", "comp"), "id", "left").select("k", "band", "id", F.coalesce("comp", "id").alias("comp"))
    placed = stored(placed.distinct(), "placed")
    drop_stored(members)
    by_comp = placed.groupBy("k", "comp").agg(F.count(F.lit(1)).alias("rows"))
    split = by_comp.groupBy("k").agg(F.max(F.struct("rows", "comp")).alias("top"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    split = split.select("k", F.col("top.comp").alias("major"), F.ceil((F.col("rows") - F.col("top.rows")) / block).cast("int").alias("minors"), F.ceil(F.col("rows") / block).cast("int").alias("alls"))
    open_rows = placed.join(split, "k").withColumn("minor", F.col("comp") != F.col("major"))
    spread = F.xxhash64("id", F.lit(5))
    as_minor = open_rows.where("minor").select("k", F.pmod(spread, "minors").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"), "band", "id", "comp", F.lit(True).alias("minor"))
    as_any = open_rows.select("k", F.explode(F.sequence(F.lit(0), F.col("minors") - 1)).alias("i"), F.pmod(spread, "alls").cast("int").alias("j"), "band", "id", "comp", F.lit(False).alias("minor"))
    blocks = as_minor.unionByName(as_any).join(reps, "id")
    more = _confirmed(_compared(blocks, least, parts), docs, size, percent)

    # Rows that share a doc_id tie their sets together.
    repeated = usable.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id")
    ties = usable.join(bounded(repeated), "id", "left_semi").join(nodes.select("s1", "s2", F.col("id").alias("rep")), ["s1", "s2"])
    edges = labels.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more).unionByName(ties.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    final = stored(components(edges), "components")
    drop_stored(labels, links, more, placed, reps)

    nodes = nodes.join(final, "id", "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("component"))
    found = sizes.join(nodes, ["s1", "s2", "n"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, percent=80)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 4), ' ') AS k FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS in_both FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * in_both >= 80 * (x.n + y.n - in_both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""
