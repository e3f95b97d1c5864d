"""Exact substring dedup: maximal repeats of at least ``length`` bytes, from the interval trees of suffix arrays.

A text's windows of ``length`` bytes are cut into pieces: runs of neighbouring windows that share the occurrence of the
least ``GRAM``-byte gram in them. Equal windows have the same least gram at the same place, so all occurrences of a
repeat meet in the bucket of that gram, whichever documents they are in. Pieces that are the same string are one, with
a count, before anything is shuffled by bucket; buckets with one occurrence are dropped before their text is read.

In a bucket an enhanced suffix array (suffixes by prefix doubling, and longest common prefixes from the same ranks) is
stack-scanned for intervals of common prefixes of at least ``length``. An interval is output where the bytes to the left
of its suffixes differ (or a piece begins), as a maximal repeat with all its occurrences.

A bucket of more than ``variants`` different pieces (a common passage in ever new surroundings) is split: each piece
into halves of its run of windows, by the longer string that all windows of a half share, again and again while a bucket
is that large; at the last step the key is the whole window, so this ends, and no bucket is ever cut short.

Pieces are identified by two 64-bit hashes; other comparisons are of the bytes. Defined results: null texts count as
empty; texts shorter than ``length`` have no windows; rows that repeat a doc_id and text are documents of their own and
repeat each other; null doc_ids are kept; a column of the input named as the output is replaced, others are kept. An
empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quadrille.llm import text as tx
from quadrille.llm.arrow import shielded
from quadrille.llm.storage import drop_stored, stored

GRAM = 128
_PLACE = np.uint64(31)
_AT = np.uint64(2**31 - 1)

PIECE = "id long, h long, p0 int, p1 int, m int, b long, s long"


def pieces(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, place of the least gram, hash of the gram, hash of the piece); places are in the chunk."""
    none = np.zeros(0, np.int64)
    windows = len(data) - length + 1
    if windows <= 0:
        return none, none, none, none, none, none
    spans = tx.SpanHash(data)
    grams = len(data) - GRAM + 1
    at = np.arange(grams)
    hashes = spans(at, at + GRAM)
    least = (hashes >> _PLACE << _PLACE) | at.astype(np.uint64)
    width, wide = length - GRAM + 1, 1
    while 2 * wide <= width:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    place = (np.minimum(least[:windows], least[width - wide : width - wide + windows]) & _AT).astype(np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[:windows]
    ends = off[1:][text] - np.arange(windows) < length  # windows that run into the next text
    fresh = np.ones(windows, bool)
    fresh[1:] = (place[1:] != place[:-1]) | ends[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh & ~ends)
    breaks = np.flatnonzero(fresh | ends)
    after = np.append(breaks, windows)[np.searchsorted(breaks, first, "right")]
    return text[first], first, after - 1, place[first], hashes[place[first]].view(np.int64), spans(first, after - 1 + length).view(np.int64)


def _cut(length: int):
    def run(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            data, off = tx.string_buffers(batch.column(2))
            for i, _, d, o in tx.chunks(data, off):
                text, p0, p1, m, b, s = pieces(d, o, length)
                if len(text):
                    rows = pa.array(text + i)
                    base = o[text]
                    yield pa.RecordBatch.from_arrays([ids.take(rows), hashes.take(rows), *(pa.array((x - base).astype(np.int32)) for x in (p0, p1, m)), pa.array(b), pa.array(s)], ["id", "h", "p0", "p1", "m", "b", "s"])

    return run


def suffix_ranks(data: np.ndarray, off: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(prefix length, rank of each suffix by that prefix) by prefix doubling; texts end in terminators of their own."""
    n = len(data)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    end = off[1:][text]
    at = np.arange(n)
    key, size = np.zeros(n, np.uint64), 7
    for k in range(size):
        symbol = np.zeros(n, np.uint64)
        inside = at + k < end
        symbol[inside] = data[at[inside] + k].astype(np.uint64) + np.uint64(1)
        key = key << np.uint64(9) | symbol
    out = []
    longest = int(np.diff(off).max(initial=0))
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])) if n else 0
        out.append((size, rank))
        if size >= longest or not n or rank[order[-1]] == n - 1:
            return out
        follow = np.where(at + size < end, rank[np.minimum(at + size, n - 1)] + len(off), text)
        key = (rank * (n + len(off) + 1) + follow).astype(np.uint64)
        size *= 2


def repeats(texts: list[bytes], runs: np.ndarray, counts: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """(repeat, text, start, bytes) of the occurrences of maximal repeats of at least ``length`` bytes.

    ``runs`` is the number of first positions of windows in each text, ``counts`` how often the text is there. Left of a
    text's start anything may be, so it counts as different.
    """
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ranks = suffix_ranks(data, off)
    text = np.repeat(np.arange(len(texts)), runs)
    suffix = off[text] + np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    order = np.argsort(ranks[-1][1][suffix])
    text, suffix = text[order], suffix[order]
    room = off[text + 1] - suffix
    lcp = np.zeros(len(suffix) + 1, np.int64)
    if len(suffix) > 1:
        a, b = suffix[:-1], suffix[1:]
        lcp[1:-1] = _exact_lcp(data, ranks, a, b, np.minimum(room[:-1], room[1:]))
    left = np.where(suffix == off[text], 256 + np.arange(len(suffix)), data[np.maximum(suffix - 1, 0)].astype(np.int64))
    # Top intervals: suffixes with a common prefix of the length. One whose left bytes agree has no maximal repeat inside.
    begin = np.flatnonzero(lcp[:-1] < length)
    low, high = np.minimum.reduceat(left, begin), np.maximum.reduceat(left, begin)
    size = np.diff(np.append(begin, len(suffix)))
    several = counts[text] > 1
    alone = np.logical_or.reduceat(several & (left >= 256), begin)
    out: list[tuple[int, int, int, int]] = []
    number = 0
    for k in np.flatnonzero(((size > 1) & (low != high)) | alone):
        a, b = int(begin[k]), int(begin[k] + size[k])
        stack: list[tuple[int, int, int, int]] = []  # (prefix, first suffix, least left, greatest left)
        for i in range(a, b + 1):
            prefix = int(lcp[i]) if a < i < b else 0
            start, least, most = i, 1 << 62, -1
            if i > a:
                start, least, most = i - 1, int(left[i - 1]), int(left[i - 1])
            while stack and stack[-1][0] > prefix:
                depth, start, lo, hi = stack.pop()
                least, most = min(least, lo), max(most, hi)
                if least != most:
                    out += [(number, int(text[j]), int(suffix[j] - off[text[j]]), depth) for j in range(start, i)]
                    number += 1
            if prefix >= length:
                if stack and stack[-1][0] == prefix:
                    _, start, lo, hi = stack.pop()
                    least, most = min(least, lo), max(most, hi)
                stack.append((prefix, start, least, most))
            if i < b and several[i] and left[i] >= 256:
                out.append((number, int(text[i]), 0, int(room[i])))
                number += 1
    return out


def _exact_lcp(data, ranks, a, b, room) -> np.ndarray:
    """Longest common prefixes of pairs of suffixes, from the ranks by descending prefix length."""
    shared, n = np.zeros(len(a), np.int64), len(data)
    for size, rank in reversed(ranks):
        able = shared + size <= room
        shared += size * (able & (rank[np.minimum(a + shared, n - 1)] == rank[np.minimum(b + shared, n - 1)]))
    for _ in range(ranks[0][0] - 1):
        able = shared < room
        shared += able & (data[np.minimum(a + shared, n - 1)] == data[np.minimum(b + shared, n - 1)])
    return shared


COVER = "b long, s long, start int, stop int, repeat long"


def _trimmed(bodies: list[bytes], runs: np.ndarray, counts: np.ndarray, length: int):
    """(pieces left, first window, bodies, runs): pieces cut to the span from their first to their last repeated window.

    A window that is alone by its hash is in no repeat, so nothing is lost; equal hashes are compared later, by bytes.
    """
    off = np.concatenate([[0], np.cumsum([len(x) for x in bodies])]).astype(np.int64)
    piece = np.repeat(np.arange(len(bodies)), runs)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = off[piece] + inside
    hashes = tx.SpanHash(np.frombuffer(b"".join(bodies), np.uint8))(at, at + length)
    ordered = np.sort(hashes)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    found = (counts > 1)[piece]
    if len(again):
        found |= again[np.minimum(np.searchsorted(again, hashes), len(again) - 1)] == hashes
    rows = np.flatnonzero(found)
    if not len(rows):
        return rows, rows, [], rows
    left, first = np.unique(piece[rows], return_index=True)
    last = np.append(first[1:], len(rows)) - 1
    a, z = inside[rows[first]], inside[rows[last]]
    return left, a, [bodies[i][x : y + length] for i, x, y in zip(left.tolist(), a.tolist(), z.tolist(), strict=True)], z - a + 1


def _merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of spans by row."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    wide = int(stop.max(initial=0)) + 1
    reach = np.maximum.accumulate(stop + row * wide) - row * wide
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    return row[first], start[first], reach[np.append(first[1:], len(row)) - 1] if len(row) else stop


def _scan(length: int, merge: bool, limit: int = 1 << 19):
    """Buckets, sorted by b, in batches of about ``limit`` bytes of whole buckets."""

    def emit(rows):
        bodies, runs, counts = rows.column("body").to_pylist(), rows.column("run").to_numpy().astype(np.int64), rows.column("c").to_numpy()
        left, first, bodies, runs = _trimmed(bodies, runs, counts, length)
        found = repeats(bodies, runs, counts[left], length) if len(left) else []
        if found:
            number, text, start, size = (np.array(x, np.int64) for x in zip(*found, strict=True))
            if merge:
                text, start, stop = _merged(text, start, start + size)
                names = np.zeros(len(text), np.int64)
            else:
                stop, name = start + size, {}
                for k, t, a, n in found:
                    if k not in name:
                        name[k] = int.from_bytes(hashlib.blake2b(bodies[t][a : a + n], digest_size=8).digest(), "little", signed=True)
                names = np.array([name[k] for k in number.tolist()], np.int64)
            piece, base = left[text], first[text]
            yield pa.RecordBatch.from_arrays([pa.array(rows.column("b").to_numpy()[piece]), pa.array(rows.column("s").to_numpy()[piece]), pa.array((start + base).astype(np.int32)), pa.array((stop + base).astype(np.int32)), pa.array(names)], ["b", "s", "start", "stop", "repeat"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = table.column("b").to_numpy()
            sizes = np.cumsum(pc.binary_length(table.column("body")).to_numpy())
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
            done = 0
            for k in starts[1:]:
                if sizes[k - 1] - (sizes[done - 1] if done else 0) >= limit:
                    yield from emit(table.slice(done, k - done).combine_chunks())
                    done = int(k)
            held = table.slice(done).combine_chunks()
        if held is not None and held.num_rows:
            yield from emit(held)

    return run


def _halves(length: int, step: int):
    """Pieces cut into runs of at most ``step`` windows, by their place to the gram, with the string they share as key."""
    width = length - GRAM + 1

    def run(batches):
        for batch in batches:
            b, s, m, runs, c, bodies = (batch.column(k).to_pylist() for k in ("b", "s", "m", "run", "c", "body"))
            out = []
            for i, body in enumerate(bodies):
                for q in range(max(0, m[i] - runs[i] + 1) // step, m[i] // step + 1):
                    near, far = q * step, min((q + 1) * step, width) - 1
                    p0, p1 = max(0, m[i] - far), min(runs[i] - 1, m[i] - near)
                    if p0 > p1:
                        continue
                    shared = body[m[i] - near : m[i] - far + length]
                    part = body[p0 : p1 + length]
                    key = hashlib.blake2b(b"%d,%d,%d," % (b[i], q, step) + shared, digest_size=8).digest()
                    name = hashlib.blake2b(part, digest_size=8).digest()
                    out.append((b[i], s[i], p0, p1 - p0 + 1, m[i] - p0, c[i], *(int.from_bytes(x, "little", signed=True) for x in (key, name)), part))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["pb", "ps", "p0", "run", "m", "c", "b", "s", "body"])

    return run


def _grouped(occurrences: DataFrame) -> DataFrame:
    """Buckets (b) with at least two occurrences, and how many different pieces they have."""
    return occurrences.groupBy("b", "s").agg(F.sum("c").alias("c")).groupBy("b").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).where("c > 1").select("b", "v")


def _covered(bodies: DataFrame, length: int, variants: int, parts: int, step: int, merge: bool) -> DataFrame:
    """COVER of the pieces of ``bodies`` (b, s, m, run, c, body, v): different pieces of buckets that have several."""
    small = bodies.where(F.col("v") <= variants).repartition(parts, "b").sortWithinPartitions("b", "s")
    found = stored(small.select("b", "s", "run", "c", "body").mapInArrow(_scan(length, merge), COVER), "cover")
    hot = bodies.where(F.col("v") > variants)
    if hot.isEmpty():
        return found
    half = -(-step // 2)
    cut = stored(hot.select("b", "s", "m", "run", "c", "body").mapInArrow(_halves(length, half), "pb long, ps long, p0 int, run int, m int, c long, b long, s long, body binary"), "halves")
    buckets = stored(_grouped(cut), "buckets")
    again = stored(cut.join(buckets, "b"), "halves")
    drop_stored(cut, buckets)
    whole = again.where("v = 1").select("b", "s", F.lit(0).alias("start"), (F.col("run") + length - 1).cast("int").alias("stop"), F.xxhash64("b", "s").alias("repeat")).distinct()
    distinct = again.where("v > 1").groupBy("b", "s", "m", "run", "body", "v").agg(F.sum("c").alias("c"))
    deeper = stored(distinct, "bodies")
    below = whole.unionByName(_covered(deeper, length, variants, parts, half, merge))
    drop_stored(deeper)
    up = again.select("b", "s", "pb", "ps", "p0").join(below, ["b", "s"]).select(F.col("pb").alias("b"), F.col("ps").alias("s"), (F.col("p0") + F.col("start")).alias("start"), (F.col("p0") + F.col("stop")).alias("stop"), "repeat").distinct()
    return found.unionByName(up)


def repeat_spans(docs: DataFrame, *, length: int = 400, variants: int = 1024, doc_id: str = "doc_id", text: str = "text", broadcast_pieces: int = 500_000, merge: bool = False) -> DataFrame:
    """id, h (xxhash64 of the text), start, stop, repeat: an occurrence of a repeat in a document, by bytes.

    ``repeat`` names the repeated string. A repeat that is longer than a piece comes in overlapping parts. With ``merge``
    overlapping occurrences in a piece are one span, and ``repeat`` is without meaning.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    cut = stored(source.mapInArrow(_cut(length), PIECE), "pieces")
    buckets = stored(_grouped(cut.select("b", "s", F.lit(1).alias("c"))), "buckets")
    shared = stored(cut.join(buckets, "b"), "shared")
    drop_stored(cut, buckets)

    whole = shared.where("v = 1").select("id", "h", F.col("p0").alias("start"), (F.col("p1") + length).alias("stop"), F.xxhash64("b", "s").alias("repeat"))
    # Of each different piece in the other buckets one occurrence is read.
    several = shared.where("v > 1")
    chosen = several.groupBy("b", "s", "v").agg(F.min(F.struct("id", "h", "p0", "p1", "m")).alias("o"), F.count(F.lit(1)).alias("c"))
    chosen = stored(chosen.select("b", "s", "v", "c", "o.*"), "chosen")
    wanted = chosen.groupBy("id", "h").agg(F.collect_list(F.struct("b", "s", "v", "c", "p0", "p1", "m")).alias("pieces"))
    wanted = wanted.select(F.col("id").alias("wid"), F.col("h").alias("wh"), "pieces")
    if chosen.count() <= broadcast_pieces:
        wanted = F.broadcast(wanted)

    def read(batches):
        for batch in batches:
            data, off = tx.string_buffers(batch.column(0))
            lists = batch.column(1)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            p0, p1, m = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("p0", "p1", "m"))
            begin, end = off[row] + p0, off[row] + p1 + length
            whole_data = data.tobytes()
            body = pa.array([whole_data[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(flat.field(k) for k in ("b", "s", "v", "c")), pa.array((m - p0).astype(np.int32)), pa.array((p1 - p0 + 1).astype(np.int32)), body], ["b", "s", "v", "c", "m", "run", "body"])

    same = source["id"].eqNullSafe(wanted["wid"]) & (source["h"] == wanted["wh"])
    once = source.join(wanted, same).select("text", "pieces")
    bodies = stored(once.mapInArrow(read, "b long, s long, v long, c long, m int, run int, body binary"), "bodies")
    drop_stored(chosen)
    cover = _covered(bodies, length, variants, parts, length - GRAM + 1, merge)
    drop_stored(bodies)
    found = several.select("id", "h", "p0", "b", "s").join(cover, ["b", "s"]).select("id", "h", (F.col("p0") + F.col("start")).alias("start"), (F.col("p0") + F.col("stop")).alias("stop"), "repeat")
    return whole.unionByName(found)


REMOVED = T.StructType([T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])


def _without(texts, spans, keep_bytes: bool) -> list[tuple]:
    data, off = tx.string_buffers(texts)
    whole, out = data.tobytes(), []
    flat = spans.flatten()
    lengths = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
    row, start, stop = _merged(np.repeat(np.arange(len(lengths)), lengths), *(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2)))
    by_text = np.searchsorted(row, np.arange(len(lengths) + 1))
    start, stop = start.tolist(), stop.tolist()
    for i in range(len(lengths)):
        left, at = [], int(off[i])
        for k in range(by_text[i], by_text[i + 1]):
            left.append(whole[at : off[i] + start[k]])
            at = int(off[i]) + stop[k]
        kept = b"".join([*left, whole[at : off[i + 1]]])
        size = int(off[i + 1] - off[i])
        out.append((size, size - len(kept), len(left), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
    return out


@shielded("doc_id", "text")
def dedup_substrings(docs: DataFrame, *, length: int = 400, doc_id: str = "doc_id", text: str = "text", out: str = "dedup", keep=None, keep_bytes: bool = True, **settings) -> DataFrame:
    """``docs`` and a struct ``out``: n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""
    spans = repeat_spans(docs, length=length, doc_id=doc_id, text=text, merge=True, **settings)
    spans = spans.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    names = [c for c in (keep if keep is not None else docs.columns) if c != out]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{doc_id}`").cast("long").alias("__own"), F.xxhash64(body).alias("__hash"), body.alias("__text"))
    joined = source.join(spans, source["__own"].eqNullSafe(spans["__id"]) & (source["__hash"] == spans["__h"]), "left").select(*names, "__text", "__spans")
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(out, REMOVED)])
    kind = to_arrow_type(REMOVED)

    def run(batches):
        for batch in batches:
            made = _without(batch.column(len(names)), batch.column(len(names) + 1), keep_bytes)
            fields = [pa.array(x, kind.field(k).type) for k, x in enumerate(zip(*made, strict=True) if made else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.StructArray.from_arrays(fields, names=[f.name for f in kind])], [*names, out])

    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), out="d", keep=["doc_id"], keep_bytes=False)
    return found.select("doc_id", "d.n_bytes", "d.n_removed", "d.n_spans", "d.kept_sha256")
