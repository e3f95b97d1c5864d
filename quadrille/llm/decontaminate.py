"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one scan of each text.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. The automaton's symbols are the
benchmark's words and its patterns are all windows of ``window`` consecutive item words (an item of fewer words is one
window), so a document is scanned once, word by word, and matches map to byte offsets of the original text.

Defined results: null or empty texts and texts without words have no words and no hits; null or empty items have no
window; repeated items all count; repeated documents each get their own row; an empty benchmark hits nothing; a column
of the input named as the output is replaced, other extra columns are kept.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm import text as tx
from quadrille.llm.arrow import shielded, with_kernel
from quadrille.llm.storage import stored

SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "after_word", "start", "end")])
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]
)


class Automaton:
    """The windows of some items, ready to scan texts."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick
        import pyarrow as pa

        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        data, off = tx.string_buffers(pa.array([body for _, body in items], pa.string()))
        data = tx.lower(data)
        starts, ends, words = tx.word_bounds(data, off, tx.NON_ALNUM)
        hashes = tx.SpanHash(data)(starts, ends)
        self.vocabulary = np.unique(hashes)
        ids = (np.searchsorted(self.vocabulary, hashes) + 1).tolist()
        windows: dict[tuple, set] = {}
        for k, (name, _) in enumerate(items):
            own = ids[words[k] : words[k + 1]]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                windows.setdefault(tuple(own[i : i + window]), set()).add(number[name])
        self.least = min(map(len, windows), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in windows.items():
            self.automaton.add_word(key, (len(key), tuple(found)))
        if windows:
            self.automaton.make_automaton()

    def scan(self, column) -> list:
        data, off = tx.string_buffers(column)
        out = []
        for _, _, d, o in tx.chunks(data, off):
            d = tx.lower(d)
            starts, ends, words = tx.word_bounds(d, o, tx.NON_ALNUM)
            if not self.least:
                out += [(int(n), 0, [], []) for n in np.diff(words)]
                continue
            hashes = tx.SpanHash(d)(starts, ends)
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            ids = np.where(self.vocabulary[at] == hashes, at + 1, 0)
            # Runs of benchmark words that are long enough for a window; texts are kept apart.
            known = np.zeros(len(ids) + 1, bool)
            known[:-1] = ids > 0
            first = known.copy()
            first[1:] &= ~known[:-1]
            first[words[:-1]] |= known[words[:-1]]
            begin = np.flatnonzero(first)
            gaps = np.flatnonzero(~known)
            stop = np.minimum(np.append(begin[1:], len(ids)), gaps[np.searchsorted(gaps, begin)])
            long = stop - begin >= self.least
            begin, stop = begin[long], stop[long]
            by_text = np.searchsorted(begin, words)
            for i in range(len(o) - 1):
                n, spans, items = int(words[i + 1] - words[i]), [], set()
                for k in range(by_text[i], by_text[i + 1]):
                    a = int(begin[k])
                    for end, (length, found) in self.automaton.iter(tuple(ids[a : stop[k]].tolist())):
                        items.update(found)
                        s, e = a + end + 1 - length, a + end + 1
                        while spans and spans[-1][1] >= s:
                            s = min(s, spans.pop()[0])
                        spans.append((s, e))
                out.append((n, sum(e - s for s, e in spans), [self.names[x] for x in sorted(items)], [(s - int(words[i]), e - int(words[i]), int(starts[s] - o[i]), int(ends[e - 1] - o[i])) for s, e in spans]))
        return out


@shielded("text")
def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "decontamination", keep=None, max_chars: int = 16_000_000) -> DataFrame:
    """``docs`` and a struct ``out``: n_words, n_hit (words inside an occurrence of a window), items (ids as strings,
    sorted) and spans (maximal runs of hit words: word numbers, and byte offsets in the UTF-8 text).

    The automaton is broadcast while the benchmark has at most ``max_chars`` characters. A larger one is cut by item
    into parts of about that size; each part is one more pass whose word hits are merged with those so far, so memory
    stays bounded and the result is the same.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).cast("string").alias("body")).where("name IS NOT NULL AND body IS NOT NULL")
    size = items.agg(F.sum(F.length("body"))).first()[0] or 0
    parts = max(1, -(-size // max_chars))
    spark = docs.sparkSession
    names = list(keep) if keep is not None else [c for c in docs.columns if c != out]
    current = docs
    for part in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part)
        rows = spark.sparkContext.broadcast(sorted((r.name, r.body) for r in mine.collect()))
        carried = list(dict.fromkeys([*names, *([text] if part < parts - 1 else []), *(f"__part{k}" for k in range(part))]))
        current = with_kernel(current, text, out if parts == 1 else f"__part{part}", RESULT, lambda rows=rows: Automaton(rows.value, window).scan, carried)
        if part < parts - 1:
            current = stored(current, "decontaminate")  # so that a worker holds one automaton at a time
    if parts == 1:
        return current
    every = lambda field: F.flatten(F.array(*(F.col(f"__part{k}.{field}") for k in range(parts))))
    current = current.select(*names, F.col("__part0.n_words").alias("__words"), F.array_sort(F.array_distinct(every("items"))).alias("__items"), _union(every("spans")).alias("__spans"))
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, x: n + x["after_word"] - x["first_word"])
    return current.select(*names, F.struct(F.col("__words").alias("n_words"), hit.alias("n_hit"), F.col("__items").alias("items"), F.col("__spans").alias("spans")).alias(out))


def _union(spans):
    """Sorted spans as maximal runs of words."""

    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["first_word"].alias("first_word"), F.greatest(last["after_word"], x["after_word"]).alias("after_word"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & F.coalesce(F.try_element_at(done, F.lit(-1))["after_word"] >= x["first_word"], F.lit(False)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{SPAN.simpleString()}>"), add)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of every document."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate(docs, benchmark, out="d", keep=["doc_id"])
    return found.select(
        "doc_id",
        F.col("d.n_words").alias("n_words"),
        F.col("d.n_hit").alias("n_hit"),
        F.size("d.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("d.items"), ","), 256).alias("items_sha256"),
        (F.col("d.n_hit") > 0).alias("contaminated"),
    )


_LOWERED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_LOWERED} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_LOWERED} AS w FROM benchmark),
windows AS (SELECT item, list_slice(w, i + 1, i + 10) AS k FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
keys AS (SELECT DISTINCT item, array_to_string(k, ' ') AS k, len(k) AS l FROM windows),
own AS (SELECT n, p, l, array_to_string(list_slice(w, p + 1, p + l), ' ') AS k FROM (SELECT n, w, l, unnest(range(greatest(len(w) - l + 1, 0))) AS p FROM d, (SELECT DISTINCT l FROM keys))),
hits AS (SELECT n, item, p, l FROM own JOIN keys USING (k, l)),
words AS (SELECT n, count(DISTINCT at_word) AS n_hit FROM (SELECT n, unnest(range(p, p + l)) AS at_word FROM hits) GROUP BY n),
items AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found FROM (SELECT DISTINCT n, item FROM hits) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(found, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (n) LEFT JOIN items USING (n)
"""
