"""Line dedup by site spread, in DataFrame functions only.

A line's key is a 128-bit hash of its text without white space at its ends. For each key a HyperLogLog sketch of the
sites (``source``) that have it is built in each task and merged in the shuffle, one small state for each key and task,
so a line that a third of all rows have costs no more than a rare one. Keys whose estimate is within ``band`` of the
threshold get an exact distinct count. Lines on at least ``sites`` distinct sites are boilerplate: they are removed from
every document, all occurrences.

With ``once``, each distinct text counts for one site only (one of those it is on, drawn by a hash of text and site), so
that copies of one whole document don't make its own lines boilerplate; each copy still loses what is. Texts that
differ in anything are distinct. Without it all rows count, as in the SQL of the query.

Defined results: null texts stay null, with no lines; empty texts have one empty line; blank lines are never removed;
rows with a null source count as one site of their own; repeated documents each keep a row; a column of the input that
has the name of an output is replaced. A text whose lines all go becomes empty. Very long texts are read whole, in time
that grows with their length. An empty table gives an empty result; a line on as many sites as the threshold goes.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.arrow import shielded
from quadrille.llm.storage import bounded, drop_stored, stored

_TRIM = " \t\r\x0b\x0c"


def _key(line):
    body = F.btrim(line, F.lit(_TRIM))
    return F.xxhash64(body), F.xxhash64(F.lit(91), body)


def _site(source: str):
    return F.when(F.col(source).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.col(source)))


def boilerplate(lines: DataFrame, *, sites: int, band: float = 0.25, lg_k: int = 10) -> DataFrame:
    """The keys (k1, k2) of ``lines`` (k1, k2, site) with at least ``sites`` distinct sites, and their number ``spread``."""
    # Most lines have one site; a sketch is only needed where the least and greatest site differ.
    spread = lines.groupBy("k1", "k2").agg(F.min("site").alias("least"), F.max("site").alias("most"))
    several = stored(spread.where("least <> most").select("k1", "k2"), "several")
    sketches = lines.join(bounded(several), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    guessed = stored(sketches.select("k1", "k2", F.hll_sketch_estimate("sketch").alias("spread")), "spread")
    near = guessed.where((F.col("spread") >= sites * (1 - band)) & (F.col("spread") <= sites * (1 + band)))
    exact = lines.join(bounded(near.select("k1", "k2")), ["k1", "k2"], "left_semi").distinct().groupBy("k1", "k2").agg(F.count("site").alias("spread"))
    out = stored(guessed.where(F.col("spread") > sites * (1 + band)).unionByName(exact.where(F.col("spread") >= sites)), "boilerplate")
    drop_stored(several, guessed)
    return out


def _once(docs: DataFrame, *, text: str, source: str) -> DataFrame:
    """``docs`` and, as ``__site``, the one site of each text; only texts that are on several sites need a join."""
    same = F.xxhash64(F.col(text)), F.xxhash64(F.lit(91), F.col(text))
    keyed = docs.withColumns({"__t1": same[0], "__t2": same[1], "__own": _site(source)})
    drawn = F.min(F.struct(F.xxhash64("__own", "__t1").alias("draw"), F.col("__own").alias("site")))
    copied = keyed.groupBy("__t1", "__t2").agg(F.min("__own").alias("least"), F.max("__own").alias("most"), drawn.alias("drawn")).where("least <> most")
    copied = stored(copied.select("__t1", "__t2", F.col("drawn.site").alias("__one")), "copied")
    return keyed.join(bounded(copied), ["__t1", "__t2"], "left").withColumn("__site", F.coalesce("__one", "__own")).drop("__t1", "__t2", "__own", "__one")


@shielded("text", "source", "doc_id")
def dedup_lines(docs: DataFrame, *, sites: int = 8, once: bool = False, text: str = "text", source: str = "source", doc_id: str = "doc_id", out: str = "lines") -> DataFrame:
    """``docs`` without its boilerplate lines, and a struct ``out``: n_lines, n_removed."""
    names = [c for c in docs.columns if c != out]
    row = F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"))
    split = F.split(F.col(text), "\n")
    placed = _once(docs, text=text, source=source) if once else docs.withColumn("__site", _site(source))
    lines = placed.select(row.alias("row"), F.col("__site").alias("site"), F.posexplode(split).alias("at", "line"))
    lines = lines.where(F.length(F.btrim("line", F.lit(_TRIM))) > 0).select("row", "site", "at", *(k.alias(n) for k, n in zip(_key(F.col("line")), ("k1", "k2"), strict=True)))
    found = boilerplate(lines.select("k1", "k2", "site"), sites=sites).select("k1", "k2")
    hits = lines.join(bounded(found), ["k1", "k2"], "left_semi").groupBy("row").agg(F.collect_set("at").alias("removed"))
    # Places that stay are a difference of sets, so that a text of many lines that loses many takes no longer than its length.
    joined = docs.select(*(F.col(f"`{c}`") for c in names)).withColumn("__row", row).join(hits.select(F.col("row").alias("__row"), F.col("removed").alias("__removed")), "__row", "left")
    joined = joined.withColumn("__split", split)  # after the join: lines needn't be shuffled beside the text
    places = F.array_except(F.sequence(F.lit(0), F.size("__split") - 1), F.col("__removed"))
    kept = F.when(F.col("__removed").isNull(), F.col(text)).otherwise(F.array_join(F.transform(places, lambda at: F.get("__split", at)), "\n"))
    counts = F.struct(F.coalesce(F.size("__split"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"))
    return joined.withColumn("__counts", F.when(F.col(text).isNull(), F.struct(F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))).otherwise(counts)).withColumn("__kept", kept).select(*(F.col("__kept").alias(c) if c == text else F.col(f"`{c}`") for c in names), F.col("__counts").alias(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = dedup_lines(docs, out="__lines")
    return found.select("doc_id", "__lines.n_lines", F.col("__lines.n_removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


_BODY = "trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, text, source FROM documents),
l AS (SELECT n, coalesce('s' || source, 'none') AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
b AS (SELECT {_BODY} AS body FROM l WHERE {_BODY} <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 8),
k AS (SELECT n, count(*) AS n_lines, count(body) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE body IS NULL), '') AS kept
      FROM l LEFT JOIN b ON {_BODY} = body GROUP BY n)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(kept) AS n_chars_kept, sha256(kept) AS kept_sha256
FROM d LEFT JOIN k USING (n)
"""
