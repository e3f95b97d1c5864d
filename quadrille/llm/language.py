"""Language identification by compression with a zstandard raw-content dictionary for each language.

The dictionary of a language is text of its training documents. A text, in lower case, is cut into blocks that are each
compressed with every dictionary; the language whose blocks are smallest in sum is chosen, and it is ``accepted`` where
the margin to the second is at least ``margin`` of its size. A fast compressor decides clear texts; texts whose margin
is under ``doubt`` are compressed again, whole, with an optimal parser.

A dictionary holds at most ``dictionary_bytes`` of text (the documented bound of what is fitted): pieces of
``piece_chars`` characters drawn by a hash of doc_id and place from all places of all training texts of the language, so
that no part of a text is left out of the draw and no long text fills it. Both compressors have the whole dictionary.
Predictions cover whole texts of all rows. At most ``max_languages`` dictionaries are broadcast at a time; more languages
are tried in several passes over the texts that compare the same sizes.

Defined results: null texts and texts without a letter are ``und`` with score 0 and not accepted, and so is every text
if no language could be learned; very long texts are read whole; ties go to the language that sorts first; repeated
documents each get a row; extra columns are kept, and one that has the output's name is replaced.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.arrow import shielded, with_kernel
from quadrille.llm.quality import held_out
from quadrille.llm.storage import bounded

RESULT = T.StructType([T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def dictionaries(docs: DataFrame, *, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", piece_chars: int = 512, dictionary_bytes: int = 32_768) -> dict[str, bytes]:
    """Dictionary content by language."""
    usable = docs.where(F.col(lang).isNotNull() & (F.length(F.col(text)) > 0)).select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    pieces = F.ceil(F.length("text") / F.lit(piece_chars))
    totals = usable.groupBy("lang").agg(F.sum(pieces).alias("pieces"))
    # A share of the hash range for each language: about twice the pieces that fill a dictionary, however large it is.
    wanted = 2 * -(-dictionary_bytes // piece_chars) + 16
    share = totals.select("lang", F.when(F.col("pieces") > wanted, F.lit(float(2**63)) * (2.0 * wanted / F.col("pieces") - 1)).otherwise(F.lit(2.0**63)).alias("most"))
    places = usable.join(bounded(share), "lang").select("lang", "text", "most", "id", F.explode(F.sequence(F.lit(0).cast("long"), pieces.cast("long") - 1)).alias("place"))
    order = F.xxhash64("id", "place", F.length("text"), F.lit(4))
    drawn = places.where(order.cast("double") <= F.col("most")).select("lang", order.alias("h"), F.lower(F.substring("text", (F.col("place") * piece_chars + 1).cast("int"), F.lit(piece_chars))).alias("body"))
    out: dict[str, bytes] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r.lang, r.h, r.body)):
        held = out.setdefault(r.lang, b"")
        if len(held) < dictionary_bytes:
            out[r.lang] = (held + r.body.encode() + b"\n")[:dictionary_bytes]
    return out


def _compressors(content: dict[str, bytes], **settings):
    import zstandard

    params = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **settings)
    out = []
    for lang, body in content.items():
        held = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=params)
        out.append((lang, zstandard.ZstdCompressor(dict_data=held, compression_params=params)))
    return out


class Classifier:
    def __init__(self, content: dict[str, bytes], *, block: int = 1024, margin: float = 0.005, doubt: float = 0.04):
        import zstandard

        self.block, self.margin, self.doubt = block, margin, doubt
        self.fast = _compressors(content, window_log=16, chain_log=14, hash_log=14, search_log=1, min_match=5, target_length=0, strategy=zstandard.STRATEGY_DFAST)
        self.exact = _compressors(content, window_log=16, chain_log=15, hash_log=14, search_log=4, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTULTRA2)

    def sizes(self, body: bytes, compressors) -> list[tuple[int, str]]:
        blocks = [body[i : i + self.block] for i in range(0, len(body), self.block)]
        return sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors)

    @staticmethod
    def body(text: str | None) -> bytes | None:
        """What is compressed of a text; None if it has no letter."""
        return text.lower().encode("utf-8", "replace") if text and any(c.isalpha() for c in text) else None

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        body = self.body(text)
        if body is None or not self.fast:
            return "und", 0.0, False
        ranked = self.sizes(body, self.fast)
        if len(ranked) > 1 and ranked[1][0] - ranked[0][0] < self.doubt * ranked[0][0]:
            ranked = self.sizes(body, self.exact)
        best = ranked[0][0]
        weights = [2.0 ** (-60 * (size - best) / best) for size, _ in ranked]
        return ranked[0][1], 1 / sum(weights), len(ranked) < 2 or ranked[1][0] - best >= self.margin * best


@shielded("text")
def with_language(docs: DataFrame, content: dict[str, bytes], *, text: str = "text", out: str = "detected", keep=None, max_languages: int = 1000, **settings) -> DataFrame:
    """``docs`` and a struct ``out``: language, score, accepted."""
    content = dict(sorted(content.items()))
    if len(content) > max_languages:
        return _in_passes(docs, content, text=text, out=out, keep=keep, max_languages=max_languages, **settings)
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def start():
        classify = Classifier(shared.value, **settings)
        return lambda column: [classify(t) for t in column.to_pylist()]

    return with_kernel(docs, text, out, RESULT, start, keep)


def _in_passes(docs: DataFrame, content: dict[str, bytes], *, text: str, out: str, keep, max_languages: int, **settings) -> DataFrame:
    """``with_language`` with ``max_languages`` dictionaries at a time; the sizes of all languages stay with the row until the last."""
    names = [c for c in (keep if keep is not None else docs.columns) if c != out]
    languages, plain = list(content), Classifier({}, **settings)
    parts = [languages[i : i + max_languages] for i in range(0, len(languages), max_languages)]
    rows = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").cast("string").alias("__body"))
    for kind in ("fast", "exact"):
        made = []
        for n, part in enumerate(parts):
            shared = docs.sparkSession.sparkContext.broadcast({k: content[k] for k in part})

            def start(shared=shared, kind=kind):
                classify = Classifier(shared.value, **settings)

                def sizes(text):
                    body = classify.body(text)
                    return None if body is None else [size for size, _ in sorted(classify.sizes(body, getattr(classify, kind)), key=lambda x: x[1])]

                return lambda column: [sizes(t) for t in column.to_pylist()]

            made.append(f"__{kind}{n}")
            rows = with_kernel(rows, "__body", made[-1], T.ArrayType(T.LongType()), start)
        rows = rows.withColumn("__sizes", F.concat(*made) if kind == "fast" else F.coalesce(F.concat(*made), "__sizes")).drop(*made)
        first, second = (F.array_sort("__sizes")[i] for i in range(2))
        rows = rows.withColumn("__body", F.when(second - first < plain.doubt * first, F.col("__body")))
    weights = F.aggregate("__sizes", F.lit(0.0), lambda total, size: total + F.pow(F.lit(2.0), F.lit(-60.0) * (size - first) / first))
    known = F.col("__sizes").isNotNull()
    language = F.when(known, F.array(*map(F.lit, languages))[F.array_position("__sizes", first).cast("int") - 1]).otherwise("und")
    found = F.struct(language.alias("language"), F.when(known, 1 / weights).otherwise(0.0).alias("score"), F.coalesce(second - first >= plain.margin * first, F.lit(False)).alias("accepted"))
    return rows.select(*(F.col(f"`{c}`") for c in names), found.alias(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = dictionaries(docs.where(~held_out("doc_id", 3, 1)))
    found = with_language(docs, content, out="d", keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col("d.language").alias("lang_pred"), F.col("d.score").alias("score"), F.col("d.accepted").alias("accepted"))
