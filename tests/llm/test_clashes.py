"""Extra columns that are called as the operators call their own change nothing."""

import pytest
from pyspark.sql import functions as F

from quadrille.llm import decontaminate, language, lines, near_dup, packing, quality, substrings, topk, toxicity, url_filter

NAMES = (
    "__kernel_input in_0 kept_0 made __m __f __row __text __label __id row id v dim shard leaf site __split __own __hash __spans __site __part0 __part1 __body __sizes copy copies word rest "
    "a b e k key level ratio name body n s s1 s2 signature set x y h i j at line removed __removed __kept __counts __measured n_tokens cluster source_hash __t1 __t2 __one __words __items pieces m run c "
    "score rank query_id embedding_ label __score LANG"
).split()


@pytest.fixture(scope="module")
def tables(spark):
    texts = ["hello world this is a text " * 3, "hello world this is a text " * 3, None, "", "bonjour le monde " * 40, "zzz\nshared line\nfoo", "x" * 500, "x" * 450]
    rows = [(k, t, f"l{k % 2}", f"s{k}", 5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_of string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "hello world this is a text hello world this is a text"), (2, "bonjour le monde")], "item_id long, text string")
    return docs, docs.select("*", *(F.lit(n).alias(n) for n in NAMES)), labels, items


def test_operators(spark, tables):
    docs, wide, labels, items = tables
    strange = [t.select("*", F.lit(1).alias("__id"), F.lit(1).alias("__label"), F.lit("x").alias("name"), F.lit("y").alias("body")) for t in (labels, items)]
    operators = {
        "quality": lambda d, x, y: quality.with_quality(d, quality.fit(d, x), out="out"),
        "toxicity": lambda d, x, y: toxicity.with_toxicity(d, toxicity.fit(d, x), out="out"),
        "toxicity, joined": lambda d, x, y: toxicity.with_toxicity(d, toxicity.fit(d, x, held=0), out="out"),
        "language": lambda d, x, y: language.with_language(d, language.dictionaries(d, lang="lang_of"), out="out"),
        "language, passes": lambda d, x, y: language.with_language(d, language.dictionaries(d, lang="lang_of"), max_languages=1, out="out"),
        "lines": lambda d, x, y: lines.dedup_lines(d, sites=2, out="out"),
        "lines, once": lambda d, x, y: lines.dedup_lines(d, sites=2, once=True, out="out"),
        "leaks": lambda d, x, y: decontaminate.decontaminate(d, y, out="out"),
        "leaks, parts": lambda d, x, y: decontaminate.decontaminate(d, y, max_chars=20, out="out"),
        "substrings": lambda d, x, y: substrings.dedup_substrings(d, out="out"),
        "urls": lambda d, x, y: url_filter.url_filter(d, url="text", out="out"),
    }
    for name, operator in operators.items():
        plain = sorted(map(str, operator(docs, labels, items).select("doc_id", "text", "out").collect()))
        got = operator(wide, *strange)
        assert got.columns == [*wide.columns, "out"], name
        assert sorted(map(str, got.select("doc_id", "text", "out").collect())) == plain, name
        row = got.first()
        assert all(row[n] == n for n in NAMES), name


def test_operators_that_choose_their_columns(spark, tables):
    docs, wide, *_ = tables
    assert sorted(near_dup.near_duplicates(docs).collect()) == sorted(near_dup.near_duplicates(wide).collect())
    measured = lambda d: packing.measured(d.drop("n_tokens", "cluster"), ["doc_id", "source"])
    assert sorted(packing.pack(measured(docs)).collect(), key=str) == sorted(packing.pack(measured(wide)).collect(), key=str)
    vectors = lambda d: d.withColumns({"vec_id": F.col("doc_id") * 50, "embedding": F.array(F.lit(1.0), F.col("doc_id").cast("double"))})
    assert sorted(topk.top_k(vectors(docs)).collect()) == sorted(topk.top_k(vectors(wide)).collect())


def test_a_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="text"):
        quality.with_quality(spark.range(1), quality.fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")))
