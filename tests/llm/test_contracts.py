"""The registered queries themselves, on a small folder of tables: columns, types, folds, thresholds, and plain results."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quadrille.llm.queries import QUERIES
from tests.llm.test_small import WORDS, leaks, removed, sentence, shingles

ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    path = str(tmp_path_factory.mktemp("tables"))
    texts = []
    for k in range(300):
        w = sentence(rng, rng.randint(20, 90)).split()
        if k % 5 == 0:
            w += ["vile", "nastyfun", "nastyfuss"] * 2
        if k % 7 == 0:
            w = [x + "%%%" for x in w]
        rng.shuffle(w)
        texts.append(" ".join(w))
    passage = sentence(rng, 160)
    texts += [f"a {k} {passage[:450]}" for k in range(4)] + [texts[0], texts[0] + " more", None, "", " \n ", "12 34", "\n".join(["same line"] * 50), sentence(rng, 20_000)]
    rows = [(k, t, ["aa", "bb", None][k % 3], f"s{k % 11}" if k % 13 else None, len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k % 7 != 0), int(k % 5 == 0)) for k in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(WORDS[:25])), (2, "Short ITEM, here"), (3, None), (4, ""), (5, " ".join(WORDS[10:30])), (5, "again w1 w2")]
    spark.createDataFrame(items, ITEMS).write.parquet(f"{path}/benchmark.parquet")
    vectors = np.random.default_rng(1).normal(size=(260, 8))
    spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    urls = [(k, u, "x") for k, u in enumerate(["https://a.example.org/es/x", "http://example.org/en/12", "http://b.com/de/", "nothing", None, "http://casino.net/"])]
    spark.createDataFrame(urls, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, texts, vectors, labels


def fold(k, n, r):
    return zlib.crc32(str(k).encode()) % n == r


def test_every_query_has_its_columns(spark, folder):
    want = {
        "op2": "doc_id bigint, held_out boolean, score double, predicted int",
        "op3": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
        "op4": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op6": "query_id bigint, rank int, vec_id bigint, score bigint",
        "op7": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
        "op8": "doc_id bigint, held_out boolean, score double, predicted int",
        "op9": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
        "op10": "page_id bigint, host string, path string, rule string, verdict string",
    }
    for name, query in QUERIES.items():
        columns = dict(query(spark, folder[0]).dtypes)
        for column in want.get(name.split("_")[0], "doc_id bigint").split(", "):
            field, kind = column.split()
            assert columns[field] == kind, (name, field)


@pytest.mark.parametrize("name,folds,held,threshold,label", [("op2_quality_classifier", 5, 0, 0.3, 1), ("op8_toxicity", 3, 1, 0.7, 2)])
def test_classifiers(spark, folder, name, folds, held, threshold, label):
    path, texts, _, labels = folder
    rows = QUERIES[name](spark, path).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    assert all(r.held_out == fold(r.doc_id, folds, held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    got = {r.doc_id: r for r in rows}
    assert np.mean([got[x[0]].predicted == x[label] for x in labels if got[x[0]].held_out]) > 0.95


def test_language(spark, folder):
    path, texts, *_ = folder
    rows = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, path).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        assert rows[k].held_out == fold(k, 3, 1) and 0 <= rows[k].score <= 1
        assert rows[k].lang_pred == "und" if not any(c.isalpha() for c in t or "") else rows[k].lang_pred in ("aa", "bb")


def test_substrings(spark, folder):
    path, texts, *_ = folder
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op9_suffix_dedup"](spark, path).collect()}
    assert [got[k] for k in range(len(texts))] == removed(texts, 400)
    assert sum(r[1] > 0 for r in got.values()) >= 5


def test_near_duplicates_and_leaks(spark, folder):
    path, texts, *_ = folder
    got = {r.doc_id: r for r in QUERIES["op3_minhash_near_dup"](spark, path).collect()}
    sets = [shingles(t, 4) for t in texts]
    assert [got[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
    for k, r in got.items():
        assert r.kept == (r.component_id == k) and r.component_id <= k
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                assert got[a].component_id == got[b].component_id
    for r in QUERIES["op7_decontaminate"](spark, path).collect():
        n, hit, items = leaks(texts[r.doc_id])
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()


def test_top_k_and_urls(spark, folder):
    path, _, vectors, _ = folder
    whole = np.floor(256 * vectors.astype(np.float32).astype(float))
    want = {(q, n + 1, k, -s) for q in range(0, 260, 50) for n, (s, k) in enumerate(sorted((-int(whole[q] @ whole[k]), k) for k in range(260) if k != q)[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in QUERIES["op6_exact_top_k"](spark, path).collect()} == want
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in QUERIES["op10_url_filter"](spark, path).collect()}
    assert got == {0: ("a.example.org", "/es/x", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("b.com", "/de/", "com/de/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("casino.net", "/", None, "allow")}


def test_lines_of_a_long_text(spark):
    from quadrille.llm import lines

    body = "\n".join(f"common {k % 3000}" if k % 2 else f"own {k}" for k in range(40_000))
    rows = [(k, "\n".join(f"common {n}" for n in range(3000)), f"s{k}") for k in range(9)] + [(20, body, "s0")]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=8).where("doc_id = 20").first()
    assert out.text == "\n".join(f"own {k}" for k in range(0, 40_000, 2)) and out.lines.n_removed == 20_000
    # A null source and an empty one are two sites.
    rows = [(k, "edge", f"s{k}") for k in range(6)] + [(8, "edge", None), (9, "edge", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert lines.dedup_lines(docs, sites=8).where("text = ''").count() == 8 and lines.dedup_lines(docs, sites=9).where("text = ''").count() == 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = "doc_id long, text string, lang string, source string, n_chars long"
    for name, schema in (("documents", docs), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", ITEMS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_one_row_of_a_repeated_id(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "b " * 20, "en", "s", 1, "extra"), (1, "a " * 20, "en", "s", 1, "extra"), (2, None, None, None, None, None), (None, "null id", "en", "s", 1, "x"), (None, "null id", "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _ in range(2):
        got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs.repartition(4), str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted([(1, "a " * 20), (2, None), (None, "null id"), (None, "null id")], key=str)
