"""The toxicity models against a plain count of everything, and their ways of holding counts against each other."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, toxicity string"
STEMS = ["kind", "gentle", "walk", "river", "mountain", "sunny", "tables", "window"]
ENDS = ["", "s", "ing", "ed", "er", "able", "ness"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    texts = []
    for k in range(400):
        words = [rng.choice(STEMS) + rng.choice(ENDS) for _ in range(rng.randint(5, 60))]
        if k % 4 == 0:
            words += ["nastyfu" + rng.choice("abcdefgh") for _ in range(3)] + rng.choices(["awful", "Rotten", "Éclair"], k=2)
        rng.shuffle(words)
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    rows = [(k, t, "en", "s", "x") for k, t in enumerate(texts)]
    rows += [(700, None, "en", "s", "x"), (701, "", "en", "s", "x"), (702, texts[0], "en", "s", "x"), (702, texts[0], "en", "s", "x"), (703, " .,; ", None, None, "x"), (704, "river walk " * 40_000 + "awful nastyfua", "en", "s", "x")]
    labels = [(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (5, None), (8, 0), (702, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), rows


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)]


def brute(texts):
    """log P(w | toxic) - log P(w | ordinary) of any word, from all counts of ``texts`` ((text, label), ...)."""
    word, before = [Counter(), Counter()], defaultdict(set)
    for text, label in texts:
        own = tokens(text)
        word[label].update(own)
        for a, b in zip([None, *own], own, strict=False):
            before[b].add(a)
    stems = [lambda w: w[:5], lambda w: w[:7], lambda w: w]
    count = [[Counter(), Counter()] for _ in stems]
    follows = [Counter() for _ in stems]
    for level, stem in enumerate(stems):
        for w, contexts in before.items():
            follows[level][stem(w)] += len(contexts)
            for c in (0, 1):
                count[level][c][stem(w)] += word[c][w]
    total = [sum(c.values()) for c in word]
    freed = [[sum(min(n, 2) for n in count[level][c].values()) / total[c] for c in (0, 1)] for level in range(3)]

    def log_p(w, c):
        p = None
        for level, stem in enumerate(stems):
            e = stem(w)
            # A share that is unknown is the same in both classes.
            share = follows[level][e] / (sum(follows[0].values()) if not level else follows[level - 1][stems[level - 1](w)] or 1) or 1.0
            p = max(count[level][c][e] - 2, 0) / total[c] + freed[level][c] * share * (1.0 if p is None else p)
        return math.log(p)

    return lambda w: log_p(w, 1) - log_p(w, 0)


def test_differences_are_those_of_all_counts(spark, labelled):
    docs, _, rows = labelled
    texts = [(t, k % 4 == 0) for k, t, *_ in rows[:400]]
    given = spark.createDataFrame([(t, int(y)) for t, y in texts], "text string, label int").repartition(7)
    words = toxicity.counted(given)
    # Pairs seen once count as any other: the distinct words before each word.
    before = defaultdict(set)
    for t, _ in texts:
        own = tokens(t)
        for a, b in zip([None, *own], own, strict=False):
            before[b].add(a)
    assert sorted(r.k for r in words.collect()) == sorted(len(x) for x in before.values())
    entries, freed = toxicity.ratios(words)
    model = toxicity.Model(toxicity._arrays(entries), None, freed)
    want = brute([(t, int(y)) for t, y in texts])
    others = [t for _, t, *_ in rows[395:]] + ["unseen words nastyfux awfully", "nastyfun"]
    difference, n, _, _ = model.measured(pa.array(others))
    for text, got, length in zip(others, difference, n, strict=True):
        own = tokens(text)
        assert length == len(own)
        sums = sum(math.log1p(0.003 * math.expm1(want(w))) * k for w, k in Counter(own).items())
        assert got == pytest.approx(sums, abs=1e-9)


def test_held_or_joined_scores_are_the_same(spark, labelled):
    docs, labels, _ = labelled
    scores = []
    for n in (toxicity.HELD, 20, 0):
        fitted = toxicity.fit(docs, labels, held=n)
        assert (fitted[2] is None) == (n == toxicity.HELD)
        scores.append(sorted((r.doc_id, r.toxicity) for r in toxicity.with_toxicity(docs, fitted, keep=["doc_id"]).collect()))
    for other in scores[1:]:
        assert [k for k, _ in other] == [k for k, _ in scores[0]]
        assert np.allclose([p for _, p in other], [p for _, p in scores[0]], atol=1e-9)


def test_held_out_rows_and_defined_results(spark, labelled):
    docs, labels, rows = labelled
    train = labels.where("coalesce(crc32(cast(doc_id AS string)) % 3 <> 1, false)")
    found = toxicity.with_toxicity(docs, toxicity.fit(docs, train))
    assert found.columns == ["doc_id", "text", "lang", "source", "toxicity"] and dict(found.dtypes)["toxicity"] == "double"
    out = found.collect()
    assert len(out) == len(rows) and all(0 <= r.toxicity <= 1 for r in out)
    got = {r.doc_id: r.toxicity for r in out}
    held = [(got[k], k % 4 == 0) for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(p >= 0.7) == y for p, y in held]) > 0.97
    assert got[700] == got[701] == got[703] < 0.5 and got[702] == got[0]
    assert got[704] < 0.5  # two words of 80,002 don't make it toxic


def test_without_both_classes_all_scores_are_zero(spark, labelled):
    docs, labels, _ = labelled
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert one is None
    assert {r.toxicity for r in toxicity.with_toxicity(docs, one).collect()} == {0.0}


def test_few_labels_have_plain_coefficients(spark, labelled):
    docs, labels, _ = labelled
    fitted = toxicity.fit(docs, labels.where("doc_id < 9"), calibration_rows=1)
    assert fitted is None or len(fitted[1]) == 2
