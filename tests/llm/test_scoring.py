"""Operators that learn: exact parts against brute force, the rest by held-out accuracy on planted data."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import docstats, lang_id, quality_pu, quality_rules, toxicity
from plumbline.llm.common import in_training

ODD = [None, "", " \n\t", "a", "a a a a", "x y\n\nx y\n x y\nx y", "é😀 ñ ñ\u0085b #*$%&|<>", "one two three one two three four\r\none two three", "w " * 500, "same line here\n" * 40]


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)]


def test_statistics_equal_brute_force():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a ", "b ", "c\n", "é ", "#", "ab\t"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    got = docstats.base(texts)
    for i, text in enumerate(texts):
        assert [int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == brute_stats(text), text
    assert docstats.features(got).shape == (len(texts), len(docstats.NAMES)) and np.isfinite(docstats.features(got)).all()
    assert docstats.features(docstats.base([])).shape == (0, len(docstats.NAMES))


def planted(spark, n=900, seed=2):
    """Documents of two made-up languages with good and bad quality and toxic sentences; a copy of columns that clash."""
    rng = random.Random(seed)
    syllables = {"aa": ["ta", "re", "mi", "no", "su"], "bb": ["kol", "wex", "zut", "bri", "pah"]}
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        word = lambda: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5)))  # noqa: B023, E731
        sentences = [" ".join(word() for _ in range(rng.randrange(4, 12))) for _ in range(rng.randrange(6, 20))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.8
        if toxic:
            sentences[rng.randrange(len(sentences))] += rng.choice([" vileword", " nastyish"]) + " " + word()
        text = ". ".join(sentences) + "."
        if not good:
            text = rng.choice([lambda t: t.replace(" ", "### "), lambda t: (t[:60] + "\n") * 30, lambda t: t.upper().replace(" ", "!! ")])(text)
        docs.append((i, text, lang, 0.5))
        if rng.random() < 0.8:
            labels.append((i, int(good), int(toxic), "x"))
    docs += [(n + k, t, None, 0.5) for k, t in enumerate(ODD)] + [(None, "ta re", "aa", 0.5), (0, docs[0][1], "aa", 0.5)]
    labels += [(None, 1, 1, "x"), (n + 1, None, None, "x"), (3, 1, 0, "x"), (3, 1, 0, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = planted(spark)
    return docs.cache(), labels.cache()


def truth(labels, column):
    return {r["doc_id"]: r[column] for r in labels.where(~in_training(labels["doc_id"])).collect() if r["doc_id"] is not None and r[column] is not None}


def test_positive_unlabelled_quality(spark, tables):
    docs, labels = tables
    model = quality_pu.fit(docs, labels)
    out = quality_pu.scored(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "predicted"] and out.count() == docs.count()
    rows, want = {r["doc_id"]: r for r in out.collect()}, truth(labels, "quality")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    assert sum(rows[i]["predicted"] == y for i, y in want.items()) >= 0.93 * len(want)
    kept = quality_pu.scored(docs, model, least=0.5)
    assert kept.schema == docs.schema and kept.count() == out.where("predicted = 1").count()


def test_quality_without_rows_or_positives(spark, tables):
    docs, labels = tables
    model = quality_pu.fit(docs.limit(0), labels, prior=0.5)
    assert np.allclose(model.score(["a b", None]), 0.5)
    assert np.allclose(quality_pu.fit(docs, labels.limit(0)).score(["a b", ""]), 0.5)
    assert quality_pu.scored(docs.limit(0), model).count() == 0


def test_non_negative_risk_is_minimised(spark, tables):
    """The model's non-negative risk is not above those of models nearby."""
    docs, labels = tables
    model = quality_pu.fit(docs, labels, prior=0.8)
    marks = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    rows = docs.where(in_training(docs["doc_id"])).collect()
    x = np.clip((quality_pu.inputs([r["text"] for r in rows]) - model.center) / model.scale, -quality_pu.FAR, quality_pu.FAR)
    positive = np.array([r["doc_id"] in marks for r in rows])

    def risk(w):
        f = x @ w[:-1] + w[-1]
        p, u = np.logaddexp(0, -f)[positive].mean(), np.logaddexp(0, f).mean()
        return 0.8 * p + max(0.0, u - 0.8 * np.logaddexp(0, f)[positive].mean()) + 5e-4 * (w[:-1] ** 2).sum()

    rng = np.random.default_rng(0)
    best = risk(model.weights)
    assert all(best <= risk(model.weights + rng.normal(0, s, len(model.weights))) + 2e-3 for s in (0.01, 0.1, 0.5) for _ in range(20))


def test_toxicity(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    out = toxicity.scored(docs, model)
    rows, want = out.collect(), truth(labels, "toxic")
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert sum(by[i]["predicted"] == y for i, y in want.items()) >= 0.95 * len(want)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    spans = [(r["doc_id"], s) for r in rows if r["predicted"] for s in r["sentences"]]
    assert spans and sum(bool(re.search("vileword|nastyish", texts[i][s["start"] : s["end"]], re.I)) for i, s in spans) >= 0.9 * len(spans)
    assert all(r["score"] == 0 for r in rows if not (texts[r["doc_id"]] or "").strip())


def test_noisy_or():
    model = toxicity.train(["good words. vileword here", "good words", "fine. fine", "vileword"] * 20, np.array([1, 0, 0, 1] * 20))
    text = "fine words. vileword vileword. good\nvileword!"
    *_, p = model.sentences([text])
    assert math.isclose(model.score([text])[0][0], 1 - np.prod(1 - p), rel_tol=1e-9) and len(p) == 4
    assert toxicity.train([], np.zeros(0)).score(["a", None])[0].shape == (2,)
    assert toxicity.scored.__doc__


def phrases(text, sample):
    """Cross parsing by str.find, over the whole text."""
    total, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at += n if text[at] in sample else 1
        total += 1
    return total


def test_cross_parsing_equals_brute_force():
    rng = random.Random(4)
    samples = {"a": "".join(rng.choice("abcd ") for _ in range(400)), "b": "".join(rng.choice("cdefé😀 ") for _ in range(300)), "c": "x" * 900 + "abc" * 500}
    model = lang_id.train(samples)
    texts = ["".join(rng.choice("abcdefé😀 #") for _ in range(rng.randrange(1, 700))) for _ in range(30)] + ["abc" * 300, "x" * 2500, samples["a"][7:] * 3, "#" + samples["c"], "a" * 256, "ab" * 128 + "c"]
    got = model.costs(texts)
    for i, text in enumerate(texts):
        for k, lang in enumerate(model.languages):
            assert math.isclose(got[i, k], phrases(text, samples[lang]) * math.log2(len(samples[lang])) / len(text), rel_tol=1e-9), (i, lang)


def test_language_sample_is_drawn_by_row(spark):
    """Rows of one id, copies, long texts and few rows: every language is learned."""
    a, b, c = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    rows = [(a, "ta re mi no %d" % i, "aa") for i in range(400)] + [(b, "kol wex zut", "bb")] * 300 + [(c, "lon gon " * 9000, "cc")] + [(None, "x y", "dd"), (a, None, "ee"), (a, "", "ff")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(docs)
    want = {lang for i, t, lang in rows if i is not None and t and zlib.crc32(str(i).encode()) % 3 != 1}
    assert set(model.languages) == want and want
    assert lang_id.identified(docs.limit(0), model).count() == 0


def test_language_of_held_out_rows(spark, tables):
    docs, _ = tables
    model = lang_id.fit(docs)
    rows = lang_id.identified(docs, model).collect()
    want = {r["doc_id"]: r for r in docs.where(~in_training(docs["doc_id"]) & docs["lang"].isNotNull()).collect()}
    assert len(rows) == docs.count()
    right = [r["lang_pred"] == want[r["doc_id"]]["lang"] for r in rows if r["doc_id"] in want]
    assert sum(right) >= 0.98 * len(right)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", texts[r["doc_id"]] or "")) and 0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in lang_id.identified(docs, lang_id.fit(docs.limit(0))).collect()} == {"und"}


def test_trees_are_monotonic_and_accurate():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3)).astype(np.float32)
    y = (np.sin(6 * x[:, 0]) - 1.5 * x[:, 1] + 0.3 * rng.normal(size=3000) > -0.5).astype(float)
    trees = quality_rules.grow(x, y, np.array([0, -1, 0]))
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.85
    line = np.linspace(0, 1, 200)
    for a, c in rng.random((40, 2)):
        got = trees.score(np.column_stack([np.full(200, a), line, np.full(200, c)]).astype(np.float32))
        assert (np.diff(got) <= 1e-12).all()
    assert np.allclose(quality_rules.grow(x[:5], np.ones(5), np.zeros(3)).score(x[:2]), 5.5 / 6)


def test_quality_rules(spark, tables):
    docs, labels = tables
    rows = quality_rules.judged(docs, quality_rules.fit(docs, labels)).collect()
    texts, want = {r["doc_id"]: r["text"] for r in docs.collect()}, truth(labels, "quality")
    for r in rows:
        stats = brute_stats(texts[r["doc_id"]])
        assert list(r[1:6]) == stats
        assert r["base_failed"] == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0]) and not (r["kept"] and r["base_failed"])
    checked = [(r["kept"], want[r["doc_id"]]) for r in rows if r["doc_id"] in want and not r["base_failed"]]
    assert sum(k == bool(y) for k, y in checked) >= 0.95 * len(checked)


def test_class_prior_needs_no_negatives():
    """Scores of known classes: the estimate is near the share of positives, whichever of them carry labels."""
    rng = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        n = int(20000 * share)
        good, bad = rng.normal(2, 1, n), rng.normal(-2, 1, 20000 - n)
        cells = np.linspace(-6, 6, quality_pu.RANKS)
        tail = lambda x: np.array([(x >= c).mean() for c in cells])
        assert abs(quality_pu.class_prior(tail(np.concatenate([good, bad])), tail(good[:900])) - share) < 0.05


def test_quality_columns_may_clash(spark, tables):
    docs, labels = tables
    model = quality_pu.fit(docs, labels, prior=0.8)
    odd = docs.withColumnsRenamed({"lang": "text__in", "score": "c1"}).withColumn("predicted", docs["doc_id"])
    assert quality_pu.scored(odd, model, least=0.5).schema == odd.schema
    assert quality_pu.scored(odd, model).columns == ["doc_id", "text", "text__in", "c1", "score", "predicted"]
