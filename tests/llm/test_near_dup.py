import random
import re
from collections import Counter
from pathlib import Path

import numpy as np

from plumbline.llm import common, near_dup


def brute(rows, threshold=0.8, size=5):
    """Class of each row number by comparing all pairs."""
    bags = []
    for _, text in rows:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if text is not None else []
        bags.append(Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if a and b:
                both = sum((a & b).values())
                same = both / (sum(a.values()) + sum(b.values()) - both) >= threshold
            else:
                same = not a and not b and rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def partition(names):
    groups = {}
    for i, name in enumerate(names):
        groups.setdefault(name, []).append(i)
    return sorted(map(tuple, groups.values()))


def corpus():
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(400)] + ["é%d" % i for i in range(40)]
    texts = []
    for g in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else ", ".join(copy))
    texts += ["", "", "...", None, None, "one", "One!", "same line\n" * 30, "same line\n" * 27, "same line\n" * 12, "x " * 3000]
    return list(enumerate(texts))


def test_equals_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, vertex string, band int")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    assert partition([got[i] for i, _ in rows]) == partition(brute(rows))
    assert all(got[c] == c and c <= i for i, c in got.items())


def test_shared_passage_with_outsiders(spark):
    """Near copies that differ among themselves around one origin, beside texts that share half of it."""
    rng = random.Random(3)
    fresh = lambda n: ["u%d" % rng.randrange(10**6) for _ in range(n)]
    base = fresh(200)
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.choice([1, 3, 5])):
            own[rng.randrange(200)] = fresh(1)[0]
        rows.append(own)
    rows += [base[:100] + fresh(60) for _ in range(20)] + [base[: 200 - k] + fresh(k) for k in (15, 20, 25, 30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {r["doc_id"]: r["class_id"] for r in got}
    assert partition([got[i] for i, _ in rows]) == partition(brute(rows))


def test_empty_table_and_repeated_ids(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "q r s"), (None, "q r s"), (None, None), (2, "A b c d e f g H")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_copies"]) for r in got) == [(0, 0, 1), (0, 1, 2), (1, 1, 2), (1, 1, 3), (1, 1, 3), (2, 1, 3)]


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    values = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 6, 300) * 0.4, rng.integers(1, 6, 300) * 0.4
    s = near_dup.signatures(np.repeat([0, 1], 300), np.concatenate([values, values]), np.concatenate([a, b]), 2, 6000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_tables_of_small_results_are_few_files(spark, monkeypatch):
    """With 200 partitions a shuffle and none merged, a table of 100 rows was written as more than 25 files."""
    held = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    df = spark.createDataFrame([(i, " ".join(f"w{i // 3}x{j}" for j in range(40))) for i in range(300)], "doc_id long, text string")
    files, delete = [], common.delete

    def told(session, path):
        files.extend(len(list(t.glob("*.parquet"))) for t in Path(path.removeprefix("file:")).iterdir())
        delete(session, path)

    monkeypatch.setattr(common, "delete", told)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = near_dup.near_duplicates(df)
        assert {(r["doc_id"], r["class_id"], r["n_copies"]) for r in out.collect()} == {(i, i // 3 * 3, 3) for i in range(300)}
        assert 0 < max(files) <= 25
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
