import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import license_scan, packing

TEXTS = [
    None, "", "All rights reserved. CC BY-NC 4.0", "cc by cc by general public license", "Licensed under a Creative Commons Attribution CC BY 4.0 x", "Licensed under the Apache License, Version 2.0.",
    "licensed under the apache licence version 2.0", "Copyright (c) 2020-2024 by Some Body Ltd. All Rights Reserved", "copyright c one two three four five six seven eight nine ten all rights reserved",
    "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3", "under the terms of the gnu general public license version 2", "ccé by cc", "general public",
]


def expand(markup):
    """A template as a regular expression over words that are each followed by a blank."""
    out = ""
    for t in re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+", markup):
        out += "(?:" if t == "[[" else ")?" if t == "]]" else rf"(?:\S+ ){{0,{t[2:-2].rpartition(':')[2]}}}" if t[0] == "{" else re.escape(t) + " "
    return re.compile(out)


def test_licenses_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, labels int")
    got = {r["doc_id"]: r for r in license_scan.licenses(docs).collect()}
    for i, text in enumerate(TEXTS):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        base = ",".join(sorted(labels))
        for k in range(len(words)):
            labels |= {label for label, markup in license_scan.TEMPLATES if expand(markup).match(" ".join(words[k:]) + " ")}
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None)), text
        assert (r["base_labels"], r["labels"]) == (base, ",".join(sorted(labels))), text
        assert 0 <= r["score"] <= 1
    with pytest.raises(ValueError):
        license_scan.Automaton([("x", "[[a]] b c")])


def test_packing_round_trip(spark):
    texts = [None, "", "plain text", "text <|endoftext|> more", "é" * 5000, "word " * 3000] + [f"doc {i} " * (i * 7 % 90) for i in range(150)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, "plain text", 1), (None, "n", 1)], "doc_id long, text string, length int").repartition(5)
    rows = packing.pack_documents(docs, with_ids=True).collect()
    plain = packing.public_encoder().slow
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] > 0
    for i, text in enumerate(texts):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(pieces[i], key=lambda r: r["start"])
        want = ids if i != 2 else ids + ids
        assert sorted(x for r in parts for x in r["ids"]) == sorted(want) and all(r["doc_tokens"] == len(ids) for r in parts)
        if i != 2:
            assert [x for r in parts for x in r["ids"]] == ids and [r["start"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1])
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in parts)
        assert [r["offset"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1]) and total <= packing.SIZE
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // packing.SIZE) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def brute_pack(lengths, size):
    """Shortest-pack-first, one piece after the other: the longest first, each into the pack with most room."""
    packs = []
    for x in sorted(lengths, reverse=True):
        best = max(range(len(packs)), key=lambda i: size - sum(packs[i]), default=None)
        if best is not None and size - sum(packs[best]) >= x:
            packs[best].append(x)
        else:
            packs.append([x])
    return packs


def test_patterns_equal_brute_force_on_single_pieces():
    import random

    rng = random.Random(8)
    for size in (16, 64):
        lengths = [rng.randrange(1, size + 1) for _ in range(300)]
        made = [sorted(p) for p, n in packing.patterns(Counter(lengths), size) for _ in range(n)]
        assert sorted(map(sum, made)) == sorted(map(sum, brute_pack(lengths, size)))


def test_packs_of_ranked_groups(spark):
    """Few rows a group, equal rows, clashing names: every sequence is gapless and as the patterns say."""
    rows = [(1, i * 0, n, "x") for i, n in enumerate([64, 64, 64, *[7] * 200, *[30] * 50, *[33] * 20, 1])]
    frame = spark.createDataFrame(rows, "row long, salt long, length long, sequence_id string").repartition(3)
    got = packing.pack(frame, 64, rows=9).collect()
    assert len(got) == len(rows)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= 64
    want = brute_pack([r[2] for r in rows], 64)
    assert sorted(sum(n for _, n in p) for p in sequences.values()) == sorted(map(sum, want))


def test_patterns_use_every_length_once():
    histogram = {2048: 5, 2047: 3, 1500: 7, 1024: 9, 600: 20, 548: 3, 7: 100, 1: 11}
    made = packing.patterns(histogram)
    used = Counter()
    for lengths, packs in made:
        assert sum(lengths) <= 2048 and packs > 0
        for x in lengths:
            used[x] += packs
    assert used == histogram and packing.patterns({}) == []


def test_pipeline_stages(spark, tmp_path):
    """Planted rows through all stages; the first one, which learns, is checked by what it must keep."""
    import random

    rng = random.Random(0)
    vocabulary = ["w%s" % "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    docs, labels = [], []
    secret = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    for i in range(300):
        good = i % 5 > 0
        t = text(rng.randrange(60, 200)) + (f" {secret}" if i % 10 == 7 else "")
        docs.append((i, t if good else t.replace(" ", "### "), "en", "s"))
        labels.append((i, int(good), 0))
    item = " ".join(vocabulary[:30])
    near = docs[1][1].split()
    near[40] = "changed"
    docs += [(300, docs[1][1], "en", "s"), (301, " ".join(near), "en", "s"), (302, text(80) + " " + item, "en", "s"), (303, text(80) + f" {secret} " + text(20), "en", "s"), (304, None, None, None), (304, None, None, None)]
    frame = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "packing":
            assert sorted(now.columns) == sorted(frame.columns)
    ids = {name: set(rows) for name, rows in seen.items()}
    good = {i for i in range(300) if i % 5} | {300, 301, 302, 303}
    assert good <= ids["quality_classifier"] and len(ids["quality_classifier"] - good - {304}) <= 2
    assert ids["minhash_near_dedup"] == ids["quality_classifier"] - {300, 301}
    assert ids["benchmark_decontamination"] == ids["minhash_near_dedup"] - {302}
    assert ids["secret_scans"] == ids["packing"] == ids["benchmark_decontamination"]
    redacted = seen["secret_scans"][303]
    assert "24be64439e" not in redacted["text"] and "<secret>" in redacted["text"] and redacted["n_chars"] == len(redacted["text"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
