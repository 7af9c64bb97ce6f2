"""Quality rules: fixed limits on document statistics, then gradient-boosted trees over them.

The trees are grown on histograms of binned statistics with monotonic constraints: where a statistic may only lower the
verdict, a split whose leaves disagree is not taken and the middle of the two leaves bounds everything below them. All
trees are flattened into arrays of nodes, and a batch of documents walks all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import docstats
from plumbline.llm.common import chunks, in_training

MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Labelled rows that training reads at most; the bound is a parameter of fit().
MOST_ROWS = 20_000
#: More of these may only lower a document's score.
FALLING = ("symbols", "bangs", "dup_lines", "repeat_words", "doubled")


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees. A leaf's children are itself; ``roots`` are the trees' first nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row of ``x``."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-np.clip(self.bias + self.value[at].sum(1), -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, damping: float = 1.0, least: float = 4.0) -> Trees:
    """Boosted trees for 0/1 labels; signs: per feature 1 (may only raise), -1 (may only lower) or 0."""
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else []
    codes = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]
    margin = np.full(len(x), bias)

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        me = len(nodes)
        best = float(np.clip(-total_g / (total_h + damping), low, high))
        nodes.append([0, np.inf, me, me, rate * best])
        if level == depth or total_h < 2 * least:
            leaves.append((rows, rate * best))
            return me
        top = (1e-6, None)
        for j, code in enumerate(codes):
            n = len(edges[j]) + 1
            gl = np.cumsum(np.bincount(code[rows], g[rows], n))[:-1]
            hl = np.cumsum(np.bincount(code[rows], h[rows], n))[:-1]
            vl, vr = np.clip(-gl / (hl + damping), low, high), np.clip(-(total_g - gl) / (total_h - hl + damping), low, high)
            gain = -(gl * vl + 0.5 * (hl + damping) * vl**2) - ((total_g - gl) * vr + 0.5 * (total_h - hl + damping) * vr**2) + (total_g * best + 0.5 * (total_h + damping) * best**2)
            gain[(hl < least) | (total_h - hl < least) | (signs[j] * (vr - vl) < 0)] = 0
            if len(gain) and gain.max() > top[0]:
                k = int(gain.argmax())
                top = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
        if top[1] is None:
            leaves.append((rows, rate * best))
            return me
        j, k, vl, vr = top[1]
        middle, sign = (vl + vr) / 2, signs[j]
        below = codes[j][rows] <= k
        nodes[me][:2] = [j, edges[j][k]]
        nodes[me][2] = build(rows[below], g, h, level + 1, middle if sign < 0 else low, middle if sign > 0 else high)
        nodes[me][3] = build(rows[~below], g, h, level + 1, middle if sign > 0 else low, middle if sign < 0 else high)
        return me

    for _ in range(trees if len(np.unique(y)) > 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        leaves: list[tuple[np.ndarray, float]] = []
        roots.append(build(np.arange(len(x)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        for rows, value in leaves:
            margin[rows] += value
    if not roots:
        nodes, roots = [[0, np.inf, 0, 0, 0.0]], [0]
    columns = [np.array(c) for c in zip(*nodes, strict=True)]
    return Trees(columns[0].astype(np.int64), columns[1].astype(float), columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4].astype(float), np.array(roots), bias, depth)


def _inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in chunks(texts):
            x = docstats.features(docstats.base(texts[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(list(x), pa.list_(pa.float32()))], ["mark", "x"])


def fit(docs: DataFrame, labels: DataFrame, training: Column | None = None, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Trees from at most ``most_rows`` labelled documents, drawn by hash of their ids; only statistics reach the driver.

    Rows with a null id or label teach nothing, a null text counts as empty, of contradictory labels of an id the
    larger holds, and of repeated ids the smallest text teaches. Labels of one kind only, or no rows, give a constant score.
    """
    admitted = in_training(F.col("id")) if training is None else training
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("mark")).where("id is not null and mark is not null").where(admitted)
    drawn = marks.groupBy("id").agg(F.max("mark").alias("mark")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    # At most most_rows ids, so their broadcast is bounded.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn), "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("mark").alias("mark")).select("text", (F.col("mark") == 1).cast("int").alias("mark"))
    got = rows.mapInArrow(_inputs, "mark int, x array<float>").collect()
    x = np.array([r["x"] for r in got], np.float32).reshape(len(got), len(docstats.NAMES))
    signs = np.array([-1 if name in FALLING else 0 for name in docstats.NAMES])
    # Rows come in any order; sums of floating point should not depend on it.
    order = np.lexsort(x.T) if len(x) else np.zeros(0, np.int64)
    return grow(x[order], np.array([r["mark"] for r in got], float)[order], signs)


def judged(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    Words are runs without white space; whole texts are counted. base_failed: fewer than 50 words, or more than half of
    them inside repeated 3-word windows. kept: not base_failed and the trees' probability is at least 0.5. A null or
    empty text has no words and fails. An empty table gives no rows. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    frame = docs.select(id_col, text_col)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = [id_col, *counts, "base_failed", "kept", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                stats = docstats.base(texts[a:b])
                failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > REPEAT_PERCENT * stats["n_words"])
                score = shared.value.score(docstats.features(stats))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(stats[c].astype(np.int64)) for c in counts), pa.array(failed), pa.array(~failed & (score >= 0.5)), pa.array(score)], names)

    kinds = [T.LongType()] * 5 + [T.BooleanType()] * 2 + [T.DoubleType()]
    return frame.mapInArrow(run, T.StructType([frame.schema[id_col], *(T.StructField(n, k) for n, k in zip(names[1:], kinds, strict=True))]))
