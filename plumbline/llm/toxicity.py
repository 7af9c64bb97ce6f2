"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's probability is logistic in its words and word beginnings; a document's is the noisy-or of its sentences,
1 - prod(1 - p). Only documents carry labels, the sentence model is trained through the noisy-or.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bytewords import Words, mix, words
from plumbline.llm.common import Workspace, chunks, in_training

#: Bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10, 12)
#: Labelled documents of each class that training reads at most; the bound is a parameter of fit().
MOST_ROWS = 3000
#: The size of the model, and what a feature must show to enter it.
MOST_FEATURES, LEAST_TEXTS, LEAST_GAIN = 4000, 3, 5
THRESHOLD = 0.7
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_SLOTS = 20


def _features(found: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of word, 64-bit feature): the word itself, and each beginning that is shorter than the word."""
    hashes = found.hashes()
    yield np.arange(len(hashes)), hashes
    lengths, total = found.end - found.start, np.zeros(len(hashes), np.uint64)
    powers = np.cumprod(np.full(max(BEGINNINGS) + 1, 0x100000001B3, np.uint64))
    at = 0
    for size in BEGINNINGS:
        longer = np.flatnonzero(lengths > size)
        for j in range(at, size):
            inside = np.flatnonzero(lengths > j)
            total[inside] += (found.buf[found.start[inside] + j] + np.uint64(1)) * powers[j]
        at = size
        yield longer, mix(total[longer] + powers[size])


def _sentences(found: Words) -> np.ndarray:
    """Of each word, the number of its sentence: sentences end at . ! ? and at line ends."""
    return np.concatenate([[0], np.cumsum(_STOP[found.buf])])[found.start]


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted 64-bit hashes
    weights: np.ndarray
    bias: float

    def _table(self) -> np.ndarray:
        table = np.full(1 << _SLOTS, -1, np.int32)
        table[(self.features >> np.uint64(64 - _SLOTS)).astype(np.int64)] = 0
        return table

    def sentences(self, texts: list[str | None], table: np.ndarray | None = None) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """The words; of each sentence that has words its first word, its document and its probability."""
        table = self._table() if table is None else table
        found = words(texts)
        number = _sentences(found)
        first = np.flatnonzero(np.diff(number, prepend=-1))
        of = np.searchsorted(number[first], number)
        z = np.full(len(first), self.bias)
        for at, feature in _features(found):
            maybe = np.flatnonzero(table[(feature >> np.uint64(64 - _SLOTS)).astype(np.int64)] >= 0)
            if len(maybe) and len(self.features):
                place = np.minimum(np.searchsorted(self.features, feature[maybe]), len(self.features) - 1)
                true = self.features[place] == feature[maybe]
                np.add.at(z, of[at[maybe[true]]], self.weights[place[true]])
        return found, first, found.doc[first], 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """Noisy-or of each text, and its offending sentences: code points of first and last word, probability >= 0.5."""
        table, score, spans = self._table(), np.zeros(len(texts)), [[] for _ in texts]
        for a, b in chunks(texts):
            found, first, doc, p = self.sentences(texts[a:b], table)
            score[a:b] = 1 - np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), b - a))
            if len(bad := np.flatnonzero(p >= 0.5)):
                points = np.concatenate([[0], np.cumsum((found.buf & 0xC0) != 0x80)])
                last = np.append(first[1:], len(found.start)) - 1
                for i in bad:
                    zero = points[found.offsets[doc[i]]]
                    spans[a + doc[i]].append({"start": int(points[found.start[first[i]]] - zero), "end": int(points[found.end[last[i]]] - zero), "score": float(p[i])})
        return score, spans


def presence(texts: list[str | None], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, toxic texts that hold it, other texts that hold it), features sorted."""
    counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in chunks(texts):
        found = words(texts[a:b])
        pairs = [np.unique(np.stack([f, found.doc[at].astype(np.uint64)]), axis=1) for at, f in _features(found)]
        pairs = np.concatenate([*pairs, np.zeros((2, 0), np.uint64)], axis=1)
        feature, inverse = np.unique(pairs[0], return_inverse=True)
        bad = toxic[a:b][pairs[1].astype(np.int64)]
        counts.append((feature, np.bincount(inverse, bad, len(feature)), np.bincount(inverse, ~bad, len(feature))))
    merged = [np.concatenate(x) for x in zip(*counts, strict=True)] if counts else [np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)]
    feature, inverse = np.unique(merged[0], return_inverse=True)
    return feature, np.bincount(inverse, merged[1], len(feature)), np.bincount(inverse, merged[2], len(feature))


def telling(k1, k0, n1: int, n0: int, log=np.log, most=np.maximum):
    """(whether a feature is usable, its G test gain) from the numbers of toxic and other texts that hold it: at least
    LEAST_TEXTS toxic ones, more than twice the share among them, and a gain above LEAST_GAIN."""
    r1, r0, r = k1 / n1, k0 / n0, (k1 + k0) / (n1 + n0)
    gain = k1 * log(most(r1 / r, 1e-300)) + k0 * log(most(r0 / r, 1e-300))
    return (k1 >= LEAST_TEXTS) & (r1 > 2 * r0) & (gain > LEAST_GAIN), gain


def occurrences(texts: list[str | None], chosen: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each text its number of sentences, and (sentence, place in ``chosen``) of every chosen feature in it."""
    blank = Model(chosen, np.zeros(len(chosen)), 0.0)
    table = blank._table()
    for a, b in chunks(texts):
        found = words(texts[a:b])
        number = _sentences(found)
        first = np.flatnonzero(np.diff(number, prepend=-1))
        of = np.searchsorted(number[first], number)
        owner = found.doc[first]
        rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, f in _features(found):
            maybe = np.flatnonzero(table[(f >> np.uint64(64 - _SLOTS)).astype(np.int64)] >= 0)
            if len(maybe) and len(chosen):
                place = np.minimum(np.searchsorted(chosen, f[maybe]), len(chosen) - 1)
                true = chosen[place] == f[maybe]
                rows.append(of[at[maybe[true]]])
                columns.append(place[true])
        row, column = np.concatenate(rows), np.concatenate(columns)
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
        sentences = np.bincount(owner, minlength=b - a)
        begin = np.cumsum(sentences) - sentences
        cuts = np.searchsorted(row, np.append(begin, len(first)))
        for i in range(b - a):
            own = slice(cuts[i], cuts[i + 1])
            yield int(sentences[i]), row[own] - begin[i], column[own]


def descend(chosen: np.ndarray, toxic: np.ndarray, sentences: np.ndarray, text_of: np.ndarray, sentence: np.ndarray, column: np.ndarray, epochs: int = 250, decay: float = 2e-4) -> Model:
    """Adam on the noisy-or likelihood: texts with ``sentences`` sentences, and occurrences (text, sentence, column)."""
    n1, n0 = max(1, toxic.sum()), max(1, (~toxic).sum())
    prior = float(np.clip(toxic.mean() if len(toxic) else 0.1, 0.01, 0.99))
    if not len(column) or toxic.all() or not toxic.any():
        return Model(chosen[:0], np.zeros(0), float(np.log(prior / (1 - prior))))
    # Sentences without any chosen feature differ by their number only.
    first = np.cumsum(sentences) - sentences
    live, row = np.unique(first[text_of] + sentence, return_inverse=True)
    home = np.searchsorted(first, live, "right") - 1
    idle = sentences - np.bincount(home, minlength=len(sentences))
    # Per document, both classes weigh the same: the threshold, not the sample, decides how rare toxicity is.
    weight = np.where(toxic, 0.5 / n1, 0.5 / n0)
    theta = np.append(np.zeros(len(chosen)), -5.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, epochs + 1):
        z = theta[-1] + np.bincount(row, theta[column], len(live))
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -50, 50))), 1 / (1 + np.exp(-theta[-1]))
        s = np.bincount(home, np.logaddexp(0, z), len(sentences)) + idle * np.logaddexp(0, theta[-1])
        push = weight * np.where(toxic, -1 / np.expm1(np.maximum(s, 1e-9)), 1.0)
        dz = push[home] * p
        grad = np.append(np.bincount(column, dz[row], len(chosen)), dz.sum() + (push * idle).sum() * p0)
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(chosen, theta[:-1].copy(), float(theta[-1]))


def train(texts: list[str | None], toxic: np.ndarray, most_features: int = MOST_FEATURES) -> Model:
    """A model of texts in memory: features that tell the classes apart best, then ``descend``."""
    toxic = np.asarray(toxic, bool)
    feature, k1, k0 = presence(texts, toxic)
    with np.errstate(divide="ignore", invalid="ignore"):
        usable, gain = telling(k1, k0, max(1, toxic.sum()), max(1, (~toxic).sum()))
    usable = np.flatnonzero(usable)
    chosen = np.sort(feature[usable[np.argsort(-gain[usable], kind="stable")[:most_features]]])
    return _descended(chosen, toxic, list(occurrences(texts, chosen)))


def _descended(chosen: np.ndarray, toxic: np.ndarray, found: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    sizes = [len(c) for _, _, c in found]
    none = [np.zeros(0, np.int64)]
    sentence, column = np.concatenate([*none, *(s for _, s, _ in found)]), np.concatenate([*none, *(c for _, _, c in found)])
    return descend(chosen, toxic, np.array([n for n, _, _ in found], np.int64), np.repeat(np.arange(len(found)), sizes), sentence, column)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = presence(batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool))
        yield pa.RecordBatch.from_arrays([pa.array(got[0].view(np.int64)), *(pa.array(k.astype(np.int64)) for k in got[1:])], ["feature", "k1", "k0"])


def fit(docs: DataFrame, labels: DataFrame, training: Column | None = None, most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``most_rows`` labelled documents of each class, drawn by hash of their ids.

    Spark counts the features of their whole texts and chooses at most ``most_features`` by G test; the driver sees the
    chosen ones and where they occur, never a text. Rows with a null id or label teach nothing; a null text counts as
    empty. Of contradictory labels of an id the larger holds, of repeated ids the smallest text teaches. Without labels
    of both classes the score is constant.
    """
    admitted = in_training(F.col("id")) if training is None else training
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("mark")).where("id is not null and mark is not null").where(admitted)
    marks = marks.groupBy("id").agg((F.max("mark") > 0).alias("mark"))
    drawn = [marks.where("mark" if k else "not mark").orderBy(F.xxhash64("id"), "id").limit(most_rows) for k in (1, 0)]
    # At most 2 x most_rows ids, so their broadcast is bounded.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn[0].union(drawn[1])), "id")
    with Workspace(docs.sparkSession) as work:
        rows = work.cut(rows.groupBy("id").agg(F.min("text").alias("text"), F.first("mark").alias("mark")))
        total = {r["mark"]: r["count"] for r in rows.groupBy("mark").count().collect()}
        n1, n0 = max(1, total.get(True, 0)), max(1, total.get(False, 0))
        counts = rows.select("text", "mark").mapInArrow(_counter, "feature long, k1 long, k0 long").groupBy("feature").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0"))
        usable, gain = telling(F.col("k1"), F.col("k0"), n1, n0, F.log, lambda x, least: F.greatest(x, F.lit(least)))
        best = counts.where(usable).select("feature", gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(most_features).collect()
        chosen = np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(occurrences(batch.column(2).to_pylist(), chosen))
                lists = [pa.array([list(x[k]) for x in found], pa.list_(pa.int64())) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.int64()), *lists], ["mark", "h", "n", "sentence", "place"])

        got = rows.select("mark", F.xxhash64("id").alias("h"), "text").mapInArrow(run, "mark boolean, h long, n long, sentence array<long>, place array<long>").collect()
    got.sort(key=lambda r: r["h"])
    return _descended(chosen, np.array([r["mark"] for r in got], bool), [(r["n"], np.array(r["sentence"], np.int64), np.array(r["place"], np.int64)) for r in got])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (score >= 0.7) and sentences: array<struct<start, end, score>> that offend.

    Every whole text is scored; null texts and texts without words have no sentence and score 0. One row per input row,
    repeated ids included; an empty table gives no rows. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(id_col, text_col)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, spans = shared.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(spans, span)], [id_col, "score", "predicted", "sentences"])

    out = T.StructType([frame.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    found = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    return frame.mapInArrow(run, T.StructType([*out.fields, T.StructField("sentences", found)]))
