"""Quality classifier by positive-unlabelled learning.

A logistic model over document statistics minimises the non-negative unbiased risk
    pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)]),   l(f) = log(1 + exp(-f)),
from trusted positives P, unlabelled web text U (every document open to training, labelled or not) and the class prior
pi. Every step is one distributed pass over the statistics of all rows: tasks add up gradients and curvature, Spark
sums them by key, and a few hundred numbers reach the driver. No rows are sampled.
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
from plumbline.llm.common import Workspace, chunks, in_training

_BENT = [docstats.NAMES.index(x) for x in ("symbols", "upper", "digits", "bangs", "punctuation", "dup_lines", "repeat_words", "distinct", "doubled")]
_SHORT = (2.0, 3.5)
#: Inputs count as at most FAR deviations from their mean; one that hardly varies counts as varying by LEAST_SCALE.
FAR, LEAST_SCALE = 5.0, 0.02
#: Cells of the histogram of scores that the class prior is read from, and the share of positives above a threshold.
RANKS, LEAST_TAIL = 400, 0.75


def inputs(texts: list[str | None]) -> np.ndarray:
    """Document statistics, square roots of the shares, and hinges on the length and on repetition."""
    raw = docstats.features(docstats.base(texts)).astype(np.float64)
    size = raw[:, :1]
    bent = np.sqrt(raw[:, _BENT])
    hinges = [np.maximum(0, h - size) for h in _SHORT]
    lack = [np.maximum(0, h - raw[:, docstats.NAMES.index("distinct")][:, None]) for h in (0.6, 0.4)]
    return np.concatenate([raw, bent, *hinges, *lack], axis=1)


@dataclass(frozen=True)
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in chunks(texts):
            x = np.clip((inputs(texts[a:b]) - self.center) / self.scale, -FAR, FAR)
            out[a:b] = 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -50, 50)))
        return out


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = batch.column(0).to_pylist(), batch.column(1)
        for a, b in chunks(texts):
            x = inputs(texts[a:b]).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), flat], ["id", "x"])


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return batch.column(0).to_numpy(zero_copy_only=False).astype(bool), flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)


def _summed(data: DataFrame, part) -> np.ndarray:
    """The sum over all rows of what ``part`` gives for a batch: an array of fixed length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(*_matrix(batch))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    # Decimals add up to the same sum in whatever order tasks end.
    rows = data.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,12)")).alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = float(r["v"])
    return out


def class_prior(tail_u: np.ndarray, tail_p: np.ndarray, least: float = LEAST_TAIL) -> float:
    """The class prior from shares of unlabelled and of positive rows with scores from each threshold up.

    Where negatives are absent, the unlabelled share is prior x positive share, elsewhere it is larger; so the smallest
    ratio over all thresholds that ``least`` of the positives reach is the estimate. No label of a negative enters.
    """
    use = tail_p >= least
    return float(np.clip((tail_u[use] / tail_p[use]).min(initial=1.0), 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame, training: Column | None = None, prior: float | None = None, steps: int = 12, decay: float = 1e-3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of ``label_col`` = 1 from the rows of ``docs`` that ``training`` (by default the fold rule) admits.

    Positives are the rows labelled 1; all admitted rows are unlabelled text, negatives included. ``prior`` is the class
    prior; by default a first model with the prior 1/2 ranks all rows, and ``class_prior`` compares how positives and
    unlabelled rows rank. Null texts count as empty, null labels and null ids as unlabelled. Contradictory labels of a
    row: positive if any is 1. Without positives or rows, the model's score is the prior (1/2 if none is given)
    everywhere. Other columns are not looked at.
    """
    admitted = in_training(F.col("id")) if training is None else training
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("mark")).where("id is not null and mark is not null")
    marks = marks.groupBy("id").agg(F.max("mark").alias("mark"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(admitted)
    # Texts are never shuffled: the join with the labels moves their statistics only.
    kind = rows.schema["id"].dataType.simpleString()
    stats = rows.select("text", "id").mapInArrow(_featurize, f"id {kind}, x array<float>")
    with Workspace(docs.sparkSession) as work:
        data = work.cut(stats.join(marks, "id", "left").select((F.coalesce("mark", F.lit(0)) == 1).alias("positive"), "x"), few=True)
        spread = _summed(data, lambda p, x: np.concatenate([[len(p), p.sum()], x.sum(0), (x * x).sum(0)]))
        width = inputs([None]).shape[1]
        start = prior or 0.5
        if not len(spread) or spread[1] == 0:
            return Model(np.zeros(width), np.ones(width), np.append(np.zeros(width), np.log(start / (1 - start))))
        n_u, n_p = spread[:2]
        center = spread[2 : 2 + width] / n_u
        scale = np.maximum(np.sqrt(np.maximum(spread[2 + width :] / n_u - center**2, 0)), LEAST_SCALE)
        weights = _descend(data, n_u, n_p, center, scale, np.append(np.zeros(width), np.log(start / (1 - start))), start, steps, decay)
        if prior is None:
            def ranks(p, x):
                x = np.clip((x - center) / scale, -FAR, FAR)
                at = np.clip(((x @ weights[:-1] + weights[-1]) / 10 + 1) / 2 * RANKS, 0, RANKS - 1).astype(np.int64)
                return np.concatenate([np.bincount(at, minlength=RANKS), np.bincount(at[p], minlength=RANKS)]).astype(float)

            counts = _summed(data, ranks)
            tail = lambda c: np.cumsum(c[::-1])[::-1] / c.sum()
            weights = _descend(data, n_u, n_p, center, scale, weights, class_prior(tail(counts[:RANKS]), tail(counts[RANKS:])), steps, decay)
    return Model(center, scale, weights)


def _descend(data: DataFrame, n_u: float, n_p: float, center: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float, steps: int, decay: float) -> np.ndarray:
    """Damped Newton steps on the non-negative risk from ``weights``, one pass over ``data`` each; the best weights met."""
    d = len(weights)

    def part(weights):
        def run(p, x):
            x = np.column_stack([np.clip((x - center) / scale, -FAR, FAR), np.ones(len(x))])
            f = x @ weights
            s = 1 / (1 + np.exp(-np.clip(f, -50, 50)))
            loss = np.logaddexp(0, f)
            return np.concatenate([[loss.sum(), loss[p].sum(), f[p].sum()], s @ x, s[p] @ x[p], x[p].sum(0), ((x * (s * (1 - s))[:, None]).T @ x).reshape(-1)])

        return run

    best, lowest, step, share = weights, np.inf, np.zeros(d), 1.0
    for _ in range(steps):
        got = _summed(data, part(weights))
        u_loss, p_loss = got[0] / n_u, got[1] / n_p
        u_grad, p_grad, p_mean = got[3 : 3 + d] / n_u, got[3 + d : 3 + 2 * d] / n_p, got[3 + 2 * d : 3 + 3 * d] / n_p
        pull = decay * np.append(weights[:-1], 0)
        negative = u_loss - prior * p_loss
        risk = prior * (p_loss - got[2] / n_p) + max(0.0, negative) + 0.5 * decay * (weights[:-1] ** 2).sum()
        if risk < lowest:
            # pi l(f) - pi l(-f) = -pi f: above zero the unbiased risk is convex, below it only the positives count.
            best, lowest, share = weights, risk, 1.0
            slope = (u_grad - prior * p_mean if negative >= 0 else prior * (p_grad - p_mean)) + pull
            step = np.linalg.solve(got[3 + 3 * d :].reshape(d, d) / n_u + decay * np.eye(d), slope)
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        else:
            share *= 0.3  # too far, over the bend of max(0, .): less of the same step
        if share * np.abs(step).max() < 1e-3:
            break
        weights = best - share * step
    return best


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, least: float | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` with score and predicted; with ``least``, only rows that score it.

    With ``least`` the columns score and predicted are left out, so the result has the columns of ``docs``. Clashing
    columns score and predicted of ``docs`` are replaced. Null and empty texts are scored like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in keep or docs.columns if least is not None or c not in ("score", "predicted")]
    # Columns go by place inside, so no name can clash.
    frame = docs.select(F.col(text_col), *names).toDF(*(f"c{i}" for i in range(len(names) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(0).to_pylist())
            columns = batch.columns[1:]
            if least is not None:
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(score >= least))
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    schema = docs.select(names).schema
    if least is None:
        schema = T.StructType([*schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return frame.mapInArrow(run, schema)
