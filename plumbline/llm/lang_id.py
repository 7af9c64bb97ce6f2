"""Language identification by cross-parsing entropy.

Each language's sample becomes a suffix automaton. A text is cut into phrases, each the longest match with the sample
from where the last phrase ended; the language whose phrases cost fewest bits a character, phrases * log2(sample
length) / characters, wins. Moves of the automata are packed: the states' rows are laid over each other in one array
where their moves do not meet, so a table grows with the sample, not with states times characters.

All texts of a batch are parsed side by side in lanes of ``LANE`` code points. A lane begins as if a phrase began there;
then lanes whose predecessor ended in another state are parsed again from that state until they fall into step with
what is there. What comes out is the parse of the whole text from its first character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import chunks, in_training

LANE = 256
#: Labelled rows of each language that training draws at most, and the characters that their texts may have together.
#: Rows are used whole, the shortest first, and one at least.
SAMPLE_ROWS, SAMPLE_CHARS = 120, 120_000
UNKNOWN = "und"
_TRIES = 16
_LETTER = re.compile(r"[^\W\d_]")


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Moves {code: state} of each state of the automaton of all substrings; state 0 is the empty string."""
    link, length, moves = [-1], [0], [{}]
    last = 0
    for c in codes:
        new, p = len(link), last
        link.append(0)
        length.append(length[last] + 1)
        moves.append({})
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                moves.append(dict(moves[q]))
                link[q] = link[new] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = new
    return moves


def packed(moves: list[dict[int, int]], n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, to): state s has a move by c if owner[base[s] + c] is s, and it leads to to[base[s] + c]."""
    base = np.zeros(len(moves), np.int32)
    owner = [-1] * (2 * n_codes)
    to = [0] * (2 * n_codes)
    free, end = n_codes, n_codes  # cells below free are taken or given up, those from end on were never used
    for state in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
        out = moves[state]
        if not out:
            continue
        codes = sorted(out)
        cell = free if len(codes) == 1 else max(free, end - 2 * n_codes)
        for _ in range(_TRIES):
            while cell < end and owner[cell] >= 0:
                cell += 1
            at = cell - codes[0]
            if all(owner[at + c] < 0 for c in codes):
                break
            cell += 1
        else:
            at = end - codes[0]  # a few tries, then new cells: states of one move fill the gaps later
        base[state] = at
        for c in codes:
            owner[at + c], to[at + c] = state, out[c]
        end = max(end, at + codes[-1] + 1)
        while free < end and owner[free] >= 0:
            free += 1
        if len(owner) < end + n_codes:
            owner += [-1] * len(owner)
            to += [0] * len(to)
    size = int(base.max(initial=0)) + n_codes
    return base, np.array((owner + [-1] * size)[:size], np.int32), np.array((to + [0] * size)[:size], np.int32)


@dataclass(frozen=True)
class Parser:
    """The packed automaton of one language; ``root`` holds the moves of state 0 by every code, 0 where there is none.

    ``cells`` holds owner << 32 | to of every cell, so that one look tells both.
    """

    base: np.ndarray
    cells: np.ndarray
    root: np.ndarray

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """2 * next state + whether a phrase begins. At the root no phrase is under way, so whatever comes begins one;
        a character of no sample is one by itself."""
        cell = self.cells[self.base[state] + code]
        off = (cell >> 32) != state
        to = cell.astype(np.int32)
        np.copyto(to, self.root[code], where=off)
        to <<= 1
        off |= state == 0
        to |= off
        return to

    def begins(self, codes: np.ndarray, width: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How many phrases begin in each lane. Lanes are columns of ``codes``, widest first; ``before`` is the lane that
        each one goes on from, or -1."""
        trace = np.zeros(codes.shape, np.int32)
        alive = np.searchsorted(-width, -np.arange(len(codes)), "left")
        state = np.zeros(codes.shape[1], np.int32)
        for j, n in enumerate(alive):
            if not n:
                break
            trace[j, :n] = self.step(state[:n], codes[j, :n])
            np.right_shift(trace[j, :n], 1, out=state[:n])
        after = np.full(len(before) + 1, -1)
        after[before] = np.arange(len(before))
        after[-1] = -1
        todo, entered = np.flatnonzero(before >= 0), np.zeros(len(before), np.int32)
        while len(todo):
            enter = trace[width[before[todo]] - 1, before[todo]] >> 1
            todo, enter = todo[enter != entered[todo]], enter[enter != entered[todo]]
            entered[todo] = enter
            open_ = after[self._again(codes, trace, width, todo, enter)]
            todo = open_[open_ >= 0]
        counted = (trace & 1).astype(np.int16).cumsum(0, dtype=np.int16)
        return counted[width - 1, np.arange(len(width))].astype(np.int64)

    def _again(self, codes: np.ndarray, trace: np.ndarray, width: np.ndarray, lane: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Parse lanes from other states until they meet what is there; the lanes that did not before they ended."""
        ended = [lane[:0]]
        for j in range(len(codes)):
            over = width[lane] <= j
            if over.any():
                ended.append(lane[over])
                lane, state = lane[~over], state[~over]
            if not len(lane):
                break
            got = self.step(state, codes[j, lane])
            state = got >> 1
            apart = (trace[j, lane] >> 1) != state
            trace[j, lane] = got
            lane, state = lane[apart], state[apart]
        return np.concatenate([*ended, lane])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    classes: np.ndarray  # code point -> class, 0 for those of no sample
    parsers: tuple[Parser, ...]
    bits: np.ndarray  # bits that a phrase costs

    def costs(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages): bits a character."""
        out = np.zeros((len(texts), len(self.languages)))
        for a, b in chunks(texts):
            raw = [t or "" for t in texts[a:b]]
            points = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.append(self.classes[points], np.int32(0))
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            if not len(points):
                continue
            begin = np.cumsum(sizes) - sizes
            lanes = -(-sizes // LANE)
            of = np.repeat(np.arange(len(raw)), lanes)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            first = begin[of] + LANE * nth
            width = np.minimum(LANE, begin[of] + sizes[of] - first)
            order = np.argsort(-width, kind="stable")
            place = np.empty(len(of), np.int64)
            place[order] = np.arange(len(of))
            before = np.where(nth[order] > 0, place[order - 1], -1)
            grid = codes[np.minimum(first[order][None, :] + np.arange(LANE)[:, None], len(points))]
            for k, parser in enumerate(self.parsers):
                count = np.bincount(of[order], parser.begins(grid, width[order], before), len(raw))
                out[a:b, k] = count * self.bits[k] / np.maximum(sizes, 1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores, as ``identified`` describes them."""
        names, score = [], np.zeros(len(texts))
        cost = self.costs(texts)
        for i, text in enumerate(texts):
            if not self.languages or not text or not _LETTER.search(text):
                names.append(UNKNOWN)
                continue
            best = int(cost[i].argmin())
            names.append(self.languages[best])
            rest = np.delete(cost[i], best)
            score[i] = rest.min() / (rest.min() + cost[i][best]) if len(rest) else 1.0
        return names, score


def train(samples: dict[str, str]) -> Model:
    """A model of {language: text}; equal costs go to the language that comes first in order of names."""
    languages = tuple(sorted(samples))
    lower = [samples[x].lower() for x in languages]
    chars = sorted({c for text in lower for c in text})
    place = {c: i + 1 for i, c in enumerate(chars)}
    classes = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        low = chr(code).lower()
        if low in place:
            classes[code] = place[low]
    parsers, bits = [], []
    for text in lower:
        moves = suffix_automaton([place[c] for c in text])
        root = np.zeros(len(chars) + 1, np.int32)
        root[list(moves[0])] = list(moves[0].values())
        base, owner, to = packed(moves, len(chars) + 1)
        parsers.append(Parser(base, owner.astype(np.int64) << 32 | to, root))
        bits.append(np.log2(max(2, len(text))))
    return Model(languages, classes, tuple(parsers), np.array(bits))


def fit(docs: DataFrame, training: Column | None = None, sample_chars: int = SAMPLE_CHARS, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from at most ``sample_rows`` whole texts of each language, drawn by hash of id and text.

    Of the drawn texts the shortest are used, as many as together have at most ``sample_chars`` characters, and one at
    least. Rows of equal id and text count once. Rows
    with a null id, an empty or null text or a null language and, by the fold rule, rows held out teach nothing. No
    labelled rows: every prediction is ``und``. The driver sees a few numbers a drawn row and the texts that are used.
    """
    admitted = in_training(F.col("id")) if training is None else training
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("text") != "")).where(admitted)
    rows = rows.select("lang", "text", F.xxhash64("id", "text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return train({})
    # Four times the wanted number is expected below the limit, which no language with more rows misses.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * sample_rows / max(n, 1)))])
    low = rows.where(F.pmod("h", F.lit(1 << 40)) <= F.element_at(share, F.col("lang")) * float(1 << 40))
    drawn = low.groupBy("lang", "h").agg(F.max(F.length("text")).alias("n"))
    order = Window.partitionBy("lang").orderBy("h")
    drawn = drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_rows).collect()
    used: list[tuple[str, int]] = []
    for lang in counts:
        total = 0
        for n, h in sorted((r["n"], r["h"]) for r in drawn if r["lang"] == lang):
            total += n + 1
            if total <= sample_chars or total == n + 1:
                used.append((lang, h))
    samples: dict[str, list[str]] = {}
    wanted = F.col("h").isin([h for _, h in used])
    for r in sorted(low.where(wanted).groupBy("lang", "h").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["lang"], r["h"])):
        if (r["lang"], r["h"]) in used:
            samples.setdefault(r["lang"], []).append(r["text"])
    return train({lang: "\n".join(texts) for lang, texts in samples.items()})


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row, from its whole text.

    ``und`` with score 0 if the text is null, empty or without a letter. score is c2 / (c1 + c2) of the bits a
    character of the best (c1) and the second language (c2): 0.5 is a tie. Repeated rows and ids get a row each; other
    columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    return frame.mapInArrow(run, T.StructType([frame.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
