"""License scans by matching template markup.

A template is a line of words with two kinds of marks: ``[[...]]`` is an optional region, ``{{name:n}}`` a replaceable
one of up to n words of any kind. It compiles into a token automaton (literal, any-word and empty moves); a place in a
text matches if the mandatory wording stands there exactly, word by word. Sets of automaton states are made
deterministic as they are met and remembered, all templates run at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.bytewords import combine, words
from plumbline.llm.common import chunks
from plumbline.llm.license_templates import TEMPLATES

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


class Automaton:
    """The templates' common automaton. Moves: state -> list of (word, state); None stands for any word."""

    def __init__(self, templates=TEMPLATES):
        self.moves: list[list[tuple[str | None, int]]] = []
        self.empty: list[list[int]] = []
        self.labels: dict[int, str] = {}
        self.starts: dict[tuple[str, str], list[int]] = {}
        self._next: dict[tuple[frozenset, str], frozenset] = {}
        self._known: set[str] = set()
        for label, markup in templates:
            tokens = re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+", markup.lower())
            if len(tokens) < 2 or any(re.match(r"[\[\]{]", t) for t in tokens[:2]):
                raise ValueError(f"a template begins with two mandatory words: {markup!r}")
            begin = at = self._state()
            open_: list[int] = []
            for t in tokens:
                if t == "[[":
                    open_.append(at)
                    self.empty[at].append(after := self._state())
                    at = after
                elif t == "]]":
                    self.empty[at].append(after := self._state())
                    self.empty[open_.pop()].append(after)
                    at = after
                elif t.startswith("{{"):
                    end = self._state()
                    for _ in range(int(t[2:-2].rpartition(":")[2])):
                        self.empty[at].append(end)
                        self.moves[at].append((None, after := self._state()))
                        at = after
                    self.empty[at].append(end)
                    at = end
                else:
                    self.moves[at].append((t, after := self._state()))
                    self._known.add(t)
                    at = after
            if open_:
                raise ValueError(f"an optional region does not end: {markup!r}")
            self.labels[at] = label
            self.starts.setdefault((tokens[0], tokens[1]), []).append(begin)

    def _state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def _closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def match(self, read, first: int, end: int, pair: tuple[str, str]) -> dict[str, int]:
        """label -> words of its longest match at word ``first``; read(i) is word i, ``end`` the text's last plus one."""
        states, found = self._closed(self.starts[pair]), {}
        for i in range(first, end):
            word = read(i)
            word = word if word in self._known else ""
            after = self._next.get((states, word))
            if after is None:
                after = self._closed({to for s in states for w, to in self.moves[s] if w is None or w == word})
                self._next[states, word] = after
            states = after
            if not states:
                break
            for s in states:
                if s in self.labels:
                    found[self.labels[s]] = i + 1 - first
        return found


def _hash(word: str) -> np.uint64:
    return words([word]).hashes()[0]


def scan_texts(texts: list[str | None], automaton: Automaton, base=BASE) -> list[dict]:
    """For each text: n_words, places [(word, label)] of base phrases, matches [(word, words, label)] of templates."""
    out: list[dict] = []
    wanted = {int(combine([np.array([_hash(a)]), np.array([_hash(b)])])[0]): (a, b) for a, b in automaton.starts}
    phrases = [([(_hash(w), w) for w in phrase.split()], label) for phrase, label in base]
    for a, b in chunks(texts):
        found = words(texts[a:b])
        hashes, counts = found.hashes(), found.counts
        begin = np.cumsum(counts) - counts
        rows = [{"n_words": int(c), "places": [], "matches": []} for c in counts]
        for phrase, label in phrases:
            n = len(hashes) - len(phrase) + 1
            if n > 0:
                hit = found.doc[:n] == found.doc[len(phrase) - 1 :]
                for j, (h, _) in enumerate(phrase):
                    hit &= hashes[j : j + n] == h
                for i in (i for i in np.flatnonzero(hit) if all(found.text(i + j) == w for j, (_, w) in enumerate(phrase))):
                    rows[found.doc[i]]["places"].append((int(i - begin[found.doc[i]]), label))
        if len(hashes) > 1:
            pairs = combine([hashes[:-1], hashes[1:]])
            for i in np.flatnonzero(np.isin(pairs, np.array(list(wanted), np.uint64)) & (found.doc[:-1] == found.doc[1:])):
                doc = found.doc[i]
                for label, n in automaton.match(found.text, int(i), int(begin[doc] + counts[doc]), wanted[int(pairs[i])]).items():
                    rows[doc]["matches"].append((int(i - begin[doc]), n, label))
        out += rows
    return out


def licenses(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    n_base counts the places of base phrases, first_word and last_word are the smallest and largest of them (else
    null); labels are those of the base phrases and of all matching templates, distinct, sorted and comma-joined. score
    is 1 if a template matches, 0.5 if only base phrases stand in the text, else 0. matches holds struct<word, words,
    label>, words counted from 0. Null and empty texts have no words; repeated rows and null ids are rows like others; an
    empty table gives no rows. Other columns are not looked at.
    """
    frame = docs.select(id_col, text_col)
    automaton = Automaton(templates)
    match = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = scan_texts(batch.column(1).to_pylist(), automaton)
            places = [[p for p, _ in r["places"]] for r in rows]
            base = [sorted({label for _, label in r["places"]}) for r in rows]
            labels = [sorted({*b, *(label for *_, label in r["matches"])}) for b, r in zip(base, rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([r["n_words"] for r in rows], pa.int64()), pa.array([len(p) for p in places], pa.int64()),
                    pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()),
                    pa.array([",".join(x) for x in base]), pa.array([",".join(x) for x in labels]),
                    pa.array([1.0 if r["matches"] else 0.5 if p else 0.0 for r, p in zip(rows, places, strict=True)]),
                    pa.array([[{"word": w, "words": n, "label": x} for w, n, x in r["matches"]] for r in rows], match),
                ],
                names,
            )

    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType(), T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("words", T.LongType()), T.StructField("label", T.StringType())]))]
    return frame.mapInArrow(run, T.StructType([frame.schema[id_col], *(T.StructField(n, k) for n, k in zip(names[1:], kinds, strict=True))]))
