"""Statistics of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

from plumbline.llm.bytewords import GOLDEN, SOLID, mix, windows, words

_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _BANG = _bytes(b"#*$%&|<>"), _bytes(bytes(range(65, 91))), _bytes(bytes(range(48, 58))), _bytes(b"!?")
_PUNCT = _bytes(bytes(c for c in range(33, 127) if not chr(c).isalnum()))

NAMES = ("log_words", "chars_a_word", "symbols", "upper", "digits", "bangs", "punctuation", "dup_lines", "repeat_words", "distinct", "doubled", "words_a_line", "log_longest")


def base(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Whole-number statistics of each text, exact: words are runs without white space, None has no words.

    n_words; word_chars (code points in words); n_symbols; n_dup_lines (lines with a word that equal an earlier line);
    n_repeat_words (words inside 3-word windows that the text holds at least twice); and counts used by ``features``.
    """
    n = len(texts)
    found = words(texts, SOLID, lower=False)
    buf, hashes, doc = found.buf, found.hashes(), found.doc
    if not len(buf):
        return {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "upper", "digits", "bangs", "punctuation", "distinct", "doubled", "lines", "longest")}
    per_doc = lambda flags: np.add.reduceat(flags.astype(np.int64), found.offsets)
    begins = (buf & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(begins)])
    chars = before[found.end] - before[found.start]
    own = mix(doc.astype(np.uint64) * GOLDEN)
    in_doc = lambda values, at: mix(values ^ own[at])
    ones = np.arange(len(hashes))

    triple, first = windows(hashes, doc, 3)
    _, inverse, count = np.unique(in_doc(triple, first), return_inverse=True, return_counts=True)
    again = first[count[inverse] > 1]
    cover = np.zeros(len(hashes) + 3, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 3, -1)
    repeated = np.cumsum(cover)[: len(hashes)] > 0

    lines = words(texts, _LINE, lower=False)
    solid = np.concatenate([[0], np.cumsum(SOLID[buf])])
    full = solid[lines.end] > solid[lines.start]
    line_hash, line_doc = lines.hashes()[full], lines.doc[full]
    line_key = mix(line_hash ^ mix(line_doc.astype(np.uint64) * GOLDEN))
    _, line_first = np.unique(line_key, return_index=True)
    n_lines = np.bincount(line_doc, minlength=n)
    kinds = np.unique(in_doc(hashes, ones), return_index=True)[1]
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, chars)
    return {
        "n_words": found.counts, "word_chars": np.bincount(doc, chars, n).astype(np.int64), "n_symbols": per_doc(_SYMBOL[buf]),
        "n_dup_lines": n_lines - np.bincount(line_doc[line_first], minlength=n), "n_repeat_words": np.bincount(doc[repeated], minlength=n),
        "upper": per_doc(_UPPER[buf]), "digits": per_doc(_DIGIT[buf]), "bangs": per_doc(_BANG[buf]), "punctuation": per_doc(_PUNCT[buf]),
        "distinct": np.bincount(doc[kinds], minlength=n), "doubled": np.bincount(doc[same], minlength=n), "lines": n_lines, "longest": longest,
    }


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, len(NAMES)) float32; every column is 0 for a text without words."""
    words_, chars = np.maximum(stats["n_words"], 1), np.maximum(stats["word_chars"], 1)
    lines = np.maximum(stats["lines"], 1)
    columns = [
        np.log1p(stats["n_words"]), stats["word_chars"] / words_, stats["n_symbols"] / chars, stats["upper"] / chars, stats["digits"] / chars, stats["bangs"] / words_,
        stats["punctuation"] / chars, stats["n_dup_lines"] / lines, stats["n_repeat_words"] / words_, stats["distinct"] / words_, stats["doubled"] / words_,
        np.minimum(stats["n_words"] / lines, 1000.0), np.log1p(stats["longest"]),
    ]
    return np.stack(columns, axis=1).astype(np.float32)
