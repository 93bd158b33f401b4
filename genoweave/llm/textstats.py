"""Counts of whole texts, a batch of documents at a time, in arrays over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from genoweave.llm.common import BYTE_VALUE, IS_SPACE, U64, Rolling, mix, pieces, text_bytes, word_bounds

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPERCASE = np.zeros(256, dtype=bool)
UPPERCASE[65:91] = True
DIGITS = np.zeros(256, dtype=bool)
DIGITS[48:58] = True
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[list(b".,;:!?\"'()-")] = True

COUNTS = ("n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_punct", "longest_word")


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one anywhere, and which have an equal one before them."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    any_, earlier = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    earlier[order[1:][same]] = True
    return any_, earlier


def per_text(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts for texts that lie one after another in ``raw``."""
    n = len(offsets) - 1
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    between = lambda mask: np.diff(upto(mask)[offsets])
    lead = (raw & 0xC0) != 0x80
    starts, ends, first = word_bounds(raw, offsets)
    words = np.diff(first)
    text_of_word = np.repeat(np.arange(n), words)
    out = {"n_bytes": np.diff(offsets), "n_chars": between(lead), "n_words": words, "word_chars": between(lead & ~IS_SPACE[raw])}
    for name, mask in (("n_symbols", SYMBOLS), ("n_upper", UPPERCASE), ("n_digits", DIGITS), ("n_punct", PUNCTUATION)):
        out[name] = between(mask[raw])
    rolling = Rolling(BYTE_VALUE[raw])
    with np.errstate(over="ignore"):
        salt = mix(np.arange(n, dtype=np.uint64) + U64(1))
        hashes = rolling.slices(starts, ends)
        # distinct words
        _, earlier = repeats(hashes ^ salt[text_of_word])
        out["n_distinct_words"] = words - np.bincount(text_of_word[earlier], minlength=n)
        # windows of three words
        covered = np.zeros(len(starts), dtype=bool)
        if len(starts) >= 3:
            triple = Rolling(hashes).grams(3)
            inside = text_of_word[:-2] == text_of_word[2:]
            at = np.flatnonzero(inside)
            again, _ = repeats(triple[at] ^ salt[text_of_word[at]])
            hit = at[again]
            for k in range(3):
                covered[hit + k] = True
        out["n_repeat_words"] = np.bincount(text_of_word[covered], minlength=n)
        # lines with a word
        breaks = np.flatnonzero(raw == 10)
        line_from = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
        line_from = line_from[line_from < len(raw)]
        line_to = np.append(line_from[1:], len(raw))
        line_to = line_to - (raw[np.maximum(line_to - 1, 0)] == 10)
        # an empty last line has no word, so it need not be told from none
        words_before = np.searchsorted(starts, np.concatenate([line_from, line_to]))
        has_word = words_before[len(line_from) :] > words_before[: len(line_from)]
        line_from, line_to = line_from[has_word], line_to[has_word]
        text_of_line = np.searchsorted(offsets, line_from, side="right") - 1
        _, earlier = repeats(rolling.slices(line_from, line_to) ^ salt[text_of_line])
        out["n_lines"] = np.bincount(text_of_line, minlength=n)
        out["n_dup_lines"] = np.bincount(text_of_line[earlier], minlength=n)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, text_of_word, ends - starts)
    out["longest_word"] = longest
    return {k: v.astype(np.int64) for k, v in out.items()}


def over_pieces(column: pa.Array, function) -> Iterator:
    """Apply ``function(raw, offsets)`` to pieces of a batch of texts."""
    raw, offsets = text_bytes(column)
    for a, b in pieces(offsets):
        yield function(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def joined(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of a whole batch."""
    parts = list(over_pieces(column, per_text))
    if not parts:
        return {k: np.zeros(0, dtype=np.int64) for k in COUNTS}
    return {k: np.concatenate([p[k] for p in parts]) for k in COUNTS}
