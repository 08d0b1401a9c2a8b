"""Similarity of short strings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word-parallel step per character of ``b``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: str | None, b: str | None) -> float | None:
    """100 for equal strings down to 0 for strings without a common character; two empty strings are equal."""
    if a is None or b is None:
        return None
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: Letters of a value that one machine word holds; longer ones are compared one by one.
WORD = 64
CELLS = 1_000_000  # pairs of which the shared letters are counted at once
PAIRS = 200_000  # pairs that are aligned at once
GROUPS = 16  # groups of letters whose counts one machine word holds


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the texts, and for each of their letters the text, the place in it and the letter."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), lengths)
    return lengths, rows, np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths), letters


def _marked(rows: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each letter's text, and the letter with its occurrence number in it as one number, so that shared ones are counted as often as both sides have them."""
    keys = np.sort((rows << 32) | letters)
    begins = np.ones(len(keys), dtype=bool)
    begins[1:] = keys[1:] != keys[:-1]
    at = np.arange(len(keys))
    return keys >> 32, ((at - np.maximum.accumulate(np.where(begins, at, 0))) << 32) | (keys & 0xFFFFFFFF)


def _bits(rows: np.ndarray, marks: np.ndarray, vocabulary: np.ndarray, n: int) -> np.ndarray:
    """One row of machine words per text with a bit for each mark; marks outside the vocabulary have none."""
    at = np.searchsorted(vocabulary, marks)
    known = at < len(vocabulary)
    known[known] = vocabulary[at[known]] == marks[known]
    rows, at = rows[known], at[known]
    bits = np.zeros((n, len(vocabulary) // WORD + 1), dtype=np.uint64)
    np.bitwise_or.at(bits, (rows, at // WORD), np.uint64(1) << (at % WORD).astype(np.uint64))
    return bits


def _grouped(counts: np.ndarray) -> np.ndarray:
    """A group for each letter, so that all groups hold about as many of them."""
    groups, full = np.zeros(len(counts), dtype=np.int64), [0] * GROUPS
    for i in np.argsort(-counts, kind="stable").tolist():
        groups[i] = g = full.index(min(full))
        full[g] += int(counts[i])
    return groups


def _coarse(rows: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """One machine word per text: as many bits of a group's as the text has letters of it, so that the bits in which two texts differ are at most the letters in which they do."""
    width = WORD // GROUPS
    counts = np.minimum(np.bincount(rows * GROUPS + groups, minlength=n * GROUPS).reshape(n, GROUPS), width).astype(np.uint64)
    return (((np.uint64(1) << counts) - np.uint64(1)) << (np.arange(GROUPS, dtype=np.uint64) * np.uint64(width))).sum(axis=1, dtype=np.uint64)


def _places(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true; few are, so eight columns (of which there are a multiple) are looked at together first."""
    eight = np.flatnonzero(close.view(np.uint64))
    at = np.flatnonzero(close.reshape(-1, 8)[eight])
    return np.divmod(eight[at // 8] * 8 + at % 8, close.shape[1])


def nearest(values: list[str], names: list[str], threshold: float, first_threshold: float = 90) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``values`` and ``names`` and the ratio of each value's likest names, if that is at least ``threshold``; ties are all given.

    Only pairs whose lengths and shared letters can reach the threshold are aligned, many at once; they are counted by groups of letters
    first, and one by one only for the pairs that this leaves. Values are held against ``first_threshold`` first and against ``threshold`` only without a hit. As the highest ratio counts, this changes no result.
    """
    order = np.array(sorted(range(len(names)), key=lambda i: len(names[i])), dtype=np.int64)
    by_length = [names[i] for i in order]
    n_lengths, n_rows, n_places, n_letters = _letters(by_length)
    m_lengths, m_rows, m_places, m_letters = _letters(values)
    alphabet = np.unique(np.concatenate([n_letters, m_letters]))
    n_codes, m_codes = np.searchsorted(alphabet, n_letters), np.searchsorted(alphabet, m_letters)
    groups = _grouped(np.bincount(n_codes, minlength=len(alphabet)))
    n_words = _coarse(n_rows, groups[n_codes], len(names))
    m_words = _coarse(m_rows, groups[m_codes], len(values))
    (n_owners, n_marks), (m_owners, m_marks) = _marked(n_rows, n_letters), _marked(m_rows, m_letters)
    vocabulary = np.unique(n_marks)
    n_bits, m_bits = _bits(n_owners, n_marks, vocabulary, len(names)), _bits(m_owners, m_marks, vocabulary, len(values))
    none = len(alphabet)
    codes = np.full((int(n_lengths.max(initial=0)), len(names)), none, dtype=np.int64)
    codes[n_places, n_rows] = n_codes
    m_starts = np.cumsum(m_lengths) - m_lengths
    found = []

    def align(rows: np.ndarray, masks: np.ndarray, m: int, ri: np.ndarray, ci: np.ndarray) -> np.ndarray:
        if m > WORD:
            common = np.array([lcs_length(values[rows[r]], by_length[c]) for r, c in zip(ri, ci, strict=True)], dtype=np.int64)
        else:
            common = np.empty(len(ri), dtype=np.int64)
            for lo in range(0, len(ri), PAIRS):
                r, c = ri[lo : lo + PAIRS] * (none + 1), ci[lo : lo + PAIRS]
                state = np.full(len(r), ~np.uint64(0))
                for place in range(int(n_lengths[c].max(initial=0))):
                    hit = state & masks[r + codes[place, c]]
                    state = (state + hit) | (state - hit)
                common[lo : lo + PAIRS] = m - np.bitwise_count(state & np.uint64((1 << m) - 1)).astype(np.int64)
        return 200.0 * common / (m + n_lengths[ci])

    for m in np.unique(m_lengths[m_lengths > 0]).tolist():
        fits = np.nonzero((n_lengths > 0) & (200 * np.minimum(m, n_lengths) >= threshold * (m + n_lengths)))[0]
        if not len(fits):
            continue
        lo, hi = int(fits[0]), int(fits[-1]) + 1
        least, sooner = (np.ceil(t * (m + n_lengths) / 200 - 1e-9).astype(np.int64) for t in (threshold, max(threshold, first_threshold)))
        apart = np.clip(m + n_lengths[lo:hi] - 2 * least[lo:hi], 0, WORD).astype(np.uint8)
        own = np.nonzero(m_lengths == m)[0]
        step = max(1, CELLS // (hi - lo))
        wide, differ, close = np.empty(hi - lo, dtype=np.uint64), np.empty(hi - lo, dtype=np.uint8), np.zeros((min(step, len(own)), -(-(hi - lo) // 8) * 8), dtype=bool)
        for start in range(0, len(own), step):
            rows = own[start : start + step]
            for r, word in enumerate(m_words[rows]):
                np.bitwise_xor(n_words[lo:hi], word, out=wide)
                np.bitwise_count(wide, out=differ)
                np.less_equal(differ, apart, out=close[r, : hi - lo])
            ri, ci = _places(close[: len(rows)])
            ci += lo
            shared = np.zeros(len(ri), dtype=np.int64)
            for w in range(n_bits.shape[1]):
                shared += np.bitwise_count(m_bits[rows[ri], w] & n_bits[ci, w])
            near = np.flatnonzero(shared >= least[ci])
            ri, ci, shared = ri[near], ci[near], shared[near]
            soon = shared >= sooner[ci]
            masks = np.zeros((len(rows), none + 1), dtype=np.uint64)
            if m <= WORD:
                at = (m_starts[rows][:, None] + np.arange(m)).ravel()
                np.bitwise_or.at(masks, (np.repeat(np.arange(len(rows)), m), m_codes[at]), np.uint64(1) << m_places[at].astype(np.uint64))
            masks = masks.ravel()
            best = np.zeros(len(rows))
            scores = np.zeros(len(ri))
            for part in (np.nonzero(soon)[0], np.nonzero(~soon)[0]):
                part = part[best[ri[part]] < max(threshold, first_threshold)]
                scores[part] = align(rows, masks, m, ri[part], ci[part])
                np.maximum.at(best, ri[part], scores[part])
            top = np.nonzero((scores >= threshold) & (scores == best[ri]))[0]
            found.append((rows[ri[top]], order[ci[top]], scores[top]))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
