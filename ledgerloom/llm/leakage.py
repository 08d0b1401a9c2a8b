"""Evaluation passages inside a training corpus.

Greedy string tiling after a seed join. The bodies of the evaluation items become an index of word
triples. Each document is scanned once, in Arrow batches without any shuffle: its triples meet the index
(the seed join); seeds that lie together on nearby diagonals make a document and an item a candidate;
for each candidate the longest common runs are marked, longest first and never overlapping, found
by Karp-Rabin fingerprints of falling length. The tiles give the covered share of the item, in any order
(``reordered`` puts a threshold to it); ``leaks`` goes on with an exact check of order and of the share of changed words.

What counts as a leak: a stretch of the body of which at least 15 words are held in their order, at most one
edit (a word changed, added or left out) to four held words. Words that were changed are not held, so a template sentence that shares 12
of 15 words with a body is no leak.

Why no passage is lost: one with 30 held words or more can be cut in two of which one counts by itself, so there is always
one with fewer than 30 held words and so at most 7 edits. With e edits it has b body words in a row that stand within e
edits of the text, for one (b, e) of ``WINDOWS``. Its triples keep more than three seeds: an edit spoils three of them at
most, and triples that very many items share are left out of the index only as long as no 15-word window of any
item loses more than two of them. Of so many seeds two are on nearby diagonals, as 7 edits part two neighbours at most once by more
than ``BAND``.

The index is sent to the executors. It holds the evaluation items only, whose number does not grow with the
corpus; ``BLOCK_WORDS`` bounds one index, and a larger evaluation set is matched block by block, one index in memory at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.wikitext import word_list
from ledgerloom.session import cut

LEAST_WORDS = 15
EDIT_SHARE = 5  # one word in so many
SEED = 3
COMMON = 24  # items that may share a triple before it counts as common
NEAR = 24  # words within which two seeds of a passage lie
BAND = 4
STEP = 8
#: Body words in a row and the edits within which they stand in the text; one pair holds for the least passage of every number of edits.
WINDOWS = ((15, 3), (16, 4), (20, 5), (24, 6), (28, 7))
REACH = 48  # words on either side of a seed; a passage has a part of fewer than 30 held words and 8 edits that is one itself
MARGIN = 64  # words that are none before and after each body
GAP = 64  # zeros around every document: no window reaches from one into another, nor beyond the batch
BLOCK_WORDS = 500_000
REORDERED_TILE = 6  # words of the least tile of a reordered passage
REORDERED_COVERAGE = 0.5  # share of the body that such tiles must cover

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def item_body(text: str | None) -> str:
    """The part between the question wording and the answer options; parts are set off by empty lines."""
    parts = [p for p in (text or "").replace("\r\n", "\n").split("\n\n") if p.strip()]
    if len(parts) >= 3:
        return "\n\n".join(parts[1:-1])
    return ""


class SeedIndex:
    """Word triples of the bodies of one block of items."""

    def __init__(self, items: Sequence[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        bodies = [word_list(b) for _, b in items]
        self.vocabulary: dict[str, int] = {}
        for body in bodies:
            for w in body:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.size = len(self.vocabulary) + 1
        self.bodies = [np.array([self.vocabulary[w] for w in b], dtype=np.int64) for b in bodies]
        where: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, body in enumerate(self.bodies):
            for p, code in enumerate(self._codes(body).tolist()):
                where[code].append((k, p))
        left_out = self._common(where)
        kept = sorted(c for c in where if c not in left_out)
        self.codes = np.array(kept, dtype=np.int64)
        counts = [len(where[c]) for c in kept]
        self.starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        flat = [x for c in kept for x in where[c]]
        self.items = np.array([k for k, _ in flat], dtype=np.int64)
        self.places = np.array([p for _, p in flat], dtype=np.int64)
        self.table = np.zeros(1 << _BITS, dtype=bool)
        if len(kept):
            self.table[self._slot(self.codes)] = True
        # all bodies behind one another, with margins of words that are none
        lengths = np.array([len(b) for b in self.bodies], dtype=np.int64)
        self.lengths = lengths
        self.begins = MARGIN + np.concatenate([[0], np.cumsum(lengths + 2 * MARGIN)])[:-1].astype(np.int64) if len(lengths) else lengths
        self.flat = np.full(int((lengths + 2 * MARGIN).sum()), -2, dtype=np.int32)
        for at, body in zip(self.begins.tolist(), self.bodies, strict=True):
            self.flat[at : at + len(body)] = body
        self.longest = int(lengths.max()) if len(lengths) else 0
        # which words an item has: a table of hashes, which says yes to all it has and to few others
        words = [np.unique(b) for b in self.bodies]
        self.held_bits = min(31, max(10, int(sum(w.size for w in words) * 16).bit_length()))
        self.held = np.zeros(1 << self.held_bits, dtype=bool)
        for k, w in enumerate(words):
            self.held[self._held_slot(np.array([k]), w[None, :])] = True

    def _held_slot(self, items: np.ndarray, words: np.ndarray) -> np.ndarray:
        """One row of words per item, in 32 bits."""
        mixed = words.astype(np.uint32) * np.uint32(0x9E3779B1) + (items.astype(np.uint32) * np.uint32(0x85EBCA6B))[:, None]
        mixed ^= mixed >> np.uint32(15)
        return (mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - self.held_bits)

    def size_in_bytes(self) -> int:
        """Of the arrays; the vocabulary comes to some 100 bytes a word beside."""
        return sum(x.nbytes for x in (self.codes, self.starts, self.items, self.places, self.table, self.flat, self.held, self.begins)) + sum(b.nbytes for b in self.bodies)

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) < SEED:
            return np.empty(0, dtype=np.int64)
        return (ids[:-2] * self.size + ids[1:-1]) * self.size + ids[2:]

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * _MIX) >> np.uint64(64 - _BITS)

    def _common(self, where: dict[int, list[tuple[int, int]]]) -> set[int]:
        """Triples to leave out, most shared first, while every window of 13 triples loses two at most."""
        lost = [np.zeros(max(0, len(b) - SEED + 1), dtype=np.int64) for b in self.bodies]
        out = set()
        for code, places in sorted(where.items(), key=lambda x: (-len(x[1]), x[0])):
            if len({k for k, _ in places}) <= COMMON:
                break
            window = LEAST_WORDS - SEED + 1
            fits = True
            for k, p in places:
                around = lost[k][max(0, p - window + 1) : p + window].copy()
                around[min(p, window - 1)] += 1
                sums = np.convolve(around, np.ones(window, dtype=np.int64))
                if sums.max() > 2:
                    fits = False
                    break
            if fits:
                for k, p in places:
                    lost[k][p] += 1
                # places of one item are tested one by one, so test them again together
                if all(np.convolve(lost[k], np.ones(window, dtype=np.int64)).max() <= 2 for k in {k for k, _ in places}):
                    out.add(code)
                else:
                    for k, p in places:
                        lost[k][p] -= 1
        return out

    def _within_edits(self, ids: np.ndarray, place: np.ndarray, item: np.ndarray, diagonal: np.ndarray, span: int, edits: int) -> np.ndarray:
        """Which candidates have ``span`` body words near the seed that stand within ``edits`` of the text: edit distances in a band, start by start."""
        shifts = np.arange(-2 * edits, 2 * edits + 1, dtype=np.int32)
        band = np.where(np.abs(shifts) <= edits, 0, 99).astype(np.int8)
        good = np.zeros(len(place), dtype=bool)
        begin, length = self.begins[item], self.lengths[item]
        for lo in range(0, len(place), 4000):
            # all starts at once
            mine = np.repeat(np.arange(lo, min(lo + 4000, len(place))), span + STEP)
            first = (place - diagonal)[mine] - np.tile(np.arange(-STEP, span), len(mine) // (span + STEP))
            inside = (first >= 0) & (first + span <= length[mine])
            mine, first = mine[inside], first[inside]
            body, text = begin[mine] + first, diagonal[mine] + first
            # a passage begins with a held word
            near = np.arange(-edits, edits + 1)
            begun = (ids[text[:, None] + near] == self.flat[body][:, None]).any(axis=1)
            mine, body, text = mine[begun], body[begun], text[begun]
            cost = band[None, :].repeat(len(mine), 0)
            for step in range(span):
                if not len(mine):
                    break
                same = ids[(text + step)[:, None] + shifts[None, :]] == self.flat[body + step][:, None]
                following = cost + ~same
                # a body word left out: the text stays where it is
                np.minimum(following[:, :-1], cost[:, 1:] + 1, out=following[:, :-1])
                # words added to the text
                for s in range(1, len(shifts)):
                    np.minimum(following[:, s], following[:, s - 1] + 1, out=following[:, s])
                cost = following
                if step % 2 or step + 1 == span:
                    alive = cost.min(axis=1) <= edits
                    mine, body, text, cost = mine[alive], body[alive], text[alive], cost[alive]
            good[mine] = True
        return good

    def seeds(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, item and place in its body of every triple that the index knows."""
        nothing = np.empty(0, dtype=np.int64)
        if len(ids) < SEED or not len(self.codes):
            return nothing, nothing, nothing
        usable = ids > 0
        at = np.flatnonzero(usable[:-2] & usable[1:-1] & usable[2:])
        codes = (ids[at].astype(np.int64) * self.size + ids[at + 1]) * self.size + ids[at + 2]
        likely = self.table[self._slot(codes)]
        at, codes = at[likely], codes[likely]
        found = np.searchsorted(self.codes, codes)
        found[found == len(self.codes)] = 0
        real = self.codes[found] == codes
        at, found = at[real], found[real]
        counts = self.starts[found + 1] - self.starts[found]
        entry = np.repeat(self.starts[found] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return np.repeat(at, counts), self.items[entry], self.places[entry]

    def candidates(self, ids: np.ndarray, place: np.ndarray, item: np.ndarray, body_place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, items and places in the bodies of passages that may be leaks; ``ids`` holds the batch's documents set off by ``GAP`` zeros."""
        if not len(place):
            return place, item, body_place
        diagonal = place - body_place
        close = []
        for shift in (0, BAND):
            # by item and band, places rising: the sort is stable and places come in order
            key = item * np.int64(len(ids) + 4 * BAND + self.longest) + (diagonal + self.longest + shift) // (2 * BAND)
            order = np.argsort(key, kind="stable")
            p, k = place[order], key[order]
            close.append(order[:-1][(k[1:] == k[:-1]) & (p[1:] - p[:-1] <= NEAR) & (p[1:] > p[:-1])])
        chosen = np.concatenate(close)
        # one of several seeds on one diagonal within STEP words stands for them all
        key = (item[chosen] * np.int64(len(ids) + self.longest + 1) + diagonal[chosen] + self.longest) * np.int64(1 + len(ids) // STEP) + place[chosen] // STEP
        _, once = np.unique(key, return_index=True)
        chosen = chosen[once]
        place, item, diagonal = place[chosen] // STEP * STEP, item[chosen], diagonal[chosen]
        good, fits = np.zeros(len(place), dtype=bool), np.zeros((len(WINDOWS), len(place)), dtype=bool)
        widest, most = sum(WINDOWS[-1]), WINDOWS[-1][1]
        around = np.arange(-widest, widest + STEP)

        def crowded(hits: np.ndarray, span: int, edits: int) -> np.ndarray:
            """Rows with enough hits for ``span`` words and ``edits`` in some stretch of that many places."""
            cut_off, width = widest - span - edits, span + edits
            sums = np.cumsum(hits[:, cut_off : hits.shape[1] - cut_off], axis=1, dtype=np.int8)
            return (sums[:, width:] - sums[:, :-width]).max(axis=1) >= span - edits

        for lo in range(0, len(place), 20_000):
            rows = np.arange(lo, min(lo + 20_000, len(place)))
            # of the words around, enough must be the item's at all
            words = ids[place[rows, None] + around]
            held = self.held[self._held_slot(item[rows], words)]
            by_rule = np.array([crowded(held, *rule) for rule in WINDOWS])
            some = by_rule.any(axis=0)
            rows, words, by_rule = rows[some], words[some], by_rule[:, some]
            # and must stand where the item has them, give or take the edits
            near = self.flat[(self.begins[item[rows]] + place[rows] - diagonal[rows])[:, None] + np.arange(-widest - most, widest + STEP + most)]
            equal = near[:, most : most + len(around)] == words
            shift = 0
            for r, (span, edits) in enumerate(WINDOWS):
                while shift < edits:
                    shift += 1
                    equal |= near[:, most + shift : most + shift + len(around)] == words
                    equal |= near[:, most - shift : most - shift + len(around)] == words
                fits[r, rows] = by_rule[r] & crowded(equal, span, edits)
        for r, (span, edits) in enumerate(WINDOWS):
            some = np.flatnonzero(~good & fits[r])
            good[some] = self._within_edits(ids, place[some], item[some], diagonal[some], span, edits)
        return place[good], item[good], (place - diagonal)[good]


_BASE = 0x100000001B3


def _fingerprints(x: np.ndarray) -> dict[int, list[int]]:
    """Karp-Rabin fingerprints, modulo 2**64, of all runs of each tile length, each length from the one half as long."""
    words = x.astype(np.uint64) * _MIX
    value = words[:-2] * np.uint64(pow(_BASE, 2, 1 << 64)) + words[1:-1] * np.uint64(_BASE) + words[2:] if len(x) >= SEED else words[:0]
    out, n = {SEED: value.tolist()}, SEED
    while 2 * n <= min(len(x), TILE_LENGTHS[0]):
        value = value[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + value[n:]
        n *= 2
        out[n] = value.tolist()
    return out


TILE_LENGTHS = (24, 12, 6, SEED)


def tiles(pattern: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in pattern, place in text, length), longest first, never overlapping.

    For each search length, fingerprints of the unmarked runs are compared; matches are extended to
    their full length and marked from the longest down before a shorter length is searched.
    Runs below the last length are no tiles. Ties go to the earlier place in the text, then in the pattern.
    """
    pattern, text = np.asarray(pattern, dtype=np.int64), np.asarray(text, dtype=np.int64)
    p_list, t_list = pattern.tolist(), text.tolist()
    free_p, free_t = bytearray(b"\1" * len(p_list)), bytearray(b"\1" * len(t_list))
    prints_p, prints_t = _fingerprints(pattern), _fingerprints(text)
    out: list[tuple[int, int, int]] = []
    for length in TILE_LENGTHS:
        if length not in prints_p or length not in prints_t:
            continue
        where: dict[int, list[int]] = defaultdict(list)
        for i, v in enumerate(prints_p[length]):
            where[v].append(i)
        hits = [(i, j) for j, v in enumerate(prints_t[length]) if v in where for i in where[v] if p_list[i : i + length] == t_list[j : j + length]]
        while hits:
            grown = []
            reach: dict[int, int] = {}
            for i, j in hits:
                if reach.get(i - j, -1) > j:
                    continue  # inside the match just grown
                n = length
                while i + n < len(p_list) and j + n < len(t_list) and p_list[i + n] == t_list[j + n] and free_p[i + n] and free_t[j + n]:
                    n += 1
                reach[i - j] = j + n - length + 1
                grown.append((n, i, j))
            for n, i, j in sorted(grown, key=lambda m: (-m[0], m[2], m[1])):
                if 0 not in free_p[i : i + n] and 0 not in free_t[j : j + n]:
                    free_p[i : i + n] = bytes(n)
                    free_t[j : j + n] = bytes(n)
                    out.append((i, j, n))
            # what is left of matches that were cut into
            hits = [(i, j) for i, j in hits if 0 not in free_p[i : i + length] and 0 not in free_t[j : j + length]]
    return out


def _edit_steps(pattern: Sequence[int], text: Sequence[int]) -> list[tuple[int, int]]:
    """Alignment of two short runs as steps (1 if equal else 0, body words taken); an added word takes none."""
    n, m = len(pattern), len(text)
    if n == 0 or m == 0:
        return [(0, 1)] * n + [(0, 0)] * max(0, m - n)
    cost = [list(range(m + 1))]
    for i in range(1, n + 1):
        row = [i]
        for j in range(1, m + 1):
            row.append(min(cost[i - 1][j - 1] + (pattern[i - 1] != text[j - 1]), cost[i - 1][j] + 1, row[j - 1] + 1))
        cost.append(row)
    steps = []
    i, j = n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (pattern[i - 1] != text[j - 1]):
            steps.append((int(pattern[i - 1] == text[j - 1]), 1))
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            steps.append((0, 1))
            i -= 1
        else:
            steps.append((0, 0))
            j -= 1
    return steps[::-1]


def stands(body: np.ndarray, text: np.ndarray) -> bool:
    """Whether at least ``LEAST_WORDS`` body words stand in the text in their order with at most one edit for every four of them; exact.

    Per pair of places and number of held words (up to ``LEAST_WORDS``) the best score of an alignment that ends there is kept: one up for a held
    word, four down for an edit. One row of the table is one step over the whole text.
    """
    lost, cost, top = np.int16(-10_000), np.int16(EDIT_SHARE - 1), LEAST_WORDS
    m = len(text)
    if m < top or len(body) < top:
        return False
    slope = (cost * np.arange(m + 1, dtype=np.int32))[:, None]
    row = np.full((m + 1, top + 1), lost, dtype=np.int32)
    for word in body:
        equal = np.flatnonzero(text == word)
        following = np.maximum(row, np.concatenate([row[:1], row[:-1]])) - cost  # the body word left out, or changed
        following[0] = lost
        if len(equal):
            before = row[equal]
            held = np.full((len(equal), top + 1), lost, dtype=np.int32)
            held[:, 1:] = before[:, :-1] + 1
            held[:, top] = np.maximum(held[:, top], before[:, top] + 1)
            held[:, 1] = np.maximum(held[:, 1], 1)
            if held[:, top].max() >= 0:
                return True
            following[equal + 1] = np.maximum(following[equal + 1], held)
        # words added to the text
        row = np.maximum.accumulate(following + slope, axis=0) - slope
        np.maximum(row, lost, out=row)
    return False


def chained(pattern: Sequence[int], text: Sequence[int], found: Sequence[tuple[int, int, int]]) -> bool:
    """Whether tiles that follow one another in both, and the words between them, already make a leak; says no to some that are."""
    if any(n >= LEAST_WORDS for _, _, n in found):
        return True
    chain = sorted(found, key=lambda t: t[1])
    # the heaviest chain of tiles whose places rise in both
    best: list[tuple[int, int]] = []
    for a, (i, j, n) in enumerate(chain):
        top, before = n, -1
        for b in range(a):
            x, y, z = chain[b]
            gap = max(i - x - z, j - y - z)
            if x + z <= i and y + z <= j and gap <= NEAR and best[b][0] + n - gap // 4 > top:
                top, before = best[b][0] + n - gap // 4, b
        best.append((top, before))
    if not chain:
        return False
    at, line = max(range(len(chain)), key=lambda a: best[a][0]), []
    while at >= 0:
        line.append(chain[at])
        at = best[at][1]
    line.reverse()
    steps: list[tuple[int, int]] = []
    for x, (i, j, n) in enumerate(line):
        if x:
            pi, pj, pn = line[x - 1]
            steps += _edit_steps(pattern[pi + pn : i], text[pj + pn : j])
        steps += [(1, 1)] * n
    return _passes(steps)


def _windows(places: Iterable[tuple[int, int]], length: int, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of body and text around seeds ``(place in text, place in body)``, those of overlapping surroundings in one: body from, to, text from, to."""
    merged: list[list[int]] = []
    for p, b in sorted(places):
        part = [max(0, b - REACH), min(length, b + STEP + REACH), max(low, p - REACH), min(high, p + STEP + REACH)]
        if merged and part[2] <= merged[-1][3]:
            merged[-1] = [min(merged[-1][0], part[0]), max(merged[-1][1], part[1]), merged[-1][2], max(merged[-1][3], part[3])]
        else:
            merged.append(part)
    return (tuple(m) for m in merged)


def _passes(steps: Iterable[tuple[int, int]]) -> bool:
    """A run of steps with at least 15 equal words and one edit at most for every four of them."""
    score = equals = 0
    history = [(0, 0)]  # (equal words before, score before)
    lowest, passed = None, 0
    for equal, _ in steps:
        score += 1 if equal else -(EDIT_SHARE - 1)
        equals += equal
        history.append((equals, score))
        while passed < len(history) and history[passed][0] <= equals - LEAST_WORDS:
            lowest = history[passed][1] if lowest is None else min(lowest, history[passed][1])
            passed += 1
        if lowest is not None and equal and score - lowest >= 0:
            return True
    return False


def _batches(index: SeedIndex, batches: Iterable[pd.DataFrame]) -> Iterator[tuple[list, list[int], np.ndarray]]:
    """Document ids, where each begins, and the words of all as numbers of the index's vocabulary, set off by ``GAP`` zeros."""
    get = index.vocabulary.get
    for whole in batches:
        for lo in range(0, len(whole), 1000):
            batch = whole.iloc[lo : lo + 1000]
            pieces, starts, at = [np.zeros(GAP, dtype=np.int32)], [], GAP
            for text in batch["text"]:
                words = word_list(text) if text else []
                starts.append(at)
                pieces.append(np.array([get(w, 0) for w in words], dtype=np.int32))
                pieces.append(np.zeros(GAP, dtype=np.int32))
                at += len(words) + GAP
            yield batch["doc_id"].tolist(), [*starts, at], np.concatenate(pieces)


def _scan(index: SeedIndex, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for doc_ids, starts, ids in _batches(index, batches):
        places, items, body_places = index.candidates(ids, *index.seeds(ids))
        spans: dict[tuple[int, int], set[tuple[int, int]]] = {}
        owner = np.searchsorted(np.array(starts, dtype=np.int64), places + STEP, side="right") - 1
        for d, p, k, b in zip(owner.tolist(), places.tolist(), items.tolist(), body_places.tolist(), strict=True):
            spans.setdefault((d, k), set()).add((p, b))
        rows = []
        for (d, k), at in sorted(spans.items()):
            body, low, high = index.bodies[k], starts[d], starts[d + 1] - GAP
            windows = list(_windows(at, len(body), low, high))
            parts = [tiles(body, ids[c:e]) for _, _, c, e in windows]
            if any(chained(body.tolist(), ids[c:e].tolist(), t) for t, (_, _, c, e) in zip(parts, windows, strict=True)) or any(stands(body[a:b], ids[c:e]) for a, b, c, e in windows):
                covered = {x for t in parts for i, _, n in t for x in range(i, i + n)}
                rows.append((doc_ids[d], index.ids[k], len(covered) / len(body)))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage"])


def _scan_any_order(index: SeedIndex, batches: Iterable[pd.DataFrame], tile: int, least_coverage: float) -> Iterator[pd.DataFrame]:
    for doc_ids, starts, ids in _batches(index, batches):
        place, item, body_place = index.seeds(ids)
        owner = np.searchsorted(np.array(starts, dtype=np.int64), place, side="right") - 1
        key = owner * np.int64(len(index.bodies)) + item
        # distinct triples of a body that a document has; tiles that cover enough keep at least half as many
        once = np.unique(key * np.int64(index.longest + 1) + body_place) // np.int64(index.longest + 1)
        pairs, counts = np.unique(once, return_counts=True)
        need = np.maximum(LEAST_WORDS, np.ceil(index.lengths[pairs % len(index.bodies)] * least_coverage)) / 2 if len(pairs) else counts
        rows = []
        order = np.argsort(key, kind="stable")
        for pair in pairs[counts >= need].tolist():
            d, k = divmod(pair, len(index.bodies))
            mine = order[np.searchsorted(key[order], pair) : np.searchsorted(key[order], pair, side="right")]
            body, low, high = index.bodies[k], starts[d], starts[d + 1] - GAP
            parts: list[np.ndarray] = []
            for _, _, c, e in _windows(zip(place[mine].tolist(), body_place[mine].tolist(), strict=True), len(body), low, high):
                parts += [ids[c:e], np.zeros(1, dtype=np.int32)]
            covered = sum(n for _, _, n in tiles(body, np.concatenate(parts)) if n >= tile)
            if covered >= LEAST_WORDS and covered >= least_coverage * len(body):
                rows.append((doc_ids[d], index.ids[k], covered / len(body)))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage"])


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    block, words = [], 0
    for row in items.select("item_id", "item_text").where("item_id is not null").toLocalIterator():
        body = item_body(row.item_text)
        n = len(word_list(body))
        if words + n > block_words and block:
            yield block
            block, words = [], 0
        if n:
            block.append((row.item_id, body))
            words += n
    if block:
        yield block


def _matched(documents: DataFrame, items: DataFrame, block_words: int, scan) -> DataFrame:
    """The results of ``scan`` over all documents for each block of items; of several blocks, each one's results are written before the next is built."""
    corpus = documents.select("doc_id", "text").where(F.length("text") > 0)
    schema = "doc_id bigint, item_id bigint, coverage double"
    spark, done, waiting = documents.sparkSession, [], None
    for block in _blocks(items, block_words):
        if waiting is not None:
            part, handle = waiting
            done.append(cut(part))
            handle.destroy()
        handle = spark.sparkContext.broadcast(SeedIndex(block))
        waiting = corpus.mapInPandas(lambda batches, h=handle: scan(h.value, batches), schema), handle
    if waiting is None:
        return spark.createDataFrame([], schema)
    out = waiting[0]
    for part in done:
        out = out.unionByName(part)
    return out


def leaks(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, coverage`` for each document and each item whose body it holds, whole or in part, in its order.

    ``documents(doc_id, text)`` and ``items(item_id, item_text)``; other columns are ignored. Null or empty
    texts, items without a body and bodies of under 15 words give nothing; items that share a body are
    all reported; repeated document rows give repeated results. ``coverage`` is the share of the body's words
    that tiles cover there, in any order. Whole texts of any length are read.
    """
    return _matched(documents, items, block_words, _scan)


def reordered(documents: DataFrame, items: DataFrame, tile: int = REORDERED_TILE, least_coverage: float = REORDERED_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, coverage`` for each document whose tiles of at least ``tile`` words cover enough of an item's body, in whatever order they stand.

    Enough are 15 words and ``least_coverage`` of the body. Other cases as in ``leaks``.
    """
    return _matched(documents, items, block_words, lambda index, batches: _scan_any_order(index, batches, tile, least_coverage))
