"""Periodic runs of words, found in a Re-Pair grammar of each text.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new one until no pair occurs twice.
Every run of a text that is longer than one symbol crosses the boundary inside the lowest node of the
derivation that spans it: the middle of a rule's expansion, or a boundary between two symbols of the
last sequence. So the runs across each boundary are computed once for each rule, translated to all
places that derive the rule, and merged to maximal intervals of their period.

A run here has smallest period q and at least ``max(LENGTH, POWER * q)`` words, POWER being 4. Whatever
boundary it crosses, it has a square of its period on one side (two periods), beginning or ending there. The
pair of words at the boundary stands again one period on, so distances between equal pairs are the
only periods to try. A multiple of a period found is skipped, as its run would be the same interval.

Words are cut and numbered with array operations over many texts; pairs that occur once in their text
never reach Python objects.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.llm import frames, text

POWER = 4
LENGTH = 6

# Distances are compared word by word this far before arrays are compared whole.
NEAR = 8

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_runs", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("period", T.LongType()),
    T.StructField("exponent_milli", T.LongType()),
    T.StructField("runs_sha256", T.StringType()),
    T.StructField("collapsed_sha256", T.StringType()),
    T.StructField("collapsed", T.StringType()),
])


@dataclass
class Grammar:
    """Re-Pair of one sequence: the last sequence and, by rule, its two symbols.

    Symbols below ``words`` are words; rule k has the symbol words + k, ``size`` its expansion's length
    and ``place`` one position of it in the text.
    """

    words: int
    last: list[int]
    left: list[int]
    right: list[int]
    size: list[int]
    place: list[int]

    def length(self, symbol: int) -> int:
        return 1 if symbol < self.words else self.size[symbol - self.words]

    def occurrences(self, wanted: set[int]) -> dict[int, list[int]]:
        """All text positions that derive the wanted rules: from the last sequence down, rule by rule."""
        reach = set(wanted)
        # Rules are numbered in order of creation: users of a rule come after it.
        for k in range(len(self.left)):
            if self.left[k] - self.words in reach or self.right[k] - self.words in reach:
                reach.add(k)
        found: dict[int, list[int]] = {k: [] for k in reach}
        at = 0
        for symbol in self.last:
            if symbol - self.words in reach:
                found[symbol - self.words].append(at)
            at += self.length(symbol)
        for k in range(len(self.left) - 1, -1, -1):
            if k in reach:
                a, b = self.left[k] - self.words, self.right[k] - self.words
                if a in reach:
                    found[a].extend(found[k])
                if b in reach:
                    step = self.length(self.left[k])
                    found[b].extend(p + step for p in found[k])
        return {k: found[k] for k in wanted}


def repair(sequence: list[int], words: int, pairs: dict[tuple[int, int], list[int]]) -> Grammar:
    """Re-Pair. ``pairs`` has the ascending positions of each pair that occurs at least twice.

    The heap holds counts that can only be too high; a pair is counted again when it comes up. Of equal
    counts the pair of the smaller symbols goes first. Time is about linear in the replaced pairs.
    """
    symbol = list(sequence)
    n = len(symbol)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    left: list[int] = []
    right: list[int] = []
    size: list[int] = []
    place: list[int] = []
    heap = [(-len(at), pair) for pair, at in pairs.items()]
    heapq.heapify(heap)
    while heap:
        count, pair = heapq.heappop(heap)
        x, y = pair
        held, live, end = [], [], -1
        for p in pairs[pair]:
            if symbol[p] == x:
                q = after[p]
                if q < n and symbol[q] == y:
                    held.append(p)
                    # Of two that overlap the first counts; the other may outlive it.
                    if p >= end:
                        live.append(p)
                        end = after[q]
        if len(live) < 2:
            del pairs[pair]
            continue
        if heap and -len(live) > heap[0][0]:
            pairs[pair] = held
            heapq.heappush(heap, (-len(live), pair))
            continue
        del pairs[pair]
        made = words + len(left)
        left.append(x)
        right.append(y)
        size.append((1 if x < words else size[x - words]) + (1 if y < words else size[y - words]))
        place.append(live[0])
        for p in live:
            q = after[p]
            r = after[q]
            symbol[p], symbol[q] = made, -1
            after[p] = r
            if r < n:
                before[r] = p
        new: dict[tuple[int, int], list[int]] = {}
        done = -1
        for p in live:
            b = before[p]
            if b >= 0 and b != done:
                new.setdefault((symbol[b], made), []).append(b)
            r = after[p]
            if r < n:
                new.setdefault((made, symbol[r]), []).append(p)
            done = p
        for pair, at in new.items():
            if len(at) > 1:
                pairs[pair] = at
                heapq.heappush(heap, (-len(at), pair))
    last, p = [], 0
    while p < n:
        last.append(symbol[p])
        p = after[p]
    return Grammar(words, last, left, right, size, place)


def _forward(w: np.ndarray, i: int, j: int, end: int) -> int:
    """How far the words from i and from j > i on agree before ``end``."""
    n, step = 0, 64
    while j + n < end:
        k = min(step, end - j - n)
        same = w[i + n : i + n + k] == w[j + n : j + n + k]
        if not same.all():
            return n + int(np.argmin(same))
        n += k
        step *= 2
    return n


def _backward(w: np.ndarray, i: int, j: int, first: int) -> int:
    """How far the words before i and before j > i agree, not below ``first``."""
    n, step = 0, 64
    while i - n > first:
        k = min(step, i - n - first)
        same = w[i - n - k : i - n] == w[j - n - k : j - n]
        if not same.all():
            return n + int(np.argmin(same[::-1]))
        n += k
        step *= 2
    return n


def crossing(w: np.ndarray, b: int, first: int, end: int, again: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) of words first..end that hold both words at the boundary b.

    ``again`` has the ascending positions of the pair of words at b - 1 and b in the whole text.
    """
    runs: list[tuple[int, int, int]] = []
    here = int(np.searchsorted(again, b - 1))
    # A square behind the boundary ends before ``end``; the period is a distance to a later pair.
    later = again[here + 1 : np.searchsorted(again, b - 1 + (end - b) // 2, side="right")] - (b - 1)
    runs += _squares(w, later, lambda q: b, b, first, end)
    earlier = (b - 1) - again[np.searchsorted(again, b - 1 - (b - first) // 2) : here][::-1]
    runs += _squares(w, earlier, lambda q: b - 2 * q, b, first, end)
    return list(dict.fromkeys(runs))


def _squares(w, periods, square, b, first, end) -> list[tuple[int, int, int]]:
    """For ascending candidate periods the runs that have a square at ``square(q)`` and reach across b."""
    runs = []
    if len(periods) > NEAR:
        # Most candidates fail within a few words; these are compared for all candidates at once.
        for i in range(1, NEAR):
            at = np.minimum(i, periods - 1)
            if len(periods) == 0:
                break
            start = square(periods)
            periods = periods[w[start + at] == w[start + at + periods]]
    while len(periods):
        q = int(periods[0])
        periods = periods[1:]
        s = int(square(q))
        if _forward(w, s, s + q, s + 2 * q) < q:
            continue
        stop = s + 2 * q + _forward(w, s + q, s + 2 * q, end)
        start = s - _backward(w, s, s + q, first)
        if start < b < stop and stop - start >= max(LENGTH, POWER * q):
            runs.append((start, stop, q))
        # Multiples of q whose square lies in this interval have the same interval.
        reach = (stop - b) // 2 if s == b else (b - start) // 2
        periods = periods[(periods % q != 0) | (periods > reach)]
    return runs


def merge(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Maximal intervals: those of one period that share a whole period are one run.

    An interval whose words have a smaller period than the one it was found with is that period's run.
    """
    out: list[tuple[int, int, int]] = []
    for start, stop, q in sorted(set(runs), key=lambda r: (r[2], r[0], -r[1])):
        if out and out[-1][2] == q and start + q <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1] = (out[-1][0], stop, q)
        else:
            out.append((start, stop, q))
    smallest: dict[tuple[int, int], int] = {}
    for start, stop, q in out:
        smallest.setdefault((start, stop), q)
    return sorted((start, stop, q) for (start, stop), q in smallest.items())


def runs_of(w: np.ndarray, pair: np.ndarray, twice: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of a text, by start and then period.

    ``w`` numbers the words from 0, ``pair`` the pairs of neighbours; ``twice`` has the positions
    whose pair occurs again in the text, by pair and then position.
    """
    if len(twice) < 2:
        return []
    cut = np.flatnonzero(np.diff(pair[twice])) + 1
    groups = np.split(twice, cut)
    again = {int(pair[g[0]]): g for g in groups}
    sequence = w.tolist()
    pairs = {(sequence[g[0]], sequence[g[0] + 1]): g.tolist() for g in groups}
    grammar = repair(sequence, int(w.max()) + 1, pairs)
    n = len(sequence)

    runs: list[tuple[int, int, int]] = []
    at = 0
    boundary = np.zeros(n, dtype=bool)
    for symbol in grammar.last:
        at += grammar.length(symbol)
        if at < n:
            boundary[at - 1] = True
    for p in twice[boundary[twice]].tolist():
        runs += crossing(w, p + 1, 0, n, again[int(pair[p])])
    inside: dict[int, list[tuple[int, int, int]]] = {}
    for k, place in enumerate(grammar.place):
        size = grammar.size[k]
        if size < LENGTH:
            continue
        b = place + grammar.length(grammar.left[k])
        local = again.get(int(pair[b - 1]))
        if local is not None:
            found = crossing(w, b, place, place + size, local)
            if found:
                inside[k] = [(s - place, e - place, q) for s, e, q in found]
    if inside:
        for k, places in grammar.occurrences(set(inside)).items():
            runs += [(p + s, p + e, q) for p in places for s, e, q in inside[k]]
    return merge(runs)


def _numbered(cut: text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's number (equal bytes, equal number), and the words' bytes without what parts them."""
    body, at = cut.packed()
    return cut.array().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), body, at


def _pairs(number: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position's pair with the next word of its text (-1 for the last word), and the positions whose
    pair occurs at least twice in the text, by text, pair and position."""
    n = len(number)
    if n < 2:
        return np.full(n, -1, dtype=np.int64), np.zeros(0, dtype=np.int64)
    base = int(number.max()) + 1
    key = np.full(n, -1, dtype=np.int64)
    key[:-1] = np.where(row[:-1] == row[1:], number[:-1] * base + number[1:], -1)
    held = np.flatnonzero(key >= 0)
    order = held[np.lexsort((key[held], row[held]))]
    same = (key[order[1:]] == key[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    repeated = np.zeros(len(order), dtype=bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    return key, order[repeated]


def describe(texts: pa.Array, collapsed: bool) -> Iterator[tuple]:
    """A row of ``RESULT`` for each text; the collapsed text itself only if asked for."""
    for _, _, data, at in text.slices(texts):
        cut = text.words(data, at, lower=False)
        number, body, place = _numbered(cut)
        key, twice = _pairs(number, cut.row)
        bounds = np.searchsorted(cut.row[twice], np.arange(cut.rows + 1))
        # The bytes of all words, each followed by a space.
        spaced = np.full(len(body) + len(number), 0x20, dtype=np.uint8)
        spaced[np.arange(len(body)) + np.repeat(np.arange(len(number)), np.diff(place))] = body
        spot = place + np.arange(len(place))
        for i in range(cut.rows):
            a, b = int(cut.first[i]), int(cut.first[i + 1])
            n = b - a
            mine = twice[bounds[i] : bounds[i + 1]] - a
            found = []
            if len(mine) > 1:
                _, w = np.unique(number[a:b], return_inverse=True)
                found = runs_of(w, key[a:b], mine)
            kept = spaced[spot[a] : spot[b]]
            if found:
                change = np.zeros(n + 1, dtype=np.int64)
                for s, e, q in found:
                    change[s + q] += 1
                    change[e] -= 1
                stays = np.cumsum(change[:-1]) == 0
                kept = kept[np.repeat(stays, np.diff(spot[a : b + 1]))]
            kept = kept[:-1].tobytes()
            best = min(found, key=lambda r: (_Ratio(r[1] - r[0], r[2]), r[0], r[2])) if found else None
            lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
            yield (
                n,
                len(found),
                *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4),
                hashlib.sha256(lines.encode()).hexdigest(),
                hashlib.sha256(kept).hexdigest(),
                kept.decode("utf-8", "replace") if collapsed else None,
            )


class _Ratio:
    """Sorts the greater exact length / period first."""

    __slots__ = ("length", "period")

    def __init__(self, length: int, period: int):
        self.length, self.period = length, period

    def __lt__(self, other: _Ratio) -> bool:
        return self.length * other.period > other.length * self.period

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Ratio) and self.length * other.period == other.length * self.period


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", collapsed: bool = True) -> DataFrame:
    """One row a document: doc_id and the columns of ``RESULT``.

    ``start``, ``length``, ``period`` and ``exponent_milli`` are of the run with the greatest length in periods (ties:
    smallest start, then period), null without a run. ``collapsed`` is the text's words without those
    that a run repeats after its first period, one space between (null if not asked for). A
    null, empty or blank text has no words and an empty collapsed text. Words are compared byte by byte. Long texts are
    handled whole, in memory that follows the longest one; repeated rows stay; other columns are left out.
    """
    rows = docs.select(frames.col(docs, id_col).alias("doc_id"), frames.col(docs, text_col).cast("string").alias("text"))
    frames.ready(docs)
    arrow = pa.schema([
        (f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in RESULT.fields
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 512
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                made = list(describe(part.column("text"), collapsed))
                columns = [pa.array([r[k] for r in made], arrow.field(k).type) for k in range(len(arrow))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *arrow.names])

    schema = T.StructType([rows.schema["doc_id"], *RESULT.fields])
    return rows.mapInArrow(run, schema)
