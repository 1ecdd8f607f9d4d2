"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

Items and documents are sequences of words (letters and digits, lower-cased). A CGK walk reads words
from a place on: at step j it outputs the word under the cursor and moves on if a random bit of
(word, j) is set. Two passages at small edit distance then have embeddings at small Hamming distance:
after an edit both walks soon read the same words again. A repetition is a walk of its own and hashes a
sample of the positions of its embedding; places whose samples agree are candidates.

Items are grouped by length: class c has m = 4 * 2**c up to 2m - 1 words. Windows start at every word of
items and documents, and a walk of two steps a word covers about a window: half the shortest item of the
class, and less in long ones, since agreement falls with every edit a walk meets. With 20 % of the words
edited, at least ``AGREEMENT ** SAMPLED`` of the walks give a passage and its item a common key, whatever the
kind and place of the edits (measured: see the tests); ``repetitions`` says how many walks that takes. Around
each hit the words of the document are kept, and the least edit distance of the item to any passage there is
computed. A passage counts if that is at most ``max_edits`` times the item's words.

Items of one to three words admit no edit: their one walk reads the whole item, and a passage equals it.

Documents meet items by common keys. Two bounds, which let every passage through, keep others out. Windows
pass filters of fixed size built from all items: the window's key must be that of an item, and enough
neighbouring words around it must be neighbours in some item. And an edit breaks two pairs of neighbours at
most, so a stretch of a document must hold all but so many of the different pairs of the item it met.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.functions.sizes import broadcast_if_small
from tallymart.llm import frames, text

MAX_EDITS = 0.2
TARGET_RECALL = 0.9999
AGREEMENT = 0.76  # of a sampled position, in the best window of the passages hit least: 16 words, 3 close ones deleted
SAMPLED = 4  # positions of an embedding in a key
WALK = 2  # steps for each word of a window
WINDOWS = (2, 4, 8)  # words of the windows by class; longer classes have the last
FILTER_BITS = 22
CLASSES = 24
SEED = 0xC6A4A7935BD1E995

_U = np.uint64
_MASK = _U((1 << FILTER_BITS) - 1)
_SHIFTS = 0, 32 - FILTER_BITS, 32  # the first two read a key's lower half alone
_SPREAD = _U(0x9E3779B97F4A7C15)
_BLOCK = 1 << 15  # places walked at once: their arrays fit a core's cache

# Everything but ASCII letters, digits and the bytes of longer characters ends a word.
BREAKS = np.ones(256, dtype=bool)
BREAKS[48:58] = BREAKS[65:91] = BREAKS[97:123] = BREAKS[128:] = False


def repetitions(recall: float = TARGET_RECALL, agreement: float = AGREEMENT, sampled: int = SAMPLED) -> int:
    """Walks after which a passage of this agreement is hit with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agreement**sampled)))


def cut(data: np.ndarray, at: np.ndarray) -> text.Words:
    """The words of a slice.

    Capital letters of the Latin-1 range are lower-cased as well: their second byte is 32 less.
    """
    data = data.copy()
    high = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    data[1:][high] += 0x20
    return text.words(data, at, BREAKS)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice and the offsets of its rows."""
    w = cut(data, at)
    return w.hashes(), w.first


def numbers(first: str | bytes, second: str | bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words of two texts as numbers that are equal where the bytes are."""
    w = cut(*text.buffers(pa.array([v.encode() if isinstance(v, str) else v for v in (first, second)], pa.large_binary())))
    number = w.array().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return number[: w.first[1]], number[w.first[1] :]


def kind(klass: int) -> int:
    """Classes of one kind have the same walks."""
    return klass if klass > CLASSES else min(klass, len(WINDOWS) - 1)


def shape(klass: int) -> tuple[int, int]:
    """Words and stride of the windows of a length class."""
    return klass - CLASSES if klass > CLASSES else WINDOWS[kind(klass)], 1


def class_of(n_words: int) -> int:
    """Classes of items of 1 to 3 words, which take no edit, come behind the others; -1 for no words."""
    return n_words.bit_length() - 3 if n_words >= 4 else CLASSES + n_words if n_words else -1


class Walks:
    """The random choices: steps to sample by kind of class and repetition, moves by repetition.

    Step j of repetition r moves on by bit 32 + j % 32 of the word's hash times a constant of (r, j // 32).
    One step is sampled from each of ``SAMPLED`` equal parts of the walk. Items that take no edit have one
    walk, which reads their words in order. A zero ends a row: its product has no bit that moves on, so
    a walk beyond a row reads zeros.
    """

    def __init__(self, klasses: list[int], reps: int):
        self.klasses, self.reps = klasses, reps
        self.steps: dict[int, list[list[int]]] = {}
        for k in sorted({kind(klass) for klass in klasses}):
            width = shape(k)[0]
            if k > CLASSES:
                self.steps[k] = [list(range(width))]
                continue
            edges = [WALK * width * part // SAMPLED for part in range(SAMPLED + 1)]
            draw = np.random.default_rng((SEED, k))
            self.steps[k] = [[int(draw.integers(a, b)) for a, b in zip(edges, edges[1:])] for _ in range(reps)]
        draw = np.random.default_rng((SEED, 1 << 20))
        longest = WALK * max(WINDOWS)
        self.factors = draw.integers(1 << 62, size=(reps, longest // 32 + 1), dtype=np.int64).view(_U) * _U(2) + _U(1)

    def keys(self, words: np.ndarray, starts: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(class, keys of its windows) for each repetition; ``words`` are one row."""
        for klass in self.klasses:
            for rep in range(len(self.steps[kind(klass)])):
                if len(starts[klass]):
                    yield klass, self.full(words, starts[klass], kind(klass), rep)

    def full(self, words: np.ndarray, at: np.ndarray, k: int, rep: int) -> np.ndarray:
        """Keys of the walks from these places: the sum of sampled symbols times powers of a constant."""
        steps = self.steps[k][rep]
        padded = np.concatenate((words, np.zeros(steps[-1] + 1, dtype=_U)))
        at, key = at.astype(np.int64), np.full(len(at), _seed(k, rep), dtype=_U)
        for step in range(steps[-1] + 1):
            word = padded[at]
            if step in steps:
                key += word * _U(pow(int(_SPREAD), steps.index(step), 1 << 64))
            if k > CLASSES:
                at += 1
            else:
                at += ((word * self.factors[rep, step // 32]) >> _U(32 + step % 32) & _U(1)).view(np.int64)
        return key

    def low(self, words: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(kind, repetition, first place, the lower 32 bits of the keys from there on), block by block."""
        longest = max(s[-1] for steps in self.steps.values() for s in steps)
        padded = np.concatenate((words, np.zeros(longest, dtype=_U)))
        symbols = padded.astype(np.uint32)
        for a in range(0, len(words), _BLOCK):
            n = min(_BLOCK, len(words) - a)
            part, symbol = padded[a : a + n + longest], symbols[a : a + n + longest]
            for rep in range(self.reps):
                moves = [(part * factor >> _U(32)).astype(np.uint32) for factor in self.factors[rep]]
                for k, steps in self.steps.items():
                    if rep < len(steps):
                        yield k, rep, a, self._low(symbol, moves, n, steps[rep], k, rep)

    @staticmethod
    def _low(symbol: np.ndarray, moves: list[np.ndarray], n: int, steps: list[int], k: int, rep: int) -> np.ndarray:
        """From the last sampled step back, for all places at once.

        What a walk reads from a place on is what it reads from there or from the next place, as the bit
        of the word says, so each step selects between neighbours.
        """
        last = steps[-1]
        key = np.zeros(n + last, dtype=np.uint32)
        moved, other = np.empty_like(key), np.empty_like(key)
        for step in range(last, -1, -1):
            size = n + step
            if step < last and k > CLASSES:
                key = key[1:]
            elif step < last:
                mask, differ = moved[:size], other[:size]
                np.left_shift(moves[step // 32][:size], np.uint32(31 - step % 32), out=mask)
                np.right_shift(mask.view(np.int32), 31, out=mask.view(np.int32))  # all ones where the walk moves on
                np.bitwise_xor(key[1 : size + 1], key[:size], out=differ)
                np.bitwise_and(differ, mask, out=differ)
                key = key[:size]
                np.bitwise_xor(key, differ, out=key)
            if step in steps:
                key *= np.uint32(_SPREAD & _U(0xFFFFFFFF))
                key += symbol[:size]
        return key + np.uint32(_seed(k, rep) & _U(0xFFFFFFFF))


def _seed(k: int, rep: int) -> np.uint64:
    return text.mix(np.array([(k << 16) | rep], dtype=_U))[0]


def _starts(first: np.ndarray, width: int, stride: int) -> np.ndarray:
    """Starts of whole windows of each row, every ``stride`` words."""
    counts = np.maximum(0, (np.diff(first) - width) // stride + 1)
    row = np.repeat(np.arange(len(counts)), counts)
    offset = np.cumsum(counts) - counts
    return first[:-1][row] + (np.arange(len(row)) - offset[row]) * stride


def item_keys(items: DataFrame, reps: int, max_edits: float = MAX_EDITS) -> DataFrame:
    """Rows (item, klass, need, keys, pairs): the keys of an item's windows, its pairs of neighbours, and how many
    of these a passage has at least."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[int, Walks] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first_row, last_row, data, at in text.slices(batch.column(1)):
                hashes, first = word_hashes(data, at)
                out: list[tuple] = []
                for row in range(last_row - first_row):
                    words = hashes[first[row] : first[row + 1]]
                    klass = class_of(len(words))
                    if klass < 0:
                        continue
                    walk = walks.setdefault(klass, Walks([klass], reps))
                    starts = _starts(np.array([0, len(words)]), *shape(klass))
                    found = np.unique(np.concatenate([key for _, key in walk.keys(words, {klass: starts})]))
                    pairs = np.unique(pairs_of(words))
                    broken = 2 * math.floor(max_edits * len(words) + 1e-9)
                    need = max(0, len(pairs) - broken)
                    out.append((int(ids[first_row + row]), klass, need, found.view(np.int64), pairs.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[i] for o in out], kind) for i, kind in enumerate(_ITEM_KEYS.values())], list(_ITEM_KEYS)
                )

    return items.select("item", "text").mapInArrow(keys, "item long, klass int, need int, keys array<bigint>, pairs array<bigint>")


def candidates(found: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (region, item) with a common key and as many common pairs of neighbours as a passage has at least."""
    seen = found.select("region", "klass", F.explode("keys").alias("key"))
    own = frames.store(keys.select("item", "klass", F.explode("keys").alias("key")), "windows")
    met = seen.join(broadcast_if_small(own), ["klass", "key"]).select("region", "item").distinct()
    both = met.join(keys.select("item", "need", F.col("pairs").alias("item_pairs")), "item").join(
        found.select("region", "pairs"), "region"
    )
    return both.where(F.size(F.array_intersect("pairs", "item_pairs")) >= F.col("need")).select("region", "item")


def pairs_of(words: np.ndarray) -> np.ndarray:
    """A hash for each word and the next one."""
    return text.mix(words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:])


def item_pairs(items: DataFrame) -> DataFrame:
    """Rows (key): a hash for each two neighbouring words of an item."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in text.slices(batch.column(0)):
                hashes, first = word_hashes(data, at)
                inner = np.setdiff1d(np.arange(len(hashes) - 1), first[1:-1] - 1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs_of(hashes)[inner].view(np.int64))], ["key"])

    return items.select("text").mapInArrow(pairs, "key long").distinct()


def key_filter(keys: DataFrame, pairs: DataFrame) -> np.ndarray:
    """Four tables of 2**FILTER_BITS flags: three for window keys, by ``_SHIFTS``, one for pairs of words.

    Their size does not depend on the items; with more items more windows pass.
    """
    table = np.zeros((4, 1 << FILTER_BITS), dtype=bool)
    for i, (frame, shift) in enumerate([*((keys, shift) for shift in _SHIFTS), (pairs, 0)]):
        cell = F.shiftrightunsigned("key", shift).bitwiseAND(int(_MASK))
        found = frame.select(cell.alias("cell")).distinct().toArrow()["cell"].to_numpy()
        table[i, found] = True
    return table


_REGION = T.StructType([
    T.StructField("region", T.LongType()),
    T.StructField("klass", T.IntegerType()),
    T.StructField("doc", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("words", T.BinaryType()),
    T.StructField("keys", T.ArrayType(T.LongType())),
    T.StructField("pairs", T.ArrayType(T.LongType())),
])


def regions(docs: DataFrame, table: np.ndarray, klasses: list[int], reps: int) -> DataFrame:
    """Stretches of documents around windows that pass the filter, with the keys and the items' pairs of neighbours seen in them."""
    sent = frames.ready(docs).sparkContext.broadcast(np.packbits(table, axis=1))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = sent.value[0]
        middle, high, pair = (np.unpackbits(t).view(bool) for t in sent.value[1:])
        walks = Walks(klasses, reps)
        base, made = (TaskContext.get().partitionId() << 33), 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first_row, _, data, at in text.slices(batch.column(1)):
                w = cut(data, at)
                hashes, first = w.hashes(), w.first
                rows = len(first) - 1
                ended = np.insert(hashes, first[1:], _U(0))  # a zero ends each row
                left = np.insert(np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes)), first[1:], 0)
                hits: dict[int, list[tuple]] = {k: [] for k in walks.steps}
                for k, rep, begin, key in walks.low(ended):
                    maybe = _flagged(low, key)
                    maybe = maybe[middle[key[maybe] >> np.uint32(_SHIFTS[1])]] + begin
                    maybe = maybe[left[maybe] >= shape(k)[0]]
                    if not len(maybe):
                        continue
                    keys = walks.full(ended, maybe, k, rep)
                    seen = high[((keys >> _U(_SHIFTS[2])) & _MASK).view(np.int64)]
                    maybe, keys = maybe[seen], keys[seen]
                    if len(maybe):
                        place = maybe - np.searchsorted(first[1:] + np.arange(rows), maybe)
                        hits[k].append((place, keys))
                if not any(hits.values()):
                    continue
                pairs = pairs_of(hashes)
                known = pair[(pairs & _MASK).view(np.int64)]
                out: list[tuple] = []
                for klass in klasses:
                    if found := hits[kind(klass)]:
                        where, keys = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                        likely = _likely(where, klass, known)
                        where, keys = where[likely], keys[likely]
                        out += [(klass, *o) for o in _merged(where, keys, klass, w, pairs, known)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range(base + made, base + made + len(out)), pa.int64()),
                         pa.array([o[0] for o in out], pa.int32()),
                         pa.array([int(ids[first_row + o[1]]) for o in out], pa.int64()),
                         pa.array([int(o[2]) for o in out], pa.int64()),
                         pa.array([o[3].tobytes() for o in out], pa.binary()),
                         pa.array([o[4].view(np.int64) for o in out], pa.list_(pa.int64())),
                         pa.array([o[5].view(np.int64) for o in out], pa.list_(pa.int64()))],
                        names=_REGION.names,
                    )
                    made += len(out)

    return docs.select("doc", "text").mapInArrow(find, _REGION)


def _flagged(packed: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the keys whose flags are set; eight flags a byte stay in a core's cache."""
    byte = packed.take((key & np.uint32(_MASK)) >> np.uint32(3), mode="clip")
    return np.flatnonzero(np.left_shift(byte, key.astype(np.uint8) & np.uint8(7)) & np.uint8(128))


def _likely(where: np.ndarray, klass: int, known: np.ndarray) -> np.ndarray:
    """Which windows can lie in a passage: enough pairs of words around them are in some item.

    Of the n - 1 pairs of an item an edit breaks two at most, so a passage keeps 0.6 n - 1 of them,
    on at most 1.2 n words with the window among them; n is m at least and less than 2 m.
    """
    if klass > CLASSES:
        return np.ones(len(where), dtype=bool)
    least = 4 << klass
    reach, step = _reach(klass), max(1, least // 4)
    total = np.concatenate(([0], np.cumsum(known)))
    best = np.zeros(len(where), dtype=np.int64)
    for back in range(0, reach + step, step):
        a = np.clip(where - back, 0, len(known))
        b = np.clip(where - back + reach + step, 0, len(known))
        best = np.maximum(best, total[b] - total[a])
    return best >= (1 - 2 * MAX_EDITS) * least - 1 - 1e-9


def _reach(klass: int) -> int:
    """Words of the longest passage of a class."""
    if klass > CLASSES:
        return klass - CLASSES
    return math.ceil((4 << klass) * 2 * (1 + MAX_EDITS))


def _merged(
    where: np.ndarray, keys: np.ndarray, klass: int, w: text.Words, pairs: np.ndarray, known: np.ndarray
) -> Iterator[tuple]:
    """(row, first word in it, their text, keys, known pairs) for hits of one class, overlapping surroundings as one.

    An item of the class has less than 2m words, so it lies within 2.4 m words around a window of it
    even with the edits allowed. A stretch ends after 16 such lengths, and the next begins anew.
    """
    reach, width, first = _reach(klass), shape(klass)[0], w.first
    order = np.argsort(where, kind="stable")
    where, keys = where[order], keys[order]
    rows = np.searchsorted(first, where, side="right") - 1
    i = 0
    while i < len(where):
        j = i + 1
        while j < len(where) and rows[j] == rows[i] and where[j] - where[j - 1] <= reach and where[j] - where[i] <= 16 * reach:
            j += 1
        row = rows[i]
        a = max(first[row], where[i] - reach)
        b = min(first[row + 1], where[j - 1] + width + reach)
        # All keys in the stretch: a passage has its windows in one stretch at least.
        inside = slice(np.searchsorted(where, a), np.searchsorted(where, b - width, side="right"))
        inner = np.unique(pairs[a : b - 1][known[a : b - 1]])
        yield row, a - first[row], w.data[w.start[a] : w.end[b - 1]], np.unique(keys[inside]), inner
        i = j


def passage(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(edits, first word, words) of the passage nearest to ``item``: leftmost end, then shortest.

    Row by row over the item, with a free start and end in ``words``.
    """
    n = len(words)
    cost = np.zeros(n + 1, dtype=np.int64)
    begin = np.arange(n + 1)
    ahead = np.arange(n + 1)
    for k, word in enumerate(item):
        below = np.empty(n + 1, dtype=np.int64)
        origin = np.empty(n + 1, dtype=np.int64)
        below[0], origin[0] = k + 1, 0
        swap = cost[:-1] + (words != word)
        drop = cost[1:] + 1
        take = swap <= drop
        below[1:] = np.where(take, swap, drop)
        origin[1:] = np.where(take, begin[:-1], begin[1:])
        # Extra words of the document: the best earlier cell plus one for each word since.
        level = below - ahead
        best = np.minimum.accumulate(level)
        moved = best < level
        source = np.where(level == best, ahead, 0)
        source = np.maximum.accumulate(source)
        below = best + ahead
        origin = np.where(moved, origin[source], origin)
        cost, begin = below, origin
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), int(end - begin[end])


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    max_edits: float = MAX_EDITS,
    recall: float = TARGET_RECALL,
) -> DataFrame:
    """Rows ``(doc_id, item_id, edit_distance, item_words, first_word, passage_words)``.

    One row for each document and item of which the document holds a passage within
    ``floor(max_edits * item_words)`` word edits: the one with the fewest edits, then the first.
    Null, empty and blank texts hold and are nothing; items of one to three words are found where
    they stand word for word, so a common word as an item finds many documents. Repeated documents or items give one row for each pair of ids; a null id is reported
    as null. Columns other than the named ones are left out, so none can clash.
    """
    if not 0 <= max_edits <= MAX_EDITS:
        raise ValueError(f"max_edits must be between 0 and {MAX_EDITS}")
    spark = frames.ready(docs)
    reps = repetitions(recall)
    # Repeated texts of an item need one search; ids come back at the end.
    named = items.select(frames.col(items, item_id_col).alias("item_id"), frames.col(items, item_text_col).alias("text"))
    named = frames.store(
        named.where("text is not null").withColumn("item", F.xxhash64("text")).distinct(), "items"
    )
    texts = named.select("item", "text").dropDuplicates(["item"])
    keys = frames.store(item_keys(texts, reps, max_edits), "item-keys")
    klasses = sorted(r["klass"] for r in keys.select("klass").distinct().limit(CLASSES + 4).collect())
    schema = "doc_id long, item_id long, edit_distance int, item_words int, first_word long, passage_words int"
    if not klasses:
        return spark.createDataFrame([], schema)
    rows = docs.select(frames.col(docs, id_col).cast("long").alias("doc"), frames.col(docs, text_col).alias("text"))
    rows = rows.where("text is not null").withColumn("doc", F.coalesce("doc", F.lit(_NULL)))
    windows = keys.select(F.explode("keys").alias("key"))
    found = frames.store(regions(rows, key_filter(windows, item_pairs(texts)), klasses, reps), "regions")
    met = candidates(found, keys)
    pairs = met.join(broadcast_if_small(texts), "item").join(
        found.select("region", "doc", "start", "words"), "region"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, body, doc, start, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, around = numbers(body, words)
                most = math.floor(max_edits * len(own) + 1e-9)
                # An edit takes two pairs of neighbours at most; most wrong candidates end here.
                kept = np.isin(pairs_of(own.astype(_U)), pairs_of(around.astype(_U))).sum()
                if kept < len(own) - 1 - 2 * most:
                    continue
                edits, first, length = passage(own, around)
                if edits <= most:
                    out.append((doc, item, edits, len(own), start + first, length))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], kind) for i, kind in enumerate(_FOUND.values())], list(_FOUND)
            )

    exact = pairs.select("item", "text", "doc", "start", "words").mapInArrow(
        verify, "doc long, item long, edits int, item_words int, first_word long, passage_words int"
    )
    best = exact.groupBy("doc", "item").agg(
        F.min(F.struct("edits", "first_word", "passage_words", "item_words")).alias("b")
    )
    return best.join(broadcast_if_small(named.select("item", "item_id")), "item").select(
        F.nullif(F.col("doc"), F.lit(_NULL)).alias("doc_id"),
        F.col("item_id").cast("long"),
        F.col("b.edits").alias("edit_distance"),
        F.col("b.item_words").alias("item_words"),
        F.col("b.first_word").alias("first_word"),
        F.col("b.passage_words").alias("passage_words"),
    )


_NULL = -(1 << 63)
_ITEM_KEYS = {
    "item": pa.int64(), "klass": pa.int32(), "need": pa.int32(), "keys": pa.list_(pa.int64()), "pairs": pa.list_(pa.int64()),
}
_FOUND = {
    "doc": pa.int64(), "item": pa.int64(), "edits": pa.int32(), "item_words": pa.int32(),
    "first_word": pa.int64(), "passage_words": pa.int32(),
}


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` whose ids hold no passage of an item, with their own columns."""
    key = frames.fresh(docs.columns, "leaking_id")
    found = leaks(docs, items, id_col, text_col, **settings).select(F.col("doc_id").alias(key)).distinct()
    found = broadcast_if_small(frames.store(found, "leaking"))
    return docs.join(found, frames.col(docs, id_col).eqNullSafe(F.col(key)), "left_anti")
