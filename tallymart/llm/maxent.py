"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class times that of the token in its class, given the two words before.
The ``HEAD`` most frequent words, the end of text among them, form classes of equal weight; all others
are in the last class, where a word has its add-one share of the class's training tokens.

- The class comes from a softmax over three features: the word before, the word before that (a skip) and both
  together, hashed to rows of weights. It is trained by gradient steps with row-wise adaptive rates.
- The word in its class has a weight for each word it was seen after, and one for each pair, with a
  Gaussian prior. All other weights are zero, so the normaliser is one plus a sum over the words
  seen in that context: exact over the whole class, whatever its size. Both are trained by curvature-scaled gradients.

The logs of the class's and the word's own shares are added, so the untrained model is the plain unigram model.

The model is nowhere whole. Tokens are shuffled to shards by the word before them; a shard trains the weights of
its contexts on its training tokens and scores all its tokens. The number of shards follows the bytes of text, and
the rows of a shard its distinct events, so the weights grow with the corpus. Neither the number of
tasks nor the order of the rows has a part in the result beyond the rounding of sums: a shard counts equal events
first and takes them in the order of their hashes. Events that are only scored stand there with a count of zero. A frequent word is spread over shards by the word before it,
and a pair of two very frequent words by document as well.

Word counts, tokens and distinct words are exact sums over all training texts. Words are known by 64-bit
hashes; among a billion distinct words two share one with odds of 1 in 37. Counts of the ``HEAD``
words are broadcast, a fixed size. Rarer words meet their counts in a join on the hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.llm import frames, text

HEAD = 1 << 17
CLASSES = 32  # the last one holds all words outside the head
START = HEAD  # the context before a text; rarer words are hashed to contexts above it
SHARD_BYTES = 8 << 20  # text for each shard
SHARD_TOKENS = SHARD_BYTES // 8
MOST_TASKS = 1 << 15  # shards beyond this share tasks
SLICE_BYTES = 4 << 20
NEAR = 20
RATE = 0.2
STEP = 8192
PRIOR = 0.3  # inverse variance of the weights of words
ROUNDS = 10

_U = np.uint64
END = _U(0x2545F4914F6CDD1D)  # stands for the end of a text among word hashes


@dataclass
class Tokens:
    """Token hashes of a slice, the end of each text included, and rows + 1 offsets."""

    hashes: np.ndarray
    first: np.ndarray


def tokens(data: np.ndarray, at: np.ndarray) -> Tokens:
    w = text.words(data, at)
    first = w.first + np.arange(w.rows + 1)
    hashes = np.full(int(first[-1]), END, dtype=_U)
    hashes[np.arange(len(w.row)) + w.row] = w.hashes()
    return Tokens(hashes, first)


class Vocabulary:
    """The most frequent words, by hash and by rank; sums over all words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, train_tokens: int, distinct: int):
        """``hashes`` and ``counts`` go by rank."""
        order = np.argsort(hashes)
        self.hashes, self.ranks = np.append(hashes[order], ~_U(0)), np.append(order, HEAD)
        # Hashes are spread evenly, so their first bits lead to where they are.
        self.near = np.searchsorted(hashes[order], np.arange(1 << NEAR, dtype=_U) << _U(64 - NEAR)).astype(np.int32)
        self.by_rank = counts
        self.train_tokens, self.distinct = train_tokens, distinct
        # Denominator of the add-one shares: one place is kept for unknown words.
        self.total = train_tokens + distinct + 1
        mass = counts + 1.0
        middle = np.cumsum(mass) - mass / 2
        self.klass = np.full(len(mass) + 1, CLASSES - 1)
        self.klass[:-1] = np.minimum(middle * (CLASSES - 1) // max(mass.sum(), 1.0), CLASSES - 2)
        sums = np.bincount(self.klass[:-1], mass, minlength=CLASSES)
        self.rest = self.total - int(mass.sum())
        sums[-1] = self.rest
        self.share = np.log(mass / sums[self.klass[:-1]])  # of a word in its class
        with np.errstate(divide="ignore"):
            self.class_share = np.maximum(np.log(sums / self.total), -60).astype(np.float32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks, or ``HEAD`` outside the head."""
        at = self.near[hashes >> _U(64 - NEAR)]
        left = np.flatnonzero(self.hashes[at] < hashes)
        while len(left):
            at[left] += 1
            left = left[self.hashes[at[left]] < hashes[left]]
        return np.where(self.hashes[at] == hashes, self.ranks[at], HEAD)

    def classes(self, word: np.ndarray) -> np.ndarray:
        return self.klass[np.minimum(word, len(self.by_rank))]


def contexts(t: Tokens, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that, as numbers below 2**31."""
    own = np.where(rank < HEAD, rank, START + 1 + (t.hashes >> _U(34)).astype(np.int64))
    one = np.concatenate(([START], own[:-1]))
    two = np.concatenate(([START, START], own[:-2]))[: len(own)]
    starts = t.first[:-1]
    one[starts] = START
    two[starts] = START
    after = starts + 1
    two[after[after < len(two)]] = START
    return one, two


class Spread:
    """Shards of the contexts: frequent words take several, by how often they stand in the scored texts."""

    def __init__(self, v: Vocabulary, shards: int, scale: float):
        counts = np.zeros(START + 2)
        counts[: len(v.by_rank)] = v.by_rank * scale
        ends = v.find(np.array([END]))[0]
        counts[START] = counts[ends] if ends < HEAD else 0
        self.shards = shards
        self.pieces = (1 + counts // (SHARD_TOKENS // 4)).astype(_U)
        self.parts = (1 + counts // (4 * SHARD_TOKENS)).astype(_U)

    def shard(self, one: np.ndarray, two: np.ndarray, salt: np.ndarray) -> np.ndarray:
        a = np.minimum(one, START + 1)
        key = one.astype(_U)
        hot = np.flatnonzero(self.pieces[a] > 1)
        if len(hot):
            a, b = a[hot], two[hot]
            parts = np.minimum(self.parts[a], self.parts[np.minimum(b, START + 1)])
            piece = text.mix(b.astype(_U) * _U(1 << 20) + salt[hot] % parts) % self.pieces[a]
            key[hot] += piece << _U(32)
        return (text.mix(key) % _U(self.shards)).astype(np.uint16 if self.shards < 1 << 16 else np.int64)


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return text.mix(one.astype(_U) << _U(32) | two.astype(_U))


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def boosts(group: np.ndarray, prior: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of entries sorted by group, and the log of each entry's normaliser.

    An entry's probability in its group is its prior times exp(weight), normalised. Entries that were
    not seen weigh nothing and count by their priors, like all that are not listed.
    """
    at = text.runs(group)
    size = np.diff(at)
    weight, norm = np.zeros(len(n)), np.ones(len(size))
    seen = np.flatnonzero(n)
    if len(seen):
        group = np.repeat(np.arange(len(size)), size)[seen]
        prior, n = prior[seen], n[seen]
        total = np.bincount(group, n, minlength=len(size))[group]
        own = np.zeros(len(seen))
        for _ in range(ROUNDS):
            expected = total * prior * np.exp(own) / norm[group]
            own += np.clip((n - expected - PRIOR * own) / (expected + PRIOR), -1.0, 1.0)
            norm = 1.0 + np.bincount(group, prior * np.expm1(own), minlength=len(size))
        weight[seen] = own
    return weight, np.repeat(np.log(norm), size)


class Shard:
    """A shard's weights, trained on distinct events with their counts, and the logs of all its events."""

    def __init__(self, v: Vocabulary, one: np.ndarray, two: np.ndarray, word: np.ndarray, n: np.ndarray):
        """``logs`` are natural logs of the words' probabilities; for words outside the head, of their class."""
        self.v = v
        klass = v.classes(word)
        pair = _pair(one, two)
        self.bits = max(len(word).bit_length() - 2, 10)  # two to four events a row
        self.outer = np.zeros((1 << self.bits, CLASSES), dtype=np.float32)
        rows = self.rows(one, two, pair)
        self._train(rows, klass, n)
        self.logs = np.empty(len(word))
        for a in range(0, len(word), STEP):
            b = slice(a, a + STEP)
            z = self._outer(rows, b)
            self.logs[b] = np.log(np.maximum(_softmax(z)[np.arange(len(z)), klass[b]], 1e-30))
        del rows

        known = np.flatnonzero(word < HEAD)
        one, pair, word, klass, n = one[known], pair[known], word[known], klass[known], n[known].astype(float)
        entry = self.entry(one, klass, word)
        order = np.argsort(entry)
        at = text.runs(entry[order])
        self.entries = entry[order[at[:-1]]]
        entry_of = np.empty(len(order), dtype=np.int64)
        entry_of[order] = np.repeat(np.arange(len(self.entries)), np.diff(at))
        share = v.share[self.entries & (1 << 18) - 1]
        self.after, norm = boosts(self.entries >> 18, np.exp(share), np.bincount(entry_of, n, minlength=len(share)))
        # The pair's weights come on top: what the word before gives is their prior.
        given = (share + self.after - norm)[entry_of]
        group = text.mix(pair + klass.astype(_U))
        order = np.argsort(group)
        weight, norm = boosts(group[order], np.exp(given[order]), n[order])
        self.logs[known] += given
        self.logs[known[order]] += weight - norm
        self.pairs = np.zeros(len(self.logs))
        self.pairs[known[order]] = weight

    def _train(self, rows: list[np.ndarray], klass: np.ndarray, n: np.ndarray) -> None:
        squares = np.zeros(len(self.outer), dtype=np.float32)
        seen = np.flatnonzero(n)
        for a in range(0, len(seen), STEP):
            b = seen[a : a + STEP]
            error = _softmax(self._outer(rows, b))
            error[np.arange(len(b)), klass[b]] -= 1
            error *= n[b, None].astype(np.float32)
            for r in rows:
                _step(self.outer, squares, r[b], error)

    @staticmethod
    def entry(one: np.ndarray, klass: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (one << 23) | (klass << 18) | word

    def rows(self, one: np.ndarray, two: np.ndarray, pair: np.ndarray) -> list[np.ndarray]:
        """Rows of the three features."""
        down = _U(64 - self.bits)
        keys = one.astype(_U) + _U(1 << 40), two.astype(_U) + _U(2 << 40), pair
        return [(text.mix(k) >> down).astype(np.int32) for k in keys]

    def _outer(self, rows: list[np.ndarray], b: slice | np.ndarray) -> np.ndarray:
        z = self.outer[rows[0][b]]
        z += self.outer[rows[1][b]]
        z += self.outer[rows[2][b]]
        z += self.v.class_share
        return z


def _step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    """Row sums of the gradient, scaled by what the row's gradients have been so far."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    at = text.runs(ordered)
    own = ordered[at[:-1]]
    sums = np.add.reduceat(g[order], at[:-1], axis=0)
    squares[own] += np.einsum("ij,ij->i", sums, sums) / CLASSES
    weights[own] -= (RATE / np.sqrt(squares[own] + 1e-6))[:, None] * sums


def packed(shard: np.ndarray, columns: list[np.ndarray], flagged: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Shards of a slice and their events in the order of documents.

    Each is a number of events, their columns, then the documents (2 * row + 1 for training) and their numbers of events.
    """
    order = np.argsort(shard, kind="stable")
    shard, flagged = shard[order].astype(np.int64), flagged[order]
    columns = [c[order].astype(np.uint32) for c in columns]
    at = text.runs(shard)
    docs = text.runs((shard << 33) + flagged)
    ids, sizes = flagged[docs[:-1]].astype(np.uint32), np.diff(docs).astype(np.uint32)
    first = np.searchsorted(docs, at)
    bodies = []
    for a, b, c, d in zip(at[:-1], at[1:], first[:-1], first[1:], strict=True):
        parts = [np.array([b - a], dtype=np.uint32), *(x[a:b] for x in columns), ids[c:d], sizes[c:d]]
        bodies.append(b"".join(x.tobytes() for x in parts))
    return shard[at[:-1]], bodies


def shard_scores(v: Vocabulary, bodies: list[bytes | pa.Buffer]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of documents and the sums of their tokens' natural logs, for each slice of a shard; empties ``bodies``."""
    read = [np.frombuffer(body, dtype=np.uint32) for body in bodies]
    ends = [1 + 3 * int(r[0]) for r in read]
    docs = [r[e:].reshape(2, -1) for r, e in zip(read, ends, strict=True)]
    ids, sizes = np.concatenate(docs, axis=1).astype(np.int64)
    cuts = np.cumsum([d.shape[1] for d in docs])[:-1]
    one, two, word = (np.concatenate([r[1 + c * int(r[0]) : 1 + (c + 1) * int(r[0])] for r in read]) for c in range(3))
    # What is as long as the shard has tokens goes before the weights, the largest part, are made.
    bodies.clear()
    del docs, read
    key = text.mix(_pair(one, two) + word.astype(_U) * END)
    order = np.argsort(key)
    runs = text.runs(key[order])
    del key
    at = order[runs[:-1]]
    n = np.add.reduceat(np.repeat(ids & 1, sizes)[order], runs[:-1])
    events = [c[at].astype(np.int64) for c in (one, two, word)]
    del one, two, word, at
    order = order.astype(np.int32 if len(order) < 1 << 31 else np.int64)
    found = Shard(v, *events, n).logs
    logs = np.empty(len(order))
    logs[order] = np.repeat(found, np.diff(runs))
    sums = np.add.reduceat(logs, np.cumsum(sizes) - sizes)
    return list(zip(np.split(ids >> 1, cuts), np.split(sums, cuts), strict=True))


def _slice_sums(packs: pa.Table) -> pa.Table:
    """Sums by document over all shards of a slice."""
    rows = np.frombuffer(b"".join(packs["rows"].to_pylist()), dtype=np.uint32)
    sums = np.frombuffer(b"".join(packs["sums"].to_pylist()), dtype=np.float32)
    total = np.bincount(rows, sums)
    first = packs["slice"][0].as_py()
    return pa.table({"row": np.arange(first, first + len(total)), "part": total})


def word_counts(training: DataFrame, text_col: str = "text") -> DataFrame:
    """The stored counts (hash, n) of all tokens of the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tokens(data, at).hashes for _, _, data, at in text.slices(batch.column(0))]
            if found:
                hashes, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["hash", "n"])

    frames.ready(training)
    texts = training.select(F.coalesce(frames.col(training, text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(count, "hash long, n long")
    return frames.store(counted.groupBy("hash").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    first = counts.orderBy(F.desc("n"), "hash").limit(head).toArrow()
    return Vocabulary(first["hash"].to_numpy().view(_U), first["n"].to_numpy(), int(sums["n"]), int(sums["v"]))


def scores(
    docs: DataFrame,
    training: Column,
    counts: DataFrame,
    v: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score), one a document.

    ``counts`` and ``v`` are of the rows for which ``training`` holds; these also train the weights.
    ``score`` is the model's log10 probability of the text and its end, ``base_score`` that of the
    add-one unigram model. Null and empty texts are one token, the end. Repeated rows and null ids
    stay; other columns are left out.
    """
    spark = frames.ready(docs)
    rows = docs.select(
        frames.col(docs, id_col).alias("doc_id"),
        F.coalesce(frames.col(docs, text_col), F.lit("")).alias("text"),
        F.coalesce(training, F.lit(False)).alias("train"),
        F.xxhash64(frames.col(docs, id_col)).alias("salt"),
    )
    length = F.octet_length("text") + 1
    sizes = rows.agg(
        F.coalesce(F.sum(length), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("train"), length)), F.lit(0)).alias("train")
    ).first()
    shards = max(1, -(-sizes["all"] // SHARD_BYTES))
    spread = Spread(v, shards, sizes["all"] / max(sizes["train"], 1))
    sent = spark.sparkContext.broadcast((v, spread))
    base, rest = float(np.log10(v.total)), float(np.log10(max(v.rest, 1)))
    id_kind = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and its tokens as events for each shard."""
        v, spread = sent.value
        shares = np.append(np.log10(v.by_rank + 1.0), 0.0)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, last, data, at in text.slices(batch.column(1), SLICE_BYTES):
                t = tokens(data, at)
                n, starts = np.diff(t.first), t.first[:-1]
                rank = v.find(t.hashes)
                rare = rank == HEAD
                own = shares[np.minimum(rank, len(v.by_rank))]
                offsets = np.concatenate(([0], np.cumsum(rare)))[t.first]
                rows = len(n)
                yield _batch(
                    shard=pa.array(np.arange(rows) % spread.shards, pa.int32()),
                    row=pa.array(np.arange(number, number + rows)),
                    events=pa.nulls(rows, pa.binary()),
                    doc_id=batch.column(0).slice(first, rows),
                    n_tokens=pa.array(n),
                    known=pa.array(np.add.reduceat((~rare).astype(np.int64), starts)),
                    base=pa.array(np.add.reduceat(own, starts) - n * base),
                    rare=pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(t.hashes[rare].view(np.int64))),
                )
                one, two = contexts(t, rank)
                train, salt = (batch.column(c).slice(first, rows).to_numpy(zero_copy_only=False) for c in (2, 3))
                shard = spread.shard(one, two, np.repeat(salt.astype(np.int64).view(_U), n))
                flagged = np.repeat(2 * np.arange(rows) + train.astype(np.int64), n)
                shards, bodies = packed(shard, [one, two, rank], flagged)
                none = len(bodies)
                yield _batch(
                    shard=pa.array(shards, pa.int32()),
                    row=pa.array(np.full(none, number)),
                    events=pa.array(bodies, pa.binary()),
                    doc_id=pa.nulls(none, batch.column(0).type),
                    n_tokens=pa.nulls(none, pa.int64()),
                    known=pa.nulls(none, pa.int64()),
                    base=pa.nulls(none, pa.float64()),
                    rare=pa.nulls(none, pa.list_(pa.int64())),
                )
                number += rows

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents as they come; each shard's events are trained on and scored once all are there."""
        v = sent.value[0]
        held: list[tuple[int, pa.Buffer]] = []
        now, id_type = -1, pa.null()

        def finished() -> Iterator[pa.RecordBatch]:
            if held:
                slices, bodies = [row for row, _ in held], [body for _, body in held]
                held.clear()
                found = shard_scores(v, bodies)
                none = len(found)
                yield _batch(
                    row=pa.nulls(none, pa.int64()),
                    value=pa.nulls(none, pa.float64()),
                    doc_id=pa.nulls(none, id_type),
                    n_tokens=pa.nulls(none, pa.int64()),
                    known=pa.nulls(none, pa.int64()),
                    base=pa.nulls(none, pa.float64()),
                    rare=pa.nulls(none, pa.list_(pa.int64())),
                    slice=pa.array(slices, pa.int64()),
                    rows=pa.array([r.astype(np.uint32).tobytes() for r, _ in found], pa.binary()),
                    sums=pa.array([(s / np.log(10)).astype(np.float32).tobytes() for _, s in found], pa.binary()),
                )

        for batch in batches:
            id_type = batch.column(3).type
            shards, rows, bodies = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            own = batch.drop_columns(["events"]).filter(bodies.is_null())
            if own.num_rows:
                c = dict(zip(own.schema.names, own.columns, strict=True))
                rare = c["n_tokens"].to_numpy() - c["known"].to_numpy()
                yield _batch(
                    row=c["row"], value=pa.array(-rare * rest), doc_id=c["doc_id"], n_tokens=c["n_tokens"],
                    known=c["known"], base=c["base"], rare=c["rare"], slice=pa.nulls(own.num_rows, pa.int64()),
                    rows=pa.nulls(own.num_rows, pa.binary()), sums=pa.nulls(own.num_rows, pa.binary()),
                )
            # Bodies are views of the batch, which goes with the last of them.
            held_here = [(int(shards[i]), int(rows[i]), bodies[int(i)].as_buffer()) for i in np.flatnonzero(bodies.is_valid())]
            del batch, own, shards, rows, bodies
            held_here.reverse()
            while held_here:
                shard, row, body = held_here.pop()
                if shard != now:
                    yield from finished()
                    now = shard
                held.append((row, body))
                del body
        yield from finished()

    doc_kind = f"doc_id {id_kind}, n_tokens long, known long, base double, rare array<bigint>"
    events = rows.mapInArrow(read, f"shard int, row long, events binary, {doc_kind}")
    sharded = events.repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard")
    scored = frames.store(sharded.mapInArrow(score, f"row long, value double, {doc_kind}, slice long, rows binary, sums binary"), "scored")

    own = scored.where(F.col("row").isNotNull()).drop("slice", "rows", "sums")
    # Shards return their sums by slices of documents, so there are never more rows than slices times shards.
    packs = scored.where(F.col("slice").isNotNull()).select("slice", "rows", "sums")
    summed = packs.groupBy("slice").applyInArrow(_slice_sums, "row long, part double")
    # Words outside the head: their counts come by a join, both scores add the log of the count.
    met = own.select("row", F.explode("rare").alias("hash")).join(counts, "hash")
    nothing = F.lit(0.0)
    parts = met.select("row", F.lit(1).alias("more"), F.log10(F.col("n") + 1).alias("share"), nothing.alias("part")).union(
        summed.select("row", F.lit(0), nothing, "part")
    )
    sums = parts.groupBy("row").agg(F.sum("more").alias("more"), F.sum("share").alias("share"), F.sum("part").alias("part"))
    joined = own.drop("rare").join(sums.withColumnRenamed("row", "own"), F.col("row") == F.col("own"), "left")
    share = F.coalesce("share", nothing)
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(v.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + share).alias("base_score"),
        (F.col("value") + F.coalesce("part", nothing) + share).alias("score"),
    )


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def score_corpus(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all ``docs`` under a model of those rows for which ``training`` holds."""
    counts = word_counts(docs.where(training), text_col)
    return scores(docs, training, counts, vocabulary(counts), id_col, text_col)
