"""SimHash near-duplicates: blocks that close fingerprints must share, then the Hamming distance.

A fingerprint has 64 bits. Cut into ``blocks`` parts, two fingerprints that differ in at most d
bits agree in at least ``blocks - d`` whole parts. So every choice of ``blocks - d`` parts gives a
key, and each close pair shares one of them. With 7 blocks and d = 4 these are 35 keys of 27 or 28
bits: unrelated fingerprints rarely meet. More blocks mean more, but longer, keys; for n distinct
fingerprints about C(b, d) * n * n / 2 ** (64 * (b - d) / b + 1) unrelated pairs meet, so raise
``blocks`` to 8 or 9 beyond some hundred million fingerprints.

Copies share a fingerprint and are one row from the start. Where a key still has many distinct
fingerprints, they are cut into chunks and every pair of chunks is a task's work of its own, which
returns a spanning forest and never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.functions.sizes import broadcast_if_small
from tallymart.llm import frames, text

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 7
CHUNK = 1024
SEED = 42


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text as unsigned 64-bit numbers; no words give zero."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for first, last, data, at in text.slices(texts):
        out[first:last] = _slice(text.words(data, at), shingle)
    return out


def _slice(w: text.Words, shingle: int) -> np.ndarray:
    """Votes of all shingles of a slice."""
    result = np.zeros(w.rows, dtype=np.uint64)
    if not len(w.start):
        return result
    # Words of the slice with one space after each: a shingle is then a run of these bytes.
    kept = ~text.SPACE[w.data]
    gaps = w.end[w.end < len(w.data)]
    gaps = gaps[text.SPACE[w.data[gaps]]]
    kept[gaps] = True
    place = np.cumsum(kept) - 1
    plain = w.data[kept]
    plain[text.SPACE[plain]] = 0x20
    buffer = plain.tobytes()
    starts, ends = place[w.start], place[w.end - 1] + 1
    counts = w.counts
    per_row = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    width = np.minimum(counts, shingle)
    row = np.repeat(np.arange(w.rows), per_row)
    offset = np.cumsum(per_row) - per_row
    begin = w.first[row] + np.arange(len(row)) - offset[row]
    a, b = starts[begin].tolist(), ends[begin + width[row] - 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(buffer[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a)
    )
    full = np.flatnonzero(per_row)
    for part in _parts(offset[full], per_row[full]):
        rows = full[part]
        lo, hi = offset[rows[0]], offset[rows[-1]] + per_row[rows[-1]]
        bits = np.unpackbits(hashes[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes = np.add.reduceat(bits, offset[rows] - lo, axis=0, dtype=np.int32)
        set_bits = 2 * votes > per_row[rows][:, None]
        result[rows] = np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return result


def _parts(offset: np.ndarray, size: np.ndarray, most: int = 1 << 16) -> Iterator[slice]:
    """Runs of rows with about ``most`` shingles, so that the bit table stays small."""
    first = 0
    while first < len(offset):
        last = int(np.searchsorted(offset + size, offset[first] + most, side="right"))
        last = max(last, first + 1)
        yield slice(first, last)
        first = last


def with_fingerprint(
    docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, name: str = "fingerprint"
) -> DataFrame:
    """All columns of ``docs`` and the fingerprint as a signed long called ``name``."""

    frames.ready(docs)

    @F.arrow_udf(T.LongType())
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(fingerprints(batch, shingle).view(np.int64))

    return docs.withColumn(name, simhash(frames.col(docs, text_col)))


def masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """For each choice of ``blocks - max_bits`` blocks a mask of their bits, as signed longs."""
    if not 0 <= max_bits < blocks <= 64:
        raise ValueError("blocks must be more than max_bits and at most 64")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    found = []
    for chosen in combinations(part, blocks - max_bits):
        value = sum(chosen)
        found.append(value - (1 << 64) if value >> 63 else value)
    return found


def blocks_for(fingerprints: int, max_bits: int = MAX_BITS) -> int:
    """The number of blocks, ``BLOCKS`` at least, whose keys have as many bits as it takes to tell so many apart.

    Chance candidates then grow with the number of fingerprints and not with its square.
    """
    blocks = max(BLOCKS, max_bits + 1)
    while blocks < 16 and 64 * (blocks - max_bits) // blocks < math.log2(max(2, fingerprints)):
        blocks += 1
    return blocks


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) of the components of one bucket."""
    left = np.unique(fps)
    members, roots = [], []
    bits = left.view(np.uint64)
    while len(left):
        root, frontier = left[0], bits[:1]
        left, bits = left[1:], bits[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for i in range(0, len(frontier), 256):
                far = np.flatnonzero(~near)
                near[far] = (
                    np.bitwise_count(bits[far][:, None] ^ frontier[None, i : i + 256]) <= max_bits
                ).any(axis=1)
            frontier = bits[near]
            members.append(left[near])
            roots.append(np.full(int(near.sum()), root))
            left, bits = left[~near], bits[~near]
    if not members:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(members), np.concatenate(roots)


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` between the distinct longs ``fp`` that join all pairs within ``max_bits``.

    Not every close pair is a row: each bucket gives a spanning forest of its close pairs, so the
    components are those of all pairs. Pairs that share a key alone are compared in SQL.
    """
    keys = F.array(*[
        F.struct(F.lit(i).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(masks(blocks, max_bits))
    ])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    buckets = keyed.groupBy("t", "key").agg(
        F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
    )
    buckets = frames.store(buckets.where("n > 1"), "buckets")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = buckets.where("n = 2").where(close).select("a", "b")

    # Larger buckets: chunk i meets chunk j in a group of its own.
    large = buckets.where("n > 2").select("t", "key", F.ceil(F.col("n") / chunk).alias("c"))
    rows = keyed.join(large, ["t", "key"])
    own = F.when(F.col("c") > 1, F.pmod(F.xxhash64("fp"), F.col("c"))).otherwise(F.lit(0))
    rows = rows.select("t", "key", "fp", "c", own.cast("int").alias("own"))
    rows = rows.select(
        "t", "key", "fp", "own", F.explode(F.sequence(F.lit(0), (F.col("c") - 1).cast("int"))).alias("other")
    ).select(
        F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("part"), "fp"
    )

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_part = held_fp = np.zeros(0, dtype=np.int64)

        def done(part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            at = text.runs(part)
            found = [_forest(fp[i:j], max_bits) for i, j in zip(at[:-1], at[1:], strict=True)]
            none = np.zeros(0, dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([none, *(f[k] for f in found)])) for k in (0, 1)], ["a", "b"]
            )

        for batch in batches:
            part = np.concatenate((held_part, batch.column(0).to_numpy()))
            fp = np.concatenate((held_fp, batch.column(1).to_numpy()))
            if not len(part):
                continue
            cut = int(np.searchsorted(part, part[-1], side="left"))  # the last group may go on
            if cut:
                yield done(part[:cut], fp[:cut])
            held_part, held_fp = part[cut:], fp[cut:]
        if len(held_part):
            yield done(held_part, held_fp)

    spread = rows.repartition(frames.partitions(frames.ready(fps)), "part").sortWithinPartitions("part")
    return pairs.union(spread.mapInArrow(forests, "a long, b long"))


def _classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, blocks: int | None) -> DataFrame:
    """Rows ``(doc_id, fp, component_id)``, one a document."""
    rows = docs.select(frames.col(docs, id_col).alias("doc_id"), frames.col(docs, text_col).alias("text"))
    rows = frames.store(with_fingerprint(rows, "text", shingle, "fp").select("doc_id", "fp"), "simhash")
    classes = frames.store(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    if blocks is None:
        blocks = blocks_for(classes.count(), max_bits)
    found = frames.components(links(classes.select("fp"), max_bits, blocks))
    member = classes.join(found, classes.fp == found.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    # Only components of several fingerprints are looked up: a giant one is a hot key of that join.
    member = frames.store(member, "members")
    lows = member.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    lows = broadcast_if_small(frames.store(lows.where("n > 1").select("root", "component_id"), "lows"))
    named = member.join(lows, "root", "left").select(F.col("fp").alias("own"), F.coalesce("component_id", "low").alias("component_id"))
    return rows.join(named, F.col("fp") == F.col("own")).select("doc_id", "fp", "component_id")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    blocks: int | None = None,
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id that links of at most ``max_bits`` bits reach, the
    document's own included. Null, empty and blank texts have fingerprint zero and link like any
    other. A null id is returned, but names a component only where no other id is in it. Repeated
    rows stay repeated. Other columns are left out, so none can clash; no rows give no rows.
    """
    return _classed(docs, id_col, text_col, shingle, max_bits, blocks).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    blocks: int | None = None,
) -> DataFrame:
    """The rows of ``docs`` that open their component: the one with its smallest id stays.

    Where several rows of a component have that id (repeated rows, or no row has an id), the one
    with the smallest (fingerprint, text) stays. All columns are kept as they are, whatever their
    names.
    """
    found = frames.store(_classed(docs, id_col, text_col, shingle, max_bits, blocks), "classed")
    opens = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(opens).alias("opens")).where("opens")
    key = frames.fresh(docs.columns, "own_id")

    def chosen(which: str) -> DataFrame:
        named = broadcast_if_small(ids.where(which).select(F.col("doc_id").alias(key)))
        return docs.join(named, frames.col(docs, id_col).eqNullSafe(F.col(key)), "left_semi")

    # Ids that several rows share need the fingerprint again, to tell which row opens what.
    mark = frames.fresh(docs.columns, "own_fp")
    shared = with_fingerprint(chosen("rows > 1"), text_col, shingle, mark)
    opened = found.where(opens).select("doc_id", "fp", "component_id").distinct().select(
        F.col("doc_id").alias("open_id"), F.col("fp").alias("open_fp"), F.col("component_id").alias("open_root")
    )
    whole = F.struct(*[frames.col(docs, c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    order = F.struct(F.col(mark), frames.col(docs, text_col))
    rows = shared.select(whole.alias("whole"), order.alias("place"), frames.col(docs, id_col).alias("id"), F.col(mark).alias("fp"))
    best = (
        rows.join(opened, F.col("id").eqNullSafe(F.col("open_id")) & (F.col("fp") == F.col("open_fp")))
        .groupBy("open_id", "open_root", "id")
        .agg(F.min_by("whole", "place").alias("whole"))
    )
    back = best.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return chosen("rows = 1").union(back)
