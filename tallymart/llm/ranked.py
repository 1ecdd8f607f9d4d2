"""Ranked lexical search: documents for each item of a query set, by exact integer term scores.

Two passes over the documents. The first counts, task by task, the documents and terms and the documents
that hold each term of the items; Spark adds the counts up. The second multiplies: a tile of items has
the terms of its items as a compact vocabulary and their weights as a matrix, a tile of documents has
the impacts of those terms, and one BLAS product in float64 gives all scores of the two tiles. Weights and
impacts are whole numbers, and columns are cut so that no partial sum reaches 2**53: the products
are exact, and sums over column tiles are kept in 64-bit integers.

Each task keeps the best rows of each item. What a tile adds is cut at the k-th score with all its
ties, and only sorting by score and then id drops rows, so equal scores cannot lose the smaller id.
Items come in blocks of bounded text, each read by tasks as one broadcast; a block costs two passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.llm import frames, text

TOP = 50

# Fixed values of the score: milli-units of weights and impacts, and the length's share of the damping.
SCALE = 1_000_000_000
UNIT = 1000
DAMPING = 20
FIXED_SHARE = 50
LENGTH_SHARE = 50

# Bounds: bytes of item texts in a block, items in a tile, columns and documents in a tile, rows kept
# before a task sorts them.
BLOCK_BYTES = 4 << 20
TILE_ITEMS = 64
TILE_TERMS = 2048
TILE_DOCS = 1024
KEPT_ROWS = 1 << 18

EXACT = 1 << 53

# A term is a run of ASCII letters and digits and of everything beyond ASCII; A-Z are lower-cased.
BREAKS = np.ones(256, dtype=bool)
BREAKS[0x30:0x3A] = BREAKS[0x41:0x5B] = BREAKS[0x61:0x7B] = BREAKS[0x80:] = False


def terms(data: np.ndarray, at: np.ndarray) -> tuple[text.Words, pa.Array]:
    """The places of a slice's terms and the terms themselves."""
    cut = text.words(data, at, BREAKS)
    return cut, cut.array()


@dataclass
class Items:
    """A block of items: ids, the vocabulary of all their terms, and each item's distinct terms."""

    ids: pa.Array
    vocabulary: pa.Array
    held: list[np.ndarray]

    @classmethod
    def of(cls, ids: pa.Array, texts: pa.Array) -> Items:
        cut, found = terms(*text.buffers(texts))
        encoded = found.dictionary_encode()
        numbers = encoded.indices.to_numpy(zero_copy_only=False)
        held = [np.unique(numbers[cut.first[i] : cut.first[i + 1]]) for i in range(len(texts))]
        return cls(ids, encoded.dictionary, held)

    def places(self, found: pa.Array) -> np.ndarray:
        """The vocabulary's number of each term, -1 for others."""
        if not len(self.vocabulary):
            return np.full(len(found), -1, dtype=np.int64)
        return pc.fill_null(pc.index_in(found, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Tile:
    """Some items and some of their terms: ``column`` is a term's place (-1: not here), ``weight`` terms x items."""

    items: np.ndarray
    column: np.ndarray
    weight: np.ndarray


def tiles(items: Items, weights: np.ndarray, tile_items: int = TILE_ITEMS, tile_terms: int = TILE_TERMS) -> list[list[Tile]]:
    """For each run of items the column tiles whose products add up to its scores."""
    made = []
    for first in range(0, len(items.held), tile_items):
        members = np.arange(first, min(first + tile_items, len(items.held)))
        used = np.unique(np.concatenate([items.held[i] for i in members]))
        # With the greatest impact below SCALE / UNIT, this many columns of the greatest weight stay exact.
        widest = int(weights[used].max()) if len(used) else 0
        width = max(1, min(tile_terms, (EXACT - 1) // max(1, widest * (SCALE // UNIT))))
        parts = []
        for a in range(0, len(used), width):
            part = used[a : a + width]
            column = np.full(len(weights), -1, dtype=np.int64)
            column[part] = np.arange(len(part))
            matrix = np.zeros((len(part), len(members)))
            for k, i in enumerate(members):
                mine = items.held[i]
                mine = mine[column[mine] >= 0]
                matrix[column[mine], k] = weights[mine]
            parts.append(Tile(members, column, matrix))
        made.append(parts)
    return made


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(SCALE tf) div (UNIT tf + DAMPING m) for documents of n terms; all divisions round down."""
    top = int(n.max()) if len(n) else 0
    exact = object if LENGTH_SHARE * top * documents >= 1 << 62 else np.int64
    m = FIXED_SHARE + (LENGTH_SHARE * n.astype(exact) * documents // total).astype(np.int64)
    return SCALE * tf // (UNIT * tf + DAMPING * m)


class Best:
    """The rows of each item that may still be among its first k."""

    def __init__(self, items: int, k: int, ids: pa.DataType):
        self.k = k
        self.least = np.ones(items, dtype=np.int64)
        self.type = ids
        self.parts: list[pa.Table] = []
        self.rows = 0

    def add(self, members: np.ndarray, ids: pa.Array, scores: np.ndarray) -> None:
        """``scores`` is documents x members."""
        least = self.least[members]
        if len(scores) > self.k:
            # The k-th score of the tile, ties included.
            place = len(scores) - self.k
            least = np.maximum(least, np.partition(scores, place, axis=0)[place])
        row, member = np.nonzero(scores >= least)
        self.parts.append(pa.table({
            "item": pa.array(members[member], pa.int64()),
            "score": pa.array(scores[row, member], pa.int64()),
            "doc_id": ids.take(pa.array(row)),
        }))
        self.rows += len(row)
        if self.rows > KEPT_ROWS:
            self.cut()

    def cut(self) -> pa.Table:
        """Sort by score and then id, keep k rows an item, and raise the bar for later tiles."""
        empty = pa.table({"item": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "doc_id": pa.array([], self.type)})
        table = pa.concat_tables([empty, *self.parts])
        keys = [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
        item = table.column("item").to_numpy()
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        full = rank == self.k - 1
        self.least[item[full]] = table.column("score").to_numpy()[full]
        table = table.filter(pa.array(rank < self.k)).combine_chunks()
        self.parts, self.rows = [table], 0
        return table


def score_tile(parts: list[Tile], docs: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """Scores (documents x items) of one tile of documents, given as (row, term, impact) entries."""
    out = np.zeros((docs, len(parts[0].items)), dtype=np.int64) if parts else np.zeros((docs, 0), dtype=np.int64)
    for part in parts:
        column = part.column[term]
        here = column >= 0
        dense = np.zeros((docs, len(part.weight)))
        dense[row[here], column[here]] = impact[here]
        out += (dense @ part.weight).astype(np.int64)
    return out


def _blocks(rows: DataFrame, block_bytes: int) -> Iterator[pa.Table]:
    """The items in blocks whose texts have about ``block_bytes``; a longer text makes a larger block."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).cast("long")).first()[0]
    count = max(1, -(-size // block_bytes))
    for block in range(count):
        mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block
        yield (rows.where(mine) if count > 1 else rows).toArrow()


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's k documents of highest score above 0.

    Equal scores go by ascending id (null first). Null, empty and termless texts of documents and items
    find nothing. Every row of ``docs`` is a document of its own, also where ids or texts repeat, and so is
    every row of ``items`` an item; long texts are counted whole; other columns are left out. Memory of
    a task: the block's vocabulary, one tile of scores, and KEPT_ROWS rows and those of one tile.
    """
    spark = frames.ready(docs)
    rows = docs.select(frames.col(docs, id_col).alias("doc_id"), frames.col(docs, text_col).cast("string").alias("text"))
    asked = items.select(frames.col(items, item_col).alias("item_id"), frames.col(items, item_text_col).cast("string").alias("text"))
    kinds = T.StructType([
        T.StructField("item", T.LongType()), asked.schema["item_id"], rows.schema["doc_id"], T.StructField("score", T.LongType())
    ])
    found = None
    for number, block in enumerate(_blocks(asked, block_bytes)):
        block = block.combine_chunks()
        made = Items.of(block.column("item_id").combine_chunks(), block.column("text").combine_chunks())
        sent = spark.sparkContext.broadcast(made)
        count = {r["term"]: r["n"] for r in _counts(rows, sent).collect()}
        documents, total = count.get(-1, 0), count.get(-2, 0)
        weights = np.array([weight(documents, count.get(t, 0)) for t in range(len(made.vocabulary))], dtype=np.int64)
        part = _scored(rows, sent, spark.sparkContext.broadcast(weights), documents, total, k, kinds)
        part = part.withColumn("block", F.lit(number))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _counts(rows: DataFrame, sent) -> DataFrame:
    """(term, n): documents that hold each term of the items; -1: documents with a term, -2: all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        holding = np.zeros(len(items.vocabulary), dtype=np.int64)
        documents = total = 0
        for batch in batches:
            for _, _, data, at in text.slices(batch.column(0)):
                cut, found = terms(data, at)
                documents += int((cut.counts > 0).sum())
                total += len(cut.start)
                place = items.places(found)
                here = place >= 0
                once = np.unique(cut.row[here] * len(holding) + place[here]) if here.any() else np.zeros(0, np.int64)
                holding += np.bincount(once % max(1, len(holding)), minlength=len(holding))
        some = np.flatnonzero(holding)
        term = np.concatenate((some, [-1, -2]))
        n = np.concatenate((holding[some], [documents, total]))
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n, pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _scored(rows: DataFrame, sent, weights, documents: int, total: int, k: int, kinds: T.StructType) -> DataFrame:
    """(item, item_id, doc_id, score): the best rows of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        size = max(1, len(items.vocabulary))
        groups = tiles(items, weights.value)
        best = None
        for batch in batches:
            ids = batch.column(0)
            if best is None:
                best = Best(len(items.held), k, ids.type)
            for first, _, data, at in text.slices(batch.column(1)):
                cut, found = terms(data, at)
                place = items.places(found)
                here = place >= 0
                entry, tf = np.unique(cut.row[here] * size + place[here], return_counts=True)
                row, term = entry // size, entry % size
                impact = impacts(tf.astype(np.int64), cut.counts[row], documents, total)
                # Documents that hold a term of the items, dealt into tiles.
                held, slot = np.unique(row, return_inverse=True)
                for a in range(0, len(held), TILE_DOCS):
                    some = held[a : a + TILE_DOCS]
                    mine = slice(*np.searchsorted(slot, (a, a + len(some))))
                    mine_ids = ids.take(pa.array(first + some))
                    for parts in groups:
                        if parts:
                            scores = score_tile(parts, len(some), slot[mine] - a, term[mine], impact[mine])
                            best.add(parts[0].items, mine_ids, scores)
        if best is not None:
            table = best.cut()
            for part in table.to_batches(max_chunksize=65536):
                item = part.column("item")
                columns = [item, items.ids.take(item), part.column("doc_id"), part.column("score")]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])

    if not total:
        return rows.sparkSession.createDataFrame([], kinds)
    return rows.mapInArrow(run, kinds)


def oracle() -> str:
    """The same ranking in DuckDB SQL."""
    cut = (
        "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {cut} AS w FROM documents),
sums AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM docs),
asked AS (SELECT row_number() OVER () AS i, item_id, list_distinct({cut}) AS w FROM benchmark),
pairs AS (SELECT i, item_id, unnest(w) AS t FROM asked),
held AS (
  SELECT r, doc_id, n, t, count(*) AS tf
  FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM pairs) GROUP BY ALL),
weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM held, sums GROUP BY t, docs),
impact AS (
  SELECT r, doc_id, t, ({SCALE} * tf) // ({UNIT} * tf + {DAMPING} * ({FIXED_SHARE} + ({LENGTH_SHARE} * n * docs) // total)) AS v
  FROM held, sums),
scored AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * v) AS BIGINT) AS score
  FROM pairs JOIN weights USING (t) JOIN impact USING (t) GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
