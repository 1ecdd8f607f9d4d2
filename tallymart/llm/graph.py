"""Approximate nearest neighbours by inner product: robust-pruned directed graphs over shards.

Equal vectors are one node that names its ``k + 1`` smallest ids, which is all a list of k can show. Nodes
are dealt to shards of about ``shard_rows`` by hash. In each shard a graph is built: from a random
start, greedy beam searches propose neighbours for batch after batch of nodes, relaxed distance
pruning keeps the diverse ones, and reverse edges are added and pruned likewise. A beam search from
the shard's centre answers a query; the lists of all shards are merged by exact score.

Inner product becomes a distance by one more coordinate, sqrt(M ** 2 - |x| ** 2), where M is the
largest norm: then the nearest vector of a query has the largest product. Where norms differ, small
vectors would all crowd at the pole, so a shard is layered by norm, each layer within the factor ``RATIO``
and with a graph of its own; a query visits layers from the largest norm down and skips those whose
norm times its own cannot reach its list. Scores are computed from the original components in double precision.

How wide a beam must be depends on the data. Each layer tries the shard's own vectors as queries and doubles
its beam until the share ``RECALL`` of their true neighbours is found; the width is stored with the graph.

A search costs about the logarithm of the shard's size, and each query visits each shard, so choose
``shard_rows`` as large as the memory of a task allows: a row takes about 12 bytes a component and 4 an
edge. Graphs are stored; queries come in blocks of ``BLOCK_BYTES``, each of which meets each shard in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymart.llm import frames

K = 20
SHARD_ROWS = 4096
BLOCK_BYTES = 32 << 20
DEGREE = 24
BEAM = 48
SEARCH_BEAM = 64
RELAX = 1.2
BATCH = 256
EXPAND = 3
RATIO = 1.25
LEAST_LAYER = 64
RECALL = 0.95
TRIED = 64


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _sorted(ids: np.ndarray, far: np.ndarray, open_: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The ``width`` nearest of each row."""
    order = np.argsort(far, axis=1, kind="stable")[:, :width]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (ids, far, open_))


def beam_search(
    points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the ``width`` nearest nodes found for each query.

    Each round opens the nearest unopened nodes of every beam; missing entries have distance inf.
    """
    n, rows = len(points), np.arange(len(queries))
    ids = np.zeros((len(queries), width), dtype=np.int64)
    far = np.full((len(queries), width), np.inf)
    open_ = np.zeros((len(queries), width), dtype=bool)
    seen = np.zeros((len(queries), n), dtype=bool)
    ids[:, 0], open_[:, 0], seen[:, entry] = entry, True, True
    far[:, 0] = ((queries - points[entry]) ** 2).sum(axis=1)
    active = rows
    while len(active):
        f = np.where(open_[active], far[active], np.inf)
        pick = np.argsort(f, axis=1, kind="stable")[:, :EXPAND]
        live = np.isfinite(np.take_along_axis(f, pick, axis=1))
        keep = live[:, 0]
        active, pick, live = active[keep], pick[keep], live[keep]
        if not len(active):
            break
        chosen = ids[active[:, None], pick]
        mark = open_[active]
        np.put_along_axis(mark, pick, False, axis=1)
        open_[active] = mark
        near = np.where(live[:, :, None], edges[chosen], -1).reshape(len(active), -1)
        near.sort(axis=1)
        fresh = (near >= 0) & ~seen[active[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        at_row, at_col = np.nonzero(fresh)
        got = near[at_row, at_col]
        seen[active[at_row], got] = True
        distance = np.full(near.shape, np.inf)
        distance[at_row, at_col] = ((queries[active[at_row]] - points[got]) ** 2).sum(axis=1)
        merged = _sorted(
            np.concatenate((ids[active], np.maximum(near, 0)), axis=1),
            np.concatenate((far[active], distance), axis=1),
            np.concatenate((open_[active], fresh), axis=1),
            width,
        )
        ids[active], far[active], open_[active] = merged
    return ids, far


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Out-neighbours of the nodes ``own`` from rows of candidates (-1 is none).

    Takes the nearest candidate and drops those that are nearer to it, by the factor ``relax``, than
    to the node; and so on until ``degree`` are taken.
    """
    candidates = np.sort(candidates, axis=1)
    valid = (candidates >= 0) & (candidates != own[:, None])
    valid[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    vectors = points[np.maximum(candidates, 0)]
    square = (vectors**2).sum(axis=2)
    base = points[own]
    far = square + (base**2).sum(axis=1)[:, None] - 2 * np.einsum("bcd,bd->bc", vectors, base)
    far[~valid] = np.inf
    cross = square[:, :, None] + square[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
    out = np.full((len(own), degree), -1, dtype=np.int64)
    rows = np.arange(len(own))
    alive = far.copy()
    for k in range(degree):
        best = alive.argmin(axis=1)
        some = np.isfinite(alive[rows, best])
        if not some.any():
            break
        out[some, k] = candidates[rows[some], best[some]]
        alive[relax**2 * cross[rows, best] <= far] = np.inf
        alive[rows, best] = np.inf
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 5) -> tuple[np.ndarray, int]:
    """Edges (n x degree, -1 is none) and the entry node of one shard."""
    n = len(points)
    draw = np.random.default_rng(seed)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    if n <= degree + 1:
        others = np.arange(n - 1)
        edges = np.full((n, degree), -1, dtype=np.int64)
        edges[:, : n - 1] = others + (others >= np.arange(n)[:, None])
        return edges, entry
    edges = draw.integers(n, size=(n, degree))
    for factor in (1.0, relax):
        order = draw.permutation(n)
        for at in range(0, n, BATCH):
            own = order[at : at + BATCH]
            found, far = beam_search(points, edges, entry, points[own], beam)
            proposed = np.concatenate((np.where(np.isfinite(far), found, -1), edges[own]), axis=1)
            edges[own] = robust_prune(points, own, proposed, degree, factor)
            _link_back(points, edges, own, degree, factor)
    return edges, entry


def layers(norms: np.ndarray, ratio: float = RATIO, least: int = LEAST_LAYER) -> list[np.ndarray]:
    """Node numbers by layer, from the largest norm down: norms within ``ratio``, or the next ``least`` nodes."""
    order = np.argsort(-norms, kind="stable")
    falling, found, at = norms[order], [], 0
    while at < len(order):
        end = int(np.searchsorted(-falling, -falling[at] / ratio, side="right"))
        end = max(end, at + least)
        if len(order) - end < least:
            end = len(order)
        found.append(order[at:end])
        at = end
    return found


def wide_enough(
    vectors: np.ndarray, points: np.ndarray, edges: np.ndarray, entry: int, tried: np.ndarray, k: int, beam: int, recall: float = RECALL
) -> int:
    """The beam, doubled as needed, that finds the share ``recall`` of the true ``k`` neighbours of ``tried``."""
    n = len(points)
    if beam >= n:
        return beam
    exact = tried @ vectors.T
    bar = np.partition(exact, n - k, axis=1)[:, n - k] if n > k else exact.min(axis=1)
    lifted = np.concatenate((tried, np.zeros((len(tried), 1))), axis=1)
    while beam < n:
        found, far = beam_search(points, edges, entry, lifted, beam)
        product = np.where(np.isfinite(far), np.take_along_axis(exact, found, axis=1), -np.inf)
        # Scores decide, so of equal vectors any will do.
        hit = np.minimum((product >= bar[:, None]).sum(axis=1), k)
        if hit.mean() >= recall * min(k, n):
            break
        beam *= 2
    return beam


def _link_back(points: np.ndarray, edges: np.ndarray, own: np.ndarray, degree: int, relax: float) -> None:
    """Add the reverse of the edges of ``own``; full nodes are pruned again."""
    source = np.repeat(own, degree)
    target = edges[own].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    width = int(count.max()) if len(nodes) else 0
    extra = np.full((len(nodes), width), -1, dtype=np.int64)
    row = np.repeat(np.arange(len(nodes)), count)
    extra[row, np.arange(len(target)) - first[row]] = source
    for at in range(0, len(nodes), BATCH):
        some = nodes[at : at + BATCH]
        widest = int(count[at : at + BATCH].max())
        edges[some] = robust_prune(
            points, some, np.concatenate((edges[some], extra[at : at + BATCH, :widest]), axis=1), degree, relax
        )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, largest**2 - (vectors**2).sum(axis=1)))
    return np.concatenate((vectors, rest[:, None]), axis=1)


def index(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE,
    beam: int = BEAM,
    relax: float = RELAX,
) -> DataFrame:
    """The stored graph: rows (shard, layer, place, entry, beam, ids, vector, edges, largest), one a distinct vector.

    Every usable vector with an id is in it. All vectors must have one length; others raise.
    """
    spark = frames.ready(vectors)
    rows = vectors.select(
        frames.col(vectors, id_col).cast("long").alias("id"),
        frames.col(vectors, vector_col).cast("array<double>").alias("vector"),
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    # Spark keeps the first k + 1 of each vector on the map side, so a third of all rows may be equal.
    ranked = rows.distinct().withColumn("n", F.row_number().over(W.partitionBy("vector").orderBy("id")))
    nodes = ranked.where(F.col("n") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = frames.store(nodes, "nodes")
    facts = nodes.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).first()
    if facts["a"] != facts["b"]:
        raise ValueError(f"vectors of {facts['a']} to {facts['b']} components")
    shards = max(1, -(-facts["n"] // shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))

    def make(table: pa.Table) -> pa.Table:
        vectors = _matrix(table["vector"])
        n = len(vectors)
        norms = np.sqrt((vectors**2).sum(axis=1))
        tried = vectors[np.random.default_rng(7).permutation(n)[:TRIED]]
        own = {c: np.zeros(n, dtype=np.int32) for c in ("layer", "place", "entry", "beam")}
        largest, links = np.zeros(n), np.full((n, degree), -1, dtype=np.int32)
        for number, members in enumerate(layers(norms)):
            top = float(norms[members[0]])
            points = _lifted(vectors[members], top)
            edges, entry = build(points, degree, beam, relax)
            width = wide_enough(vectors[members], points, edges, entry, tried, k + 1, max(SEARCH_BEAM, k + 1))
            links[members], largest[members] = edges, top
            for column, value in (("layer", number), ("place", np.arange(len(members))), ("entry", entry), ("beam", width)):
                own[column][members] = value
        return pa.table({
            "shard": table["shard"], **{c: pa.array(v) for c, v in own.items()}, "ids": table["ids"], "vector": table["vector"],
            "edges": pa.FixedSizeListArray.from_arrays(pa.array(links.ravel()), degree).cast(pa.list_(pa.int32())),
            "largest": pa.array(largest),
        })

    schema = "shard int, layer int, place int, entry int, beam int, ids array<bigint>, vector array<double>, edges array<int>, largest double"
    dealt = dealt.select("shard", "ids", "vector")
    return frames.store(dealt.groupBy("shard").applyInArrow(make, schema), "graph")


def search(
    graph: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found, without the query's own id.

    Ties go to the smaller id. Queries with a null id or an unusable vector give no rows; repeated
    query ids give one list. Where fewer candidates exist, all that a beam reaches are returned.
    """
    frames.ready(queries)
    asked = queries.select(
        frames.col(queries, id_col).cast("long").alias("id"),
        frames.col(queries, vector_col).cast("array<double>").alias("vector"),
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector"))
    size = asked.agg(F.coalesce(F.sum(F.size("vector") * 8), F.lit(0)).alias("size")).first()["size"]
    blocks = max(1, -(-size // block_bytes))
    shards = graph.agg(F.max("shard")).first()[0]
    if shards is None:
        shards = 0
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = asked.select("id", "vector", "block", F.explode(F.sequence(F.lit(0), F.lit(shards))).alias("shard"))
    spread = graph.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def answer(key, nodes: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(nodes) or not len(wanted):
            return _ANSWER.empty_table()
        vectors, edges = _matrix(nodes["vector"]), _matrix(nodes["edges"]).astype(np.int64)
        ids = nodes["ids"].to_pylist()
        layer, place = nodes["layer"].to_numpy(), nodes["place"].to_numpy()
        parts = []
        for number in range(int(layer.max()) + 1):
            members = np.flatnonzero(layer == number)
            members = members[np.argsort(place[members])]
            facts = {c: nodes[c][int(members[0])].as_py() for c in ("entry", "beam", "largest")}
            parts.append((members, _lifted(vectors[members], facts["largest"]), edges[members], facts))
        asked_ids, asked_vectors = wanted["id"].to_numpy(), _matrix(wanted["vector"])
        norms = np.sqrt((asked_vectors**2).sum(axis=1))
        out: tuple[list, list, list] = ([], [], [])  # a query's list is one row
        for at in range(0, len(wanted), BATCH):
            some = np.arange(at, min(at + BATCH, len(wanted)))
            best: list[list] = [[] for _ in some]
            bar = np.full(len(some), -np.inf)
            for members, points, links, facts in parts:
                # No product in this layer is larger than the norms'.
                go = np.flatnonzero(norms[some] * facts["largest"] * (1 + 1e-9) >= bar)
                if not len(go):
                    break
                asked_here = asked_vectors[some[go]]
                lifted = np.concatenate((asked_here, np.zeros((len(go), 1))), axis=1)
                found, far = beam_search(points, links, facts["entry"], lifted, max(facts["beam"], k + 1))
                nodes_found = members[found]
                product = np.full(far.shape, -np.inf)
                reached = np.isfinite(far)
                row = np.nonzero(reached)[0]
                product[reached] = np.einsum("nd,nd->n", vectors[nodes_found[reached]], asked_here[row])
                for i, near, scores in zip(go.tolist(), nodes_found, product, strict=True):
                    own = asked_ids[some[i]]
                    first = np.argsort(-scores, kind="stable")[: k + 1]
                    # Equal scores at the cut stay, so that the smaller ids among them can win.
                    kept = np.flatnonzero((scores >= scores[first[-1]]) & (scores > -np.inf))
                    more = [(-score, j) for node, score in zip(near[kept].tolist(), scores[kept].tolist(), strict=True) for j in ids[node] if j != own]
                    best[i] = sorted(best[i] + more)[:k]
                    if len(best[i]) == k:
                        bar[i] = -best[i][-1][0]
            for i, mine in zip(some.tolist(), best, strict=True):
                out[0].append(asked_ids[i])
                out[1].append([j for _, j in mine])
                out[2].append([-score for score, _ in mine])
        return pa.table([pa.array(c, t) for c, t in zip(out, _ANSWER.types, strict=True)], schema=_ANSWER)

    lists = (
        spread.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInArrow(answer, "query_id long, vec_ids array<bigint>, scores array<double>")
    )
    each = lists.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("f")).select(
        "query_id", F.col("f.vec_ids").alias("vec_id"), F.col("f.scores").alias("score")
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")



_ANSWER = pa.schema([("query_id", pa.int64()), ("vec_ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def nearest(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, **settings
) -> DataFrame:
    """Index all of ``vectors`` and search it; see ``index`` and ``search``.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, as
    candidates or queries. Empty tables give no rows; other columns are left out.
    """
    return search(index(vectors, id_col, vector_col, k, **settings), queries, id_col, vector_col, k)
