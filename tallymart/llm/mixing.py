"""Mixing sources: temperature weights, then budgeted permutations of blocks.

A source with token share p gets a weight proportional to p ** x. The exponent x lies in 0..1 and is
bisected: the largest x whose weights reach the target entropy, raised as far as the repetition
limit demands. A source's budget is its weight times the whole budget; it is spent in epochs. Each
epoch is a permutation of the source's blocks, and of the documents in each block; the last one
stops before the document that would exceed the budget.

Blocks hold about ``block_docs`` documents whatever the size of the source, so ordering and running
sums happen in small groups. Offsets of blocks are summed in two levels, runs of blocks first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymart.functions.sizes import broadcast_if_small
from tallymart.llm import frames

ENTROPY_SHARE = 0.95
MAX_EPOCHS = 4.0
BLOCK_DOCS = 512
BLOCK_RUN = 1024
SEED = 17
BISECTIONS = 40

WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """The exponent, the whole budget in tokens and (source, tokens, weight, budget) rows."""

    exponent: float
    budget: float
    sources: list[tuple[str | None, int, float, int]]


def weights(tokens: list[int], exponent: float) -> list[float]:
    """Normalised weights of sources with these positive token counts."""
    total = sum(tokens)
    powers = [(t / total) ** exponent for t in tokens]
    whole = math.fsum(powers)
    return [p / whole for p in powers]


def entropy(shares: list[float]) -> float:
    return -math.fsum(s * math.log(s) for s in shares if s > 0)


def exponent(
    tokens: list[int], entropy_share: float, max_epochs: float, budget: float | None
) -> float:
    """The bisected exponent; both conditions are monotone in it."""
    if len(tokens) < 2:
        return 1.0
    target = entropy_share * math.log(len(tokens))

    def enough(x: float) -> bool:
        return entropy(weights(tokens, x)) >= target

    def fits(x: float) -> bool:
        w = weights(tokens, x)
        spent = whole_budget(tokens, w) if budget is None else budget
        return max(a * spent / t for a, t in zip(w, tokens, strict=True)) <= max_epochs

    found = _bisect(enough, 1.0, 0.0)
    return found if fits(found) else _bisect(fits, found, 1.0)


def _bisect(good, bad_end: float, good_end: float) -> float:
    """The point nearest to ``bad_end`` that is good, where ``good_end`` counts as good."""
    if good(bad_end):
        return bad_end
    for _ in range(BISECTIONS):
        middle = (bad_end + good_end) / 2
        if good(middle):
            good_end = middle
        else:
            bad_end = middle
    return good_end


def whole_budget(tokens: list[int], shares: list[float]) -> float:
    """The smallest budget that spends every token of every source at least once."""
    return max(t / w for t, w in zip(tokens, shares, strict=True))


def plan_mix(
    totals: DataFrame,
    entropy_share: float = ENTROPY_SHARE,
    max_epochs: float = MAX_EPOCHS,
    budget: float | None = None,
) -> Mix:
    """Weights of the sources in ``totals`` (source, tokens); one row a source reaches the driver."""
    rows = sorted(
        ((r["source"], int(r["tokens"])) for r in totals.where("tokens > 0").toLocalIterator()),
        key=lambda r: (r[0] is not None, r[0]),
    )
    tokens = [t for _, t in rows]
    if not tokens:
        return Mix(1.0, 0.0, [])
    x = exponent(tokens, entropy_share, max_epochs, budget)
    shares = weights(tokens, x)
    spent = whole_budget(tokens, shares) if budget is None else float(budget)
    return Mix(
        x,
        spent,
        [(s, t, w, math.floor(w * spent + 0.5)) for (s, t), w in zip(rows, shares, strict=True)],
    )


def tokens_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(*parts: object) -> Column:
    """48 bits of an MD5 of the parts: the same number in any engine."""
    cells = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def schedule(units: DataFrame, mix_of: Mix, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """The epochs of ``units`` (source, doc_id, n_tokens, copies): rows also have epoch, block,
    block_place (the block's rank in its epoch, by its hash) and tokens_before.
    """
    spark = units.sparkSession
    known = spark.createDataFrame(
        [(s, t, b) for s, t, _, b in mix_of.sources], "mix_source string, source_tokens long, source_budget long"
    )
    # A source without a word has no weight and costs nothing: it gets one epoch, for which any budget will do.
    sizes = units.groupBy("source").agg(F.count("*").alias("units"))
    known = sizes.join(known, F.col("source").eqNullSafe(F.col("mix_source")), "left").select(
        F.col("source").alias("mix_source"),
        F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
        F.coalesce("source_budget", F.lit(1)).alias("source_budget"),
        F.ceil(F.col("units") / block_docs).alias("blocks"),
    )
    rows = units.join(broadcast_if_small(known), F.col("source").eqNullSafe(F.col("mix_source")))
    rows = rows.withColumn("block", F.pmod(_place(seed, "block", F.col("doc_id"), F.col("n_tokens")), F.col("blocks")))
    rows = rows.withColumn("weight", F.col("n_tokens") * F.col("copies"))

    # Whole epochs take every block; of the last one, blocks that end within the budget are whole.
    blocks = rows.groupBy("source", "block", "source_tokens", "source_budget").agg(F.sum("weight").alias("size"))
    tokens = F.nullif("source_tokens", F.lit(0))
    whole = F.floor(F.col("source_budget") / tokens)
    epochs = whole + F.when(F.col("source_budget") % tokens > 0, 1).otherwise(0)
    blocks = blocks.withColumn("last", F.coalesce(epochs, F.lit(1)))
    turns = blocks.where("last > 0").select(
        "source", "block", "size", "source_tokens", "source_budget", F.explode(F.sequence(F.lit(1), F.col("last").cast("int"))).alias("epoch")
    )
    turns = turns.withColumn("order", _place(seed, "epoch", F.col("epoch"), F.col("source"), F.col("block")))
    turns = turns.withColumn("rest", F.col("source_budget") - (F.col("epoch") - 1) * F.col("source_tokens"))
    turns = _running(turns)
    turns = turns.where("before < rest").select(
        F.col("source").alias("turn_source"), F.col("block").alias("turn_block"), "epoch", "block_place", "before", "rest"
    )
    met = rows.join(
        turns,
        F.col("source").eqNullSafe(F.col("turn_source")) & (F.col("block") == F.col("turn_block")),
    )
    inside = (
        W.partitionBy("source", "block", "epoch")
        .orderBy(_place(seed, "row", F.col("epoch"), F.col("doc_id"), F.col("n_tokens")), "doc_id", "n_tokens")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    met = met.withColumn("upto", F.col("before") + F.sum("weight").over(inside))
    return met.where("upto <= rest").select(
        "source", "doc_id", "n_tokens", "copies", "epoch", "block", "block_place",
        (F.col("upto") - F.col("weight")).alias("tokens_before"),
    )


def _running(turns: DataFrame, run: int = BLOCK_RUN) -> DataFrame:
    """Tokens and blocks before each block of an epoch, in the order of ``order``.

    Runs are ranges of the 48-bit hash, about ``run`` blocks each; sums within runs come first.
    """
    per = turns.groupBy("source", "epoch").agg(F.count("*").alias("n")).select(
        F.col("source").alias("s"), F.col("epoch").alias("e"), F.ceil(F.col("n") / run).alias("runs")
    )
    turns = turns.join(per, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")))
    turns = turns.withColumn("run", F.floor(F.col("order") / F.ceil(F.lit(1 << 48) / F.col("runs")))).drop("s", "e")
    heads = turns.groupBy("source", "epoch", "run").agg(F.sum("size").alias("t"), F.count("*").alias("c"))
    earlier = W.partitionBy("source", "epoch").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(
        F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("run").alias("r"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"),
        F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"),
    )
    turns = turns.join(
        heads,
        F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("run") == F.col("r")),
    )
    within = W.partitionBy("source", "epoch", "run").orderBy("order", "block")
    so_far = within.rowsBetween(W.unboundedPreceding, -1)
    return turns.withColumn("before", F.col("t0") + F.coalesce(F.sum("size").over(so_far), F.lit(0))).withColumn(
        "block_place", (F.col("c0") + F.row_number().over(within)).cast("long")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    entropy_share: float = ENTROPY_SHARE,
    max_epochs: float = MAX_EPOCHS,
    budget: float | None = None,
    block_docs: int = BLOCK_DOCS,
    seed: int = SEED,
) -> DataFrame:
    """The mix as rows ``(doc_id, source, n_tokens, epoch, block, block_place, tokens_before)``.

    One row for each epoch a document is in; without a budget every document is in the
    first. Rows with equal (source, id, token count) stand or fall together and give one row each.
    A null source is a source of its own; null ids are allowed. Texts without words carry no
    weight: they are returned for each epoch of their block like any other, and a source of such
    texts alone is returned once, whatever the budget. An empty table gives no rows.
    """
    rows = docs.select(
        frames.col(docs, source_col).cast("string").alias("source"),
        frames.col(docs, id_col).alias("doc_id"),
        tokens_of(frames.col(docs, text_col)).alias("n_tokens"),
    )
    units = frames.store(rows.groupBy("source", "doc_id", "n_tokens").agg(F.count("*").alias("copies")), "units")
    totals = units.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    made = plan_mix(totals, entropy_share, max_epochs, budget)
    found = schedule(units, made, block_docs, seed)
    return found.select(
        "source", "doc_id", "n_tokens", "epoch", "block", "block_place", "tokens_before",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """All columns of ``docs``, once for each epoch, and the mix columns ``epoch``, ``block``,
    ``block_place`` and ``tokens_before`` (with underscores in front where ``docs`` has the name).
    """
    taken = list(docs.columns)
    names = {}
    for name in ("epoch", "block", "block_place", "tokens_before"):
        names[name] = frames.fresh(taken, name)
        taken.append(names[name])
    turns = mix(docs, id_col, text_col, source_col, **settings).select(
        F.col("source").alias("mix_s"), F.col("doc_id").alias("mix_d"), F.col("n_tokens").alias("mix_n"),
        F.struct(*[F.col(c).alias(n) for c, n in names.items()]).alias("turn"),
    )
    turns = turns.distinct()
    turn = frames.fresh(docs.columns, "turn")
    key = [frames.fresh(docs.columns, f"mix_{c}") for c in "sdn"]
    turns = turns.select(*[F.col(f"mix_{c}").alias(k) for c, k in zip("sdn", key, strict=True)], F.col("turn").alias(turn))
    joined = docs.join(
        turns,
        frames.col(docs, source_col).cast("string").eqNullSafe(F.col(key[0]))
        & frames.col(docs, id_col).eqNullSafe(F.col(key[1]))
        & (tokens_of(frames.col(docs, text_col)) == F.col(key[2])),
    )
    return joined.select(*[frames.col(docs, c) for c in docs.columns], *[F.col(f"`{turn}`.`{n}`") for n in names.values()])


def oracle() -> str:
    """``mix`` with its defaults in DuckDB SQL: one window for each running sum, no levels."""
    place = "CAST('0x' || substr(md5(concat_ws('|', {})), 1, 12) AS BIGINT)"
    row = place.format(f"'{SEED}', 'block', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(n_tokens AS VARCHAR)")
    turn = place.format(f"'{SEED}', 'epoch', CAST(epoch AS VARCHAR), coalesce(source, ''), CAST(block AS VARCHAR)")
    inside = place.format(f"'{SEED}', 'row', CAST(epoch AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''), CAST(n_tokens AS VARCHAR)")
    return f"""
WITH RECURSIVE
units AS (
  SELECT source, doc_id, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n_tokens, count(*) AS copies
  FROM documents GROUP BY ALL),
totals AS (SELECT source, CAST(sum(n_tokens * copies) AS BIGINT) AS t FROM units GROUP BY 1 HAVING sum(n_tokens * copies) > 0),
lists AS (SELECT list(CAST(t AS DOUBLE)) AS ts, CAST(sum(t) AS DOUBLE) AS whole, count(*) AS k FROM totals),
spread(i, bad, good, done) AS (
  SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE, false
  UNION ALL
  SELECT i + 1, CASE WHEN enough THEN bad ELSE x END, CASE WHEN enough THEN x ELSE good END, i = 0 AND enough
  FROM (
    SELECT *, -list_sum(list_transform(p, lambda v: v / list_sum(p) * ln(v / list_sum(p)))) >= {ENTROPY_SHARE} * ln(k) AS enough
    FROM (SELECT *, list_transform(ts, lambda v: pow(v / whole, x)) AS p
          FROM (SELECT *, CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE (bad + good) / 2 END AS x FROM spread, lists)))
  WHERE i <= {BISECTIONS} AND NOT done),
found AS (SELECT CASE WHEN k < 2 THEN 1.0::DOUBLE ELSE good END AS x FROM spread, lists ORDER BY i DESC LIMIT 1),
fit(i, bad, good, done) AS (
  SELECT 0, x, 1.0::DOUBLE, false FROM found
  UNION ALL
  SELECT i + 1, CASE WHEN fits THEN bad ELSE x END, CASE WHEN fits THEN x ELSE good END, i = 0 AND fits
  FROM (
    SELECT *, list_max(list_transform(w, lambda v, j: v * list_max(list_transform(w, lambda u, m: ts[m] / u)) / ts[j])) <= {MAX_EPOCHS} AS fits
    FROM (SELECT *, list_transform(p, lambda v: v / list_sum(p)) AS w
          FROM (SELECT *, list_transform(ts, lambda v: pow(v / whole, x)) AS p
                FROM (SELECT *, CASE WHEN i = 0 THEN bad ELSE (bad + good) / 2 END AS x FROM fit, lists))))
  WHERE i <= {BISECTIONS} AND NOT done),
exponent AS (SELECT good AS x FROM fit ORDER BY i DESC LIMIT 1),
weighted AS (
  SELECT source, t, pow(t / whole, x) / sum(pow(t / whole, x)) OVER () AS w FROM totals, lists, exponent),
budgets AS (
  SELECT source, t, CAST(floor(w * max(t / w) OVER () + 0.5) AS BIGINT) AS budget FROM weighted
  UNION ALL SELECT source, 0, 1 FROM units GROUP BY 1 HAVING sum(n_tokens * copies) = 0),
sizes AS (SELECT source, CAST(ceil(count(*) / {BLOCK_DOCS}) AS BIGINT) AS blocks FROM units GROUP BY 1),
rows_ AS (
  SELECT u.*, n_tokens * copies AS weight, t, budget, {row} % blocks AS block
  FROM units u JOIN budgets b ON u.source IS NOT DISTINCT FROM b.source JOIN sizes s ON u.source IS NOT DISTINCT FROM s.source),
turns AS (
  SELECT *, budget - (epoch - 1) * t AS rest, {turn} AS place
  FROM (SELECT *, unnest(range(1, CASE WHEN t = 0 THEN 1 ELSE budget // t + CASE WHEN budget % t > 0 THEN 1 ELSE 0 END END + 1)) AS epoch
        FROM (SELECT source, block, t, budget, sum(weight) AS size FROM rows_ GROUP BY ALL))),
ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, epoch ORDER BY place, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    row_number() OVER (PARTITION BY source, epoch ORDER BY place, block) AS block_place
  FROM turns),
met AS (
  SELECT r.source, r.doc_id, r.n_tokens, r.copies, r.weight, o.epoch, r.block, o.block_place, o.rest, o.before
  FROM rows_ r JOIN ordered o ON r.source IS NOT DISTINCT FROM o.source AND r.block = o.block WHERE o.before < o.rest),
summed AS (
  SELECT *, before + sum(weight) OVER (
    PARTITION BY source, block, epoch ORDER BY {inside}, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM met)
SELECT source, doc_id, n_tokens, CAST(epoch AS INTEGER) AS epoch, block, block_place, CAST(upto - weight AS BIGINT) AS tokens_before
FROM (SELECT *, unnest(range(copies)) FROM summed WHERE upto <= rest)
"""
