"""URL filter: rules first, then the likelihood ratio of two variable-order Markov models.

One model is counted from the URLs that rules allow, one from those they block. Both predict each
byte of the whole URL from the up to ``ORDER`` bytes before: P_k(c | context) mixes the counts of
the longest context with P_(k-1), weighted by ``PRIOR`` virtual counts, down to a uniform P_0. The
score is the difference of the log-likelihoods divided by the number of bytes. The threshold is
calibrated on rule-decided URLs that were kept out of the counts.

Counts belong to exact n-grams: order, context and byte fit one 64-bit number, so none share a count. Their
number follows the data, and all are kept, whatever it is: they stay a table. URLs are dealt into blocks of
``BLOCK_BYTES``; a block's different n-grams meet their counts in a join and come back to its URLs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.llm import frames, text

ORDER = 5
BLOCK_BYTES = 1 << 20
PRIOR = 4.0
CALIBRATION_FOLDS = 5
BINS = 4096
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null.

    Rules are few and given as arguments, so they become one expression, longest first.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _grams(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each order 0..ORDER the n-gram (order, context, byte) of every byte, nine bits a byte.

    A context starts at the URL's first byte at the latest; it is zero beyond. Clearing the last
    nine bits gives the context.
    """
    n = len(data)
    depth = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    wide = data.astype(np.int64) + 1
    context = np.zeros(n, dtype=np.int64)
    for order in range(ORDER + 1):
        if order:
            # One byte more of the context, where the URL has one there.
            older = np.zeros(n, dtype=np.int64)
            older[order:] = wide[: n - order] if n > order else 0
            older[depth < order] = 0
            context = context | older << (9 * (order - 1))
        yield order << 57 | context << 9 | wide


_BYTE = 511


@dataclass
class Model:
    """Sorted n-grams and contexts with the counts of both models (row 0 blocked, row 1 allowed), and the threshold."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    threshold: float = 0.0

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray) -> Model:
        """A model of these n-grams; a context's total is what its n-grams add up to."""
        order = np.argsort(grams)
        grams, counts = grams[order], counts[:, order].astype(np.float64)
        contexts, first = np.unique(grams & ~_BYTE, return_index=True)
        totals = np.add.reduceat(counts, first, axis=1) if len(first) else counts
        return cls(grams, counts, contexts, totals)

    @staticmethod
    def _count(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros((2, len(wanted)))
        different, place = np.unique(wanted, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, different), len(keys) - 1)
        return np.where(keys[at] == different, counts[:, at], 0.0)[:, place]

    def probabilities(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each byte in each model."""
        p = np.full((2, len(data)), 1 / 256)
        for gram in _grams(data, at):
            seen = self._count(self.grams, self.counts, gram)
            p = (seen + PRIOR * p) / (self._count(self.contexts, self.totals, gram & ~_BYTE) + PRIOR)
        return p

    def scores(self, urls: pa.Array) -> np.ndarray:
        out = np.zeros(len(urls))
        for first, last, data, at in text.slices(urls):
            p = self.probabilities(data, at)
            ratio = np.concatenate(([0.0], np.cumsum(np.log(p[1]) - np.log(p[0]))))
            length = np.diff(at)
            out[first:last] = (ratio[at[1:]] - ratio[at[:-1]]) / np.maximum(length, 1)
        return out


def gram_counts(known: DataFrame) -> DataFrame:
    """The stored counts (gram, blocked, allowed) of rows (url, allowed) outside the calibration fold.

    An n-gram without its byte is its context, with what its n-grams add up to.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            allowed = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last, data, at in text.slices(batch.column(0)):
                side = np.repeat(allowed[first:last], np.diff(at))
                gram, place = np.unique(np.concatenate(list(_grams(data, at))), return_inverse=True)
                sides = np.tile(side, ORDER + 1)
                both = [np.bincount(place[sides == k], minlength=len(gram)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(gram), *map(pa.array, both)], ["gram", "blocked", "allowed"])

    frames.ready(known)
    counted = known.where(~_held()).select("url", "allowed").mapInArrow(count, "gram long, blocked long, allowed long")
    sums = [F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed")]
    grams = counted.groupBy("gram").agg(*sums)
    contexts = grams.groupBy(F.col("gram").bitwiseAND(~_BYTE).alias("gram")).agg(*sums)
    return frames.store(grams.unionByName(contexts), "grams")


def _held() -> Column:
    """The calibration fold, by a hash of the URL: copies of a URL are on one side."""
    return F.pmod(F.xxhash64("url"), F.lit(CALIBRATION_FOLDS)) == 0


def train(known: DataFrame, most_grams: int | None = None) -> Model:
    """A model in one piece from rows (url, allowed): for tables whose n-grams fit the driver.

    Counts cover all but one fold, the threshold is set on that one. ``most_grams`` leaves the rarest
    n-grams to shorter contexts; without it all are kept.
    """
    sums = gram_counts(known).where(F.col("gram").bitwiseAND(_BYTE) != 0)
    least = 1 if most_grams is None else _least(sums, most_grams)
    kept = sums.where(F.col("blocked") + F.col("allowed") >= least).toArrow()
    model = Model.of(kept["gram"].to_numpy(), np.stack([kept[c].to_numpy() for c in ("blocked", "allowed")]))
    model.threshold = threshold(with_score(known.where(_held()), model, "url", "score"))
    return model


def threshold(scored: DataFrame) -> float:
    """From rows (allowed, score) of the calibration fold.

    It is the middle of the score range with the best mean of both classes' accuracy, on a histogram of
    ``BINS`` bins. With one class alone, or none, it is zero.
    """
    ends = scored.agg(F.min("score").alias("a"), F.max("score").alias("b")).first()
    if ends["a"] is None or ends["a"] == ends["b"]:
        return 0.0
    width = (ends["b"] - ends["a"]) / BINS
    bins = np.zeros((2, BINS))
    for r in (
        scored.groupBy(
            F.least(F.floor((F.col("score") - ends["a"]) / width), F.lit(BINS - 1)).alias("bin"),
            F.col("allowed").cast("int").alias("side"),
        )
        .count()
        .collect()
    ):
        bins[r["side"], r["bin"]] = r["count"]
    whole = bins.sum(axis=1)
    if not whole.all():
        return 0.0
    # A threshold at the lower end of bin k blocks all bins below k.
    right = np.concatenate(([0], np.cumsum(bins[0]))) / whole[0] + 1 - np.concatenate(([0], np.cumsum(bins[1]))) / whole[1]
    best = np.flatnonzero(right == right.max())
    return float(ends["a"] + width * (best[0] + best[-1]) / 2)


def url_scores(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The stored rows (url, score): every different URL of ``rows`` once, scored by all counts."""
    frames.ready(rows)
    different = rows.select("url").distinct()
    size = different.agg(F.coalesce(F.sum(F.octet_length("url")), F.lit(0)).alias("n")).first()["n"]
    block = F.pmod(F.xxhash64("url"), F.lit(size // BLOCK_BYTES + 1)).alias("block")
    blocks = frames.store(different.select("url", block), "urls")

    def wanted(given: pa.Table) -> pa.Table:
        """The block's different n-grams and contexts."""
        found = []
        for chunk in given["url"].chunks:
            for _, _, data, at in text.slices(chunk):
                gram = np.unique(np.concatenate(list(_grams(data, at))))
                found += [gram, np.unique(gram & ~_BYTE)]
        grams = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return pa.table({"block": np.full(len(grams), given["block"][0].as_py()), "gram": grams})

    def score(given: pa.Table, met: pa.Table) -> pa.Table:
        met = met.sort_by("gram")
        grams = met["gram"].to_numpy()
        both = np.stack([met[c].to_numpy().astype(np.float64) for c in ("blocked", "allowed")])
        whole = grams & _BYTE == 0
        model = Model(grams[~whole], both[:, ~whole], grams[whole], both[:, whole])
        scores = [model.scores(chunk) for chunk in given["url"].chunks]
        return pa.table({"url": given["url"], "score": np.concatenate(scores)})

    grams = blocks.groupBy("block").applyInArrow(wanted, "block long, gram long")
    met = grams.join(counts, "gram").select("block", "gram", "blocked", "allowed")
    scored = blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(score, "url string, score double")
    return frames.store(scored, "url-scores")


def _least(sums: DataFrame, most: int) -> int:
    """The count that an n-gram must have for at most ``most`` of them to be kept; 1 where all are."""
    total = F.least(F.col("blocked") + F.col("allowed"), F.lit(1 << 20))
    # Counts are few: each is one row, however many n-grams have it.
    sizes = sums.groupBy(F.pow(F.lit(2), F.floor(F.log2(total))).cast("long").alias("floor")).count().collect()
    left, least = sum(r["count"] for r in sizes), 1
    for r in sorted(sizes, key=lambda r: r["floor"]):
        if left <= most:
            break
        left -= r["count"]
        least = 2 * r["floor"]
    return least


def with_score(rows: DataFrame, model: Model, url_col: str, name: str) -> DataFrame:
    sent = frames.ready(rows).sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(sent.value.scores(batch))

    return rows.withColumn(name, score(frames.col(rows, url_col)))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict and the method's score.

    A rule ``domain/prefix`` fits its domain, all subdomains, and paths that start with ``/prefix``;
    the longest fitting rule decides. Other URLs are allowed if their score reaches the threshold.
    The models read whole URLs, scheme, query and fragment included. A null URL, or one without ``://``,
    has an empty host and path and is judged by its score alone, which is zero for null and empty ones.
    Equal URLs have equal verdicts, long ones are read whole, repeated rows stay; other columns are left out.
    """
    given = frames.col(pages, url_col)
    rows = pages.select(
        frames.col(pages, id_col).alias("page_id"), F.coalesce(given, F.lit("")).alias("url"),
        host_of(given).alias("host"), path_of(given).alias("path"),
    )
    rows = rows.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    allowed = (F.col("r.verdict") == ALLOW).alias("allowed")
    counts = gram_counts(rows.where("r is not null").select("url", allowed))
    judged = rows.join(url_scores(rows, counts), "url")
    least = threshold(judged.where(F.col("r").isNotNull() & _held()).select(allowed, "score"))
    by_score = F.when(F.col("score") >= least, ALLOW).otherwise(BLOCK)
    return judged.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), by_score).alias("verdict"), "score",
    )
