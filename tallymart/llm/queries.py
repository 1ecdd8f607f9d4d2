"""The registered queries of this subpackage: each reads whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm import decontaminate, graph, licenses, maxent, mixing, personal, quality, ranked, repeats, simhash, tokens, urls, warc
from tallymart.functions.values import computed_once
from tallymart.session import fresh_path, tune

QUALITY_THRESHOLD = 0.3

VOCABULARY = "word_bpe_49k.json"

# The rules of the URL filter.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_quality_nbsvm(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    rows = docs.select("doc_id", "text")
    held_out = quality.fold(F.col("doc_id"), 5) == 0
    model = quality.train(rows, labels.where(~held_out).select("doc_id", "quality"))
    scored = quality.with_score(rows, model).select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    path = warc.write(_table(spark, folder, "pages"), fresh_path(spark, "warc"))
    return warc.payloads(warc.read(spark, path))


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"), URL_RULES)


def op7_maxent_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held_out = quality.fold(F.col("doc_id"), 7) == 2
    found = maxent.score_corpus(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    return graph.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers  # the vocabulary's place; only this query needs it

    return tokens.token_counts(_table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def looped(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text): every tenth document by its id's hash reads a stretch of its words as a loop.

    With h = crc32(doc_id), g = h div 10, and n > 0 words: where h mod 10 = 0, word i from a = g mod n on
    is the original word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Others stay as they are.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = computed_once(rows, {"words": chosen}, [F.col(c) for c in rows.columns])
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    start = F.when(n > 0, g % n).cast("int")
    cut = computed_once(cut, {"a": start, "g": g}, [F.col(c) for c in ("doc_id", "text", "words")])
    period = F.floor((F.size("words") - F.col("a")) / (F.lit(3) + F.col("g") % 8)).cast("int") + 1
    cut = computed_once(cut, {"p": period}, [F.col(c) for c in ("doc_id", "text", "words", "a")])
    a, p = F.col("a"), F.col("p")
    loop = F.array_join(F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", a + (i - a) % p))), " ")
    return cut.select("doc_id", F.when(a.isNull(), F.col("text")).otherwise(loop).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.periodic_runs(looped(_table(spark, folder, "documents")), collapsed=False)
    return found.drop("collapsed", "n_words")


def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal.scan(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality_nbsvm,
        op2_source_mixing,
        op3_decontaminate,
        op4_warc_chunks,
        op5_simhash_near_dedup,
        op6_url_filter,
        op7_maxent_score,
        op8_graph_search,
        op9_license_scan,
        op10_token_counts,
        op11_lexical_search,
        op12_periodic_runs,
        op13_personal_data,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mixing": mixing.oracle(),
        "op9_license_scan": licenses.oracle(),
        "op11_lexical_search": ranked.oracle(),
    }
