"""Helpers shared by the operators: names that cannot clash, stored steps, running sums, components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.session import fresh_path

_PACKAGE = Path(__file__).resolve().parent.parent


def ready(df: DataFrame) -> SparkSession:
    """The frame's session, once its Python workers can import this package.

    Where the package is not on the workers' path already, Spark ships it as a zip.
    """
    spark = df.sparkSession
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    context = spark.sparkContext
    if str(_PACKAGE.parent) not in paths and not getattr(context, "_has_tallymart", False):
        archive = Path(tempfile.mkdtemp(prefix="tallymart-code-")) / "tallymart.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(_PACKAGE.rglob("*.py")):
                z.write(path, path.relative_to(_PACKAGE.parent))
        context.addPyFile(str(archive))
        context._has_tallymart = True
    return spark


def fresh(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column (whatever its case) has that name."""
    names = {n.lower() for n in taken}
    while wanted.lower() in names:
        wanted = "_" + wanted
    return wanted


def col(df: DataFrame, name: str) -> Column:
    """A column by its plain name, dots and backticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder and read it back: its lineage ends there.

    Lost executors cost a reread, not the work. Files stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x"),
    ).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links ``(a, b)`` between long ids: rows ``(node, root)``.

    The root is the smallest node of the component; nodes without links are not returned.
    Alternates large-star and small-star rounds, each a minimum per node (combined on the map
    side) and a join that AQE may split, so a node with very many links costs no single task.
    The number of rounds grows with the logarithm of the longest chain. Every round is stored.
    """
    now = store(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    seen = _state(now)
    while seen[0]:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("hub"), F.least("a", "low").alias("low")
        )
        large = both.where("b > a").join(least, F.col("a") == F.col("hub")).select(
            F.col("b").alias("a"), F.col("low").alias("b")
        )
        large = store(large.where("a <> b").distinct(), "links")
        low = large.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("hub"), "low")
        small = large.join(low, F.col("a") == F.col("hub")).where("b <> low").select(
            F.col("b").alias("a"), F.col("low").alias("b")
        )
        small = small.union(low.select(F.col("hub").alias("a"), F.col("low").alias("b")))
        now = store(
            small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .where("a <> b")
            .distinct(),
            "links",
        )
        state = _state(now)
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
