"""Raw CSV with what a table of cells loses: where each row stood, and rows that do not fit the header.

A row's place is its file, the start of its split and a number that grows along the split, so places
order rows as the files have them without any sort or count; files go by path. ``numbered`` turns places
into row numbers, which needs one count per split. A row with more or fewer cells than the header has
is kept apart with its text and a reason; its cells are not guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.functions.sizes import broadcast_if_small
from tallymart.sources.files import MISSING_MARKERS

SOURCE = "source_place"
RECORD = "source_record"
MALFORMED = "malformed"
SURPLUS, SHORT, UNREADABLE = "surplus_cells", "missing_cells", "unreadable"


def read_rows(
    spark: SparkSession,
    path: str,
    columns: T.StructType,
    missing: list[str] = MISSING_MARKERS,
    header: bool = True,
    multiline: bool = False,
    strict: bool = False,
) -> DataFrame:
    """The named columns as text, with ``source_place``, ``malformed`` (a reason or null) and ``source_record``.

    With a header the columns are found by name among any others, and absent ones are left out;
    without one the file has exactly these columns. ``strict`` raises where any row is malformed, which
    costs a read. The cells of a malformed row are null and its text is in ``source_record``.
    """
    reader = spark.read.option("escape", '"').option("multiLine", multiline)
    names = reader.option("header", True).csv(path).columns if header else [f.name for f in columns]
    mark = "\ufeff"
    there = {name.removeprefix(mark): name for name in names}
    record = RECORD
    while record in names:
        record = "_" + record
    whole = T.StructType([T.StructField(n, T.StringType()) for n in [*names, record]])
    # Cells are counted only when all of them are parsed.
    rows = (
        reader.schema(whole)
        .option("header", header)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", record)
        .option("columnPruning", False)
        .csv(path)
    )
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Spark refuses to read the record alone, as a count of malformed rows would: a cell always goes with it.
    beside = F.substring(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")), 1, 0)
    text = F.concat(F.col(f"`{record}`"), beside)
    cells = {f.name: F.col(f"`{there[f.name]}`") for f in columns if f.name in there}
    read = rows.select(
        *[F.when(text.isNull() & ~c.isin(missing), c).alias(name) for name, c in cells.items()],
        place.alias(SOURCE),
        _reason(text, len(names)).alias(MALFORMED),
        text.alias(RECORD),
    )
    if strict:
        found = {r[MALFORMED]: r["n"] for r in malformed_counts(read).collect()}
        if found:
            raise ValueError(f"malformed rows: {found}")
    return read


def _reason(record: Column, width: int) -> Column:
    """Cells are counted by the commas outside quotes."""
    bare = F.regexp_replace(record, r'"(?:[^"]|"")*+"', "")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    return F.when(cells > width, SURPLUS).when(cells < width, SHORT).when(record.isNotNull(), UNREADABLE)


def well_formed(rows: DataFrame) -> DataFrame:
    """The rows that fit the header, with their cells and ``source_place``."""
    return rows.where(F.col(MALFORMED).isNull()).drop(MALFORMED, RECORD)


def malformed(rows: DataFrame) -> DataFrame:
    """Rows (source_record, reject_reason, copies): each different malformed text once."""
    bad = rows.where(F.col(MALFORMED).isNotNull())
    return bad.groupBy(RECORD, F.col(MALFORMED).alias("reject_reason")).agg(F.count(F.lit(1)).alias("copies"))


def malformed_counts(rows: DataFrame) -> DataFrame:
    """Rows (malformed, n): the number of malformed rows by reason."""
    return rows.where(F.col(MALFORMED).isNotNull()).groupBy(MALFORMED).agg(F.count(F.lit(1)).alias("n"))


def numbered(rows: DataFrame, name: str = "source_row") -> DataFrame:
    """``rows`` with a row number from 1 in place of ``source_place``, in the order of the files.

    Counts run over splits, not rows: one row a split is sorted, and joined back.
    """
    file, block, row = (F.col(SOURCE)[part] for part in ("file", "block", "row"))
    splits = rows.groupBy(file.alias("_file"), block.alias("_block")).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n")
    starts = splits.select("_file", "_block", (before - F.col("_first") + 1).alias("_add"))
    there = rows.withColumns({"_file": file, "_block": block}).join(broadcast_if_small(starts), ["_file", "_block"])
    return there.withColumn(name, row + F.col("_add")).drop(SOURCE, "_file", "_block", "_add")
