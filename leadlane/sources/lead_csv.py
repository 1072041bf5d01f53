"""CSV source and sink for lead exports."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlane import rules
from leadlane.functions.text import strip
from leadlane.sources.ordinals import join_small, running_before
from leadlane.sources.staging import Workspace

BOM = chr(0xFEFF)


# Encodings in which a line break or a quote is not the same byte as in ASCII; their files cannot be split.
WIDE_ENCODINGS = ("utf-16", "utf-16be", "utf-16le", "utf-32", "utf-32be", "utf-32le")
# Quotes are doubled inside quotes.
_DIALECT = {"quote": '"', "escape": '"'}


def _reader(spark: SparkSession, multiline: bool, encoding: str):
    """Reader of every line, the header included, as a row of texts."""
    return (
        spark.read.options(**_DIALECT)
        .option("header", False)
        .option("multiLine", multiline)
        .option("encoding", encoding)
        .option("columnNameOfCorruptRecord", "odd_record")
    )


def files_with_quoted_line_breaks(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Files with a line that holds an odd number of quotes, so that a record may go on in the next line."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    odd = lines.filter(quotes % 2 == 1).select("source_file").distinct()
    return [r["source_file"] for r in odd.collect()]  # no more than the files that the driver lists anyway


def read_header(spark: SparkSession, path: str | list[str], multiline: bool, encoding: str = "UTF-8") -> list[str]:
    """Stripped column names of the first file, checked for the required columns."""
    try:
        first = _reader(spark, multiline, encoding).csv(path).first()
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            first = None
        else:
            raise
    found = [(cell or "").lstrip(BOM).strip() for cell in first or ()]
    absent = [c for c in rules.COLUMNS if c not in found]
    if absent:
        raise ValueError(f"No column {', '.join(absent)} among {found}")
    return found


def _has_more_cells(record: Column, cells: list[str]) -> Column:
    """Whether the text of a record has more cells than these, as the parser itself counts them.

    The record is parsed once more with one cell added. If that cell, a text that occurs nowhere, is not among the first
    ones, then others are; in a record that ends within quotes it is the end of its last cell.
    """
    end = uuid.uuid4().hex
    schema = ", ".join(f"`{c}` string" for c in cells)
    parsed = F.from_csv(F.concat(record, F.lit(f",{end}")), schema, {**_DIALECT, "mode": "PERMISSIVE"})
    found = F.exists(F.array(*[parsed[c] for c in cells]), lambda cell: F.coalesce(cell.endswith(end), F.lit(False)))
    return record.isNotNull() & ~found


def _records(spark: SparkSession, path: str | list[str], header: list[str], multiline: bool, encoding: str) -> DataFrame:
    """One row per record, blank lines left out, with the file, the block of the file and whether it is too long."""
    cells = [f"cell_{i}" for i in range(len(header))]
    # Spark keeps the text of a record whose number of cells is not that of the header, and of a blank line.
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, "odd_record"]])
    is_record = F.coalesce(F.btrim("odd_record", F.lit(" \t\r\n")) != "", F.lit(True))
    is_header = [F.coalesce(strip(F.ltrim(F.col(c), F.lit(BOM))), F.lit("")) == n for c, n in zip(cells, header)]
    # A lead column found twice is read from its first place; other columns are not needed.
    wanted = [F.col(cells[header.index(c)]).alias(c) for c in rules.COLUMNS]
    return (
        _reader(spark, multiline, encoding)
        .schema(schema)
        .csv(path)
        .filter(is_record)
        .select(
            *wanted,
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("block"),
            reduce(and_, is_header).alias("is_header"),
            _has_more_cells(F.col("odd_record"), cells).alias("too_long"),
        )
    )


def read_leads_csv(
    spark: SparkSession,
    path: str | list[str],
    multiline: bool | None = None,
    encoding: str = "UTF-8",
    workspace: Workspace | None = None,
) -> DataFrame:
    """The eleven lead columns as texts, with ``source_row``, ``source_file`` and ``file_row``.

    All files are numbered as one table in the order of their paths: ``source_row`` counts records below one header,
    so it is unique, and ``file_row`` is the record's number within its file. The numbers come from counts per file
    block. ``multiline`` says whether quoted cells may contain line breaks; files with such cells cannot be split.
    By default a look at the quotes of every line decides file by file, which reads the input once more. A record
    with more cells than the header is refused, also if the cells beyond are empty.
    """
    workspace = workspace or Workspace(spark)
    if encoding.lower() in WIDE_ENCODINGS:
        multiline = True
    whole = files_with_quoted_line_breaks(spark, path) if multiline is None else []
    header = read_header(spark, path, bool(multiline or whole), encoding)
    if whole:
        among = F.col("source_file").isin(whole)
        records = _records(spark, path, header, False, encoding).filter(~among).unionAll(
            _records(spark, path, header, True, encoding).filter(among)
        )
    else:
        records = _records(spark, path, header, bool(multiline), encoding)
    staged = workspace.stage(
        records.withColumns({"file_key": F.xxhash64("source_file"), "row_id": F.monotonically_increasing_id()}), "raw"
    )

    blocks = staged.groupBy("source_file", "file_key", "block").agg(
        F.count("*").alias("block_rows"),
        F.min("row_id").alias("first_id"),
        F.min(F.when(F.col("is_header"), F.col("row_id"))).alias("header_id"),
        F.count_if("too_long").alias("long_rows"),
    )
    blocks = workspace.stage(running_before(blocks, "block_rows", "block", ("source_file",)), "blocks")
    _check_blocks(blocks, header)
    files = blocks.groupBy("source_file").agg((F.sum("block_rows") - 1).alias("file_rows"))
    before = running_before(files, "file_rows", "source_file").select("source_file", F.col("rows_before").alias("files_before"))
    places = blocks.join(before, "source_file").select("file_key", "block", "first_id", "rows_before", "files_before")

    numbered = join_small(staged, workspace.stage(places, "places"), ["file_key", "block"])
    record = F.col("rows_before") + F.col("row_id") - F.col("first_id") + 1
    return (
        numbered.withColumn("file_row", record)
        .filter("file_row > 1")
        .withColumn("source_row", F.col("file_row") + F.col("files_before"))
        .select("source_file", "file_row", "source_row", *rules.COLUMNS)
    )


def _check_blocks(blocks: DataFrame, header: list[str]) -> None:
    """Refuse files with another header and rows with more cells than the header."""
    wrong_header = (F.col("block") == 0) & ~F.col("header_id").eqNullSafe(F.col("first_id"))
    problem = blocks.filter(wrong_header | (F.col("long_rows") > 0)).first()
    if problem and problem["long_rows"]:
        raise ValueError(f"{problem['source_file']} has {problem['long_rows']} row(s) with more cells than its header")
    if problem:
        raise ValueError(f"{problem['source_file']} does not start with the header {header}")


def _decimal_text(value: Column) -> Column:
    """A double without exponent, the way spreadsheets read it."""
    text = F.rtrim(value.cast("decimal(38,10)").cast("string"), F.lit("0"))
    plain = F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)
    return F.when(F.abs(value).between(1e7, 1e16), plain).otherwise(value.cast("string"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a table as CSV files in its own order: a header in each file, empty cells without quotes."""
    formats = {"double": _decimal_text, "boolean": lambda c: F.initcap(c.cast("string"))}
    columns = [formats.get(kind, lambda c: c)(F.col(name)).alias(name) for name, kind in df.dtypes]
    (
        df.select(*columns)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
