"""CSV tables as cells in long form, annotation targets, and results as files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text


@F.pandas_udf(ArrayType(StringType()))
def _quoted(lines: pd.Series) -> pd.Series:
    """Fields of lines with quotes: a quote toggles anywhere in a field, a doubled one inside quotes is a quote."""

    def fields(line):
        if line is None:
            return None
        out, field, inside, i = [], [], False, 0
        while i < len(line):
            c = line[i]
            if c == '"' and inside and line[i + 1 : i + 2] == '"':
                field.append('"')
                i += 1
            elif c == '"':
                inside = not inside
            elif c == "," and not inside:
                out.append("".join(field))
                field = []
            else:
                field.append(c)
            i += 1
        return [*out, "".join(field)]

    return lines.map(fields)


def split_line(line: Column) -> Column:
    """The fields of a line.  The Arrow function gets null for lines without a quote."""
    quoted = line.contains('"')
    return F.coalesce(_quoted(F.when(quoted, line)), F.split(line, ","))


def decoded(path: Column) -> Column:
    """A file's name or path as it is; Spark's metadata encodes it as a URI, in which a plus sign stands for itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def raw_lines(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """table_id, nth (from 0) and line of every non-blank line of the folder's CSV files (extension in any case).

    Files are read in blocks, a large one by several tasks; a line's number is its place in its block after the
    lines of the blocks before.
    """
    name = decoded(F.col("_metadata.file_name"))
    lines = spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").option("lineSep", "\n").text(folder)
    lines = lines.select(F.regexp_replace(name, r"(?i)\.csv$", "").alias("table_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line"))
    lines = lines.where(~F.col("line").rlike(f"^{text.BLANK}*$"))
    before = Window.partitionBy("table_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("table_id", "block").agg(F.count("*").alias("lines"))
    blocks = blocks.select("table_id", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("table_id", "block").orderBy("id")) - 1
    return lines.withColumn("place", place).join(blocks, ["table_id", "block"]).select("table_id", (F.col("base") + F.col("place")).alias("nth"), "line")


def read_cells(spark: SparkSession, folder: str | list[str], has_header: bool = True, on_malformed: str = "drop") -> DataFrame:
    """cells: table_id, row_idx, col_idx, header, value, cleaned and not empty.

    A cell beyond the header's width is dropped (on_malformed="error": the read fails).
    """
    rows = raw_lines(spark, folder)
    fields = rows.select("table_id", "nth", F.posexplode(split_line(F.col("line"))).alias("col_idx", "raw"))
    fields = fields.select("table_id", "nth", "col_idx", text.clean(F.col("raw")).alias("value"))
    if has_header:
        headers = fields.where("nth = 0").select("table_id", "col_idx", F.col("value").alias("header"))
        body = fields.where("nth > 0").withColumn("nth", F.col("nth") - 1)
    else:
        first = fields.where("nth = 0").select("table_id", "col_idx")
        headers, body = first.withColumn("header", F.concat(F.lit("Column"), F.col("col_idx") + 1)), fields
    body = body.where("value <> ''").join(headers.withColumn("known", F.lit(True)), ["table_id", "col_idx"], "left")
    if on_malformed == "error":
        message = F.concat(F.lit("row longer than its header in "), F.col("table_id"))
        body = body.withColumn("header", F.when(F.col("known").isNull(), F.raise_error(message)).otherwise(F.col("header")))
    else:
        body = body.where("known")
    return body.select("table_id", F.col("nth").cast("int").alias("row_idx"), "col_idx", "header", "value")


def melt(df: DataFrame, table_id: Column, row_idx: Column, columns: list[str]) -> DataFrame:
    """cells of a wide DataFrame."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("header"), text.clean(F.col(c).cast("string")).alias("value")) for i, c in enumerate(columns)]))
    x = df.select(table_id.alias("table_id"), row_idx.cast("int").alias("row_idx"), cells.alias("c"))
    return x.select("table_id", "row_idx", "c.*").where("value <> ''")


def sample_rows(cells: DataFrame, size: int | None) -> DataFrame:
    """The first, the last and evenly spaced rows of each table, about ``size``; all if unset or not fewer."""
    if not size or size <= 0:
        return cells
    rows = cells.groupBy("table_id").agg((F.max("row_idx") + 1).alias("n"))
    x = cells.join(rows, "table_id")
    step = F.floor(F.col("n") / size)
    spaced = (F.col("row_idx") % step == 0) & (F.floor(F.col("row_idx") / step) <= max(size - 2, 0))
    return x.where((F.lit(size) >= F.col("n")) | (F.col("row_idx") == F.col("n") - 1) | spaced).drop("n")


def _targets(spark: SparkSession, path: str) -> DataFrame:
    """Lines in their order: monotonically increasing ids follow a file's lines."""
    return spark.read.text(path).where(~F.col("value").rlike(f"^{text.BLANK}*$")).select(F.monotonically_increasing_id().alias("target_no"), F.split("value", ",").alias("f"))


def _leading_int(field: int) -> Column:
    """The whole number that a field of ``f`` begins with, else null."""
    return F.regexp_extract(F.get("f", F.lit(field)), f"^{text.BLANK}*([+-]?[0-9]+)", 1).try_cast("int")


def read_cta_targets(spark: SparkSession, path: str) -> DataFrame:
    """target_no, table_id, col_idx, result; lines without an id or a column number are dropped."""
    x = _targets(spark, path).select("target_no", F.get("f", F.lit(0)).alias("table_id"), _leading_int(1).alias("col_idx"), F.nullif(F.get("f", F.lit(2)), F.lit("")).alias("result"))
    return x.where((F.col("table_id") != "") & F.col("col_idx").isNotNull())


def read_cea_targets(spark: SparkSession, path: str) -> DataFrame:
    """target_no, table_id, row (from 1), col_idx, uri; numbers that can't be read are null."""
    return _targets(spark, path).select("target_no", F.get("f", F.lit(0)).alias("table_id"), _leading_int(1).alias("row"), _leading_int(2).alias("col_idx"), F.nullif(F.get("f", F.lit(3)), F.lit("")).alias("uri"))


def write_lines(targets: DataFrame, columns: list[str], path: str) -> None:
    """Targets as comma-separated lines in target order."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    targets.orderBy("target_no").select(line.alias("value")).write.mode("overwrite").text(path)


def save_annotations(df: DataFrame, path: str, format: str = "json") -> None:
    """Annotations as JSON lines, or as CSV with nested columns as JSON text."""
    if format == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
        df = df.withColumns({c: F.to_json(c) for c in nested})
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").json(path)
