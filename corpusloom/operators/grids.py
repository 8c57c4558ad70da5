"""Tables of cells: merged ranges filled, rows flattened to label, header and value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """``cells(sheet, row, col, value)`` with the top-left value in every cell of ``merges(sheet, r0, c0, rowspan, colspan)``.

    Ranges end at the used area; cells that have a value keep it.
    """
    used = cells.groupBy("sheet").agg(F.max("row").alias("rmax"), F.max("col").alias("cmax"))
    area = merges.join(used, "sheet").select("sheet", "r0", "c0", F.explode(F.sequence("r0", F.greatest("r0", F.least(F.col("r0") + F.col("rowspan") - 1, "rmax")))).alias("row"), "colspan", "cmax")
    area = area.select("sheet", "r0", "c0", "row", F.explode(F.sequence("c0", F.greatest("c0", F.least(F.col("c0") + F.col("colspan") - 1, "cmax")))).alias("col"))
    origin = cells.select("sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("value").alias("top"))
    fill = area.join(origin, ["sheet", "r0", "c0"]).groupBy("sheet", "row", "col").agg(F.min_by("top", F.struct("r0", "c0")).alias("top"))
    both = cells.join(fill, ["sheet", "row", "col"], "full_outer")
    return both.select("sheet", "row", "col", F.when(F.coalesce("value", F.lit("")) != "", F.col("value")).otherwise(F.col("top")).alias("value"))


def flatten_table(cells: DataFrame, header_rows: int = 1, label_cols: int = 1) -> DataFrame:
    """sheet, row, col, label, header, value: header paths (``A > B``) and row labels (repeats once) of each data cell."""
    filled = cells.where(F.coalesce("value", F.lit("")) != "")
    join = lambda pos, sep: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(pos, "value"))), lambda x: x["value"])), sep)
    heads = filled.where((F.col("row") < header_rows) & (F.col("col") >= label_cols)).groupBy("sheet", "col").agg(join("row", " > ").alias("header"))
    labels = filled.where((F.col("row") >= header_rows) & (F.col("col") < label_cols)).groupBy("sheet", "row").agg(join("col", " ").alias("label"))
    data = filled.where((F.col("row") >= header_rows) & (F.col("col") >= label_cols))
    return data.join(heads, ["sheet", "col"], "left").join(labels, ["sheet", "row"], "left").select("sheet", "row", "col", "label", "header", "value")
