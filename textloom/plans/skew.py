"""Equi-joins whose keys may be hot: hot keys are found by a table of fixed size and dealt over salts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cell(key: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(77)), F.lit(cells)).cast("int")


def hot_cells(rows: DataFrame, key: str, cells: int = 1 << 14, factor: float = 4.0) -> DataFrame:
    """cell: those of ``cells`` hash cells of the key that hold more than ``factor`` times the mean count of rows.

    At most ``cells / factor`` rows whatever the table, so the driver can hold them; a key outside these cells has at most
    ``factor / cells`` of all rows. Counts combine before the shuffle.
    """
    counts = rows.groupBy(_cell(F.col(key), cells).alias("cell")).agg(F.count("*").alias("n"))
    mean = F.sum("n").over(Window.partitionBy(F.lit(0))) / cells  # over at most ``cells`` rows
    return counts.withColumn("mean", mean).where(F.col("n") > factor * F.greatest(F.col("mean"), F.lit(1.0))).select("cell")


def skew_join(rows: DataFrame, few: DataFrame, key: str, hot: DataFrame, how: str = "inner", salts: int = 32, cells: int = 1 << 14) -> DataFrame:
    """rows joined with few on key, where rows may have a hot key: its rows go to ``salts`` tasks, and few's row to each of them.

    ``hot`` is what ``hot_cells`` found for rows and key with the same ``cells``. A key outside it is joined once, as usual.
    """
    listed = [r["cell"] for r in hot.collect()]  # at most ``cells / factor`` numbers, see ``hot_cells``
    is_hot = _cell(F.col(key), cells).isin(listed) if listed else F.lit(False)
    own = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    each = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    other = few.withColumn("__salt", F.explode(each))
    return own.join(other, [key, "__salt"], how).drop("__salt")
