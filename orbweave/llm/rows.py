"""Keys of rows, for decisions that must also reach rows without an id and tell
rows that repeat an id apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .scratch import materialize, small_batches

KEY = "_row_key"
#: Where a row stands: file and row number, or its key.
LOCATOR = "_row_locator"
#: Rejected rows joined by broadcast at most; more are shuffled.
BROADCAST_ROWS = 200_000


def keyed(docs: DataFrame, locator: bool = False) -> DataFrame:
    """``docs`` with a number of its own for each row in ``KEY``, the same
    whenever the result is read, and on demand a ``LOCATOR``.

    Rows of a plain file scan are numbered by file and place in it; any other
    table is written once with its numbers.  A table that has keys keeps them.
    """
    small_batches(docs.sparkSession)
    if KEY in docs.columns:
        return docs.withColumn(LOCATOR, F.concat(F.lit("row#"), F.col(KEY))) if locator and LOCATOR not in docs.columns else docs
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns:
        try:
            placed = docs.select("*", F.col("_metadata.file_path").alias("_row_file"), F.col("_metadata.row_index").alias("_row_index"))
            files = sorted(r[0] for r in placed.select("_row_file").distinct().collect())  # as many as there are files
        except AnalysisException:
            pass
        else:
            numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "_row_file string, _row_number long")
            out = placed.join(F.broadcast(numbers), "_row_file").select("*", (F.col("_row_number") * F.lit(1 << 40) + F.col("_row_index")).alias(KEY))
            return out.select(*docs.columns, KEY, *([F.concat_ws("#", "_row_file", "_row_index").alias(LOCATOR)] if locator else []))
    return keyed(materialize(docs.withColumn(KEY, F.monotonically_increasing_id()), "keyed"), locator)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Keyed ``docs`` without the rows whose keys ``gone`` has, and without keys."""
    gone = materialize(gone.select(KEY), "rejected")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, KEY, "left_anti").drop(KEY)


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str, largest: bool) -> DataFrame:
    """(KEY, id) of the rows that go when each group of ``groups`` (KEY, group)
    keeps the row with the largest or smallest id; a row without an id stays
    only where no other has one, and of rows with one id one stays."""
    rows = materialize(groups.join(docs.select(KEY, F.col(id_col).cast("long").alias("id")), KEY), "groups")
    best = F.max(F.struct("id", KEY)) if largest else F.min(F.struct(F.col("id").isNull().alias("none"), "id", KEY))
    stay = rows.groupBy("group").agg(best.alias("best")).select(F.col("best")[KEY].alias(KEY))
    return rows.select(KEY, "id").join(stay, KEY, "left_anti")
