"""Output of matches as CSV, the distance with three decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .points import check_delimiter


def match_lines(matches: DataFrame, id_label: str = "id", fields: tuple[str, ...] = ()) -> DataFrame:
    """input_index, <id_label>, lng, lat, distance, find_index, *fields as text."""
    return matches.select("input_index", id_label, "lng", "lat", F.format_string("%.3f", F.col("distance")).alias("distance"), "find_index", *fields)


def write_matches(matches: DataFrame, path: str, id_label: str = "id", fields: tuple[str, ...] = (), delimiter: str = ",") -> None:
    match_lines(matches, id_label, fields).write.mode("overwrite").csv(path, header=True, sep=check_delimiter(delimiter))
