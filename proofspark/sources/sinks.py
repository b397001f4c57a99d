"""Writers for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json_lines(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, from the ``json`` column of ``progress_json``."""
    reports.select("json").write.mode(mode).text(path)


def write_text(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The ``text`` column of ``report_text``; reports are parted by an empty line."""
    reports.select("text").write.mode(mode).option("lineSep", "\n\n").text(path)
