"""The first lines of text files, without reading the rest.

Lines are taken in the order of file paths.  The files are listed with their
sizes (no content is read for that); then as many files as lie within a budget
of bytes are read at a time, the budget doubling, until enough lines are there.
A file larger than the budget is read from its front: Spark takes rows from its
first split, and from further ones only while rows are missing.  So the bytes
read depend on the lines wanted and their length, not on the size of the input.

The lines, ``n`` at most, pass through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUDGET = 4 << 20       # bytes of the first read
LISTED = 1000          # files that are listed at a time
LINES = "value string, file_path string"


def listed_files(spark: SparkSession, paths: list[str], page: int = LISTED) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files under ``paths``, in the order of paths; a file listed twice comes once."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
             .select("path", "length").distinct())
    last = None
    while True:
        rest = files if last is None else files.filter(F.col("path") > last)
        rows = rest.orderBy("path").limit(page).collect()
        yield from ((r["path"], r["length"]) for r in rows)
        if len(rows) < page:
            return
        last = rows[-1]["path"]


def _literal(path: str) -> str:
    """A path whose special characters are no glob."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _read(spark: SparkSession, paths: list[str], n: int) -> list[tuple[str, str]]:
    lines = spark.read.text([_literal(p) for p in paths]).select("value", F.col("_metadata.file_path").alias("file_path"))
    if len(paths) > 1:                # small files: together within the budget
        plain = F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))        # as it is listed
        lines = (lines.withColumns({"path": plain, "start": F.col("_metadata.file_block_start"),
                                    "seq": F.monotonically_increasing_id()})
                 .orderBy("path", "start", "seq").select("value", "file_path"))
    return [tuple(r) for r in lines.take(n)]


def head_lines(spark: SparkSession, path: str | list[str], n: int, budget: int = BUDGET) -> DataFrame:
    """(value, file_path): the first ``n`` lines in file order."""
    found: list[tuple[str, str]] = []
    group: list[str] = []
    size = 0
    for file, length in listed_files(spark, [path] if isinstance(path, str) else list(path)):
        if length == 0:
            continue
        if group and size + length > budget:
            found += _read(spark, group, n - len(found))
            group, size, budget = [], 0, 2 * budget
            if len(found) >= n:
                break
        group.append(file)
        size += length
    if group and len(found) < n:
        found += _read(spark, group, n - len(found))
    return spark.createDataFrame(found, LINES)
