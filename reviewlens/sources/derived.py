"""Files derived from the driver tables, in the application's input formats.

The scans (JSON lines, TSV, first-lines sample) are exercised on files Spark
writes from the tables into the shared folder, so their size follows the
tables.  Lines are built with Spark's own JSON functions; two fields are
spliced in by hand to reproduce shapes real metadata has: ``category`` as a
bare string instead of a list, and ``rank`` as a JSON list instead of text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.sources.tables import MALFORMED_LINE_EVERY

# ---------------------------------------------------------------------------
# Fixed values of the file recipes.
CATEGORY_AS_TEXT_EVERY = 10      # key % 10 = 9: "category" is a JSON string
EMPTY_LINE_EVERY = 100           # key % 100 = 42: the line is empty
EMPTY_LINE_AT = 42
HEAD_LINES = 50_000              # lines that a file set written head first has in order, at least
LABEL_SPELLINGS = (("1", "0"), ("true", "false"), ("TRUE", "FALSE"))
# ---------------------------------------------------------------------------


def json_string(c: Column) -> Column:
    """JSON literal of a string column (quoted and escaped, or ``null``)."""
    return F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)


def _splice(obj: Column, *fields: tuple[str, Column]) -> Column:
    """Append raw ``"name":json`` members to a JSON object text."""
    head = F.regexp_extract(obj, r"^(.*)\}$", 1)
    parts = [head]
    for name, value in fields:
        parts += [F.lit(f',"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def metadata_json_lines(raw: DataFrame, key: str = "_key") -> DataFrame:
    """(``_key``, ``value``) JSON lines of raw metadata rows; ``raw`` must carry
    an integer ``_key`` (the part key)."""
    k = F.col(key)
    obj = F.to_json(F.struct("asin", "title", "brand", "main_cat", "price",
                             "description", "image", "date"),
                    {"ignoreNullFields": "false"})
    category = F.when(k % CATEGORY_AS_TEXT_EVERY == CATEGORY_AS_TEXT_EVERY - 1,
                      json_string(F.col("category")[0])).otherwise(F.to_json("category"))
    rank = F.when(F.col("rank").startswith("["), F.col("rank")).otherwise(json_string(F.col("rank")))
    line = _splice(obj, ("category", category), ("rank", rank))
    line = F.when(k % MALFORMED_LINE_EVERY == MALFORMED_LINE_EVERY // 2,
                  F.substring(line, 1, 20)).otherwise(line)
    return raw.select(k.alias(key), line.alias("value"))


def review_json_lines(raw_reviews: DataFrame) -> DataFrame:
    """JSON lines in the review input shape (nulls written as ``null``)."""
    obj = F.to_json(F.struct("reviewerID", "asin", "reviewText", "unixReviewTime"),
                    {"ignoreNullFields": "false"})
    return raw_reviews.select(obj.alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write ``value`` as text files, compressed: every review carries its whole text, so plain lines take
    many times the room of the tables they come from.  A file is one task for its reader."""
    (lines.select("value").write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .text(path))


def write_head_first(rows: DataFrame, order: list[str], make_lines: Callable[[DataFrame], DataFrame], path: str,
                     head: int = HEAD_LINES) -> None:
    """Write the lines of all ``rows`` so that those of the ``head`` first rows by ``order`` come first, in order.

    Only they are sorted with their texts: ordering all lines would move every review's text through
    a shuffle.  Where the head ends is found on the ``order`` columns alone; rows equal to its last one
    belong to it.  Behind the head lines come in any order.
    """
    last = rows.select(*order).orderBy(*order).limit(head).orderBy(*[F.desc(c) for c in order]).first()
    inside = F.lit(False)
    for c in reversed(order):                   # NULLs come first, as they are sorted
        v = F.lit(last[c] if last else None)
        inside = F.coalesce(F.col(c) < v, v.isNotNull() & F.col(c).isNull()) | (F.col(c).eqNullSafe(v) & (
            inside if c != order[-1] else F.lit(True)))
    write_lines(make_lines(rows.where(inside).orderBy(*order)), f"{path}/0-first")
    write_lines(make_lines(rows.where(~inside)), f"{path}/1-further")


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Training text (one line per row) and its label spelled three ways."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    spell = F.pmod(F.col("doc_id"), F.lit(len(LABEL_SPELLINGS)))
    label = F.lit(None).cast("string")
    for i, (yes, no) in enumerate(LABEL_SPELLINGS):
        label = F.when(spell == i, F.when(F.col("quality") == 1, F.lit(yes)).otherwise(F.lit(no))
                       ).otherwise(label)
    return (documents.join(labels, "doc_id")
            .select("doc_id", text.alias("text"), label.alias("sentiment")))
