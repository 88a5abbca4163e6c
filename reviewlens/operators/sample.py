"""Development sample: the first n lines of a JSON-lines input.

Empty lines are skipped *after* the cut, so they use up the quota (as the
line-by-line copier did).  ``clean=True`` re-serialises each line to the
declared fields (all written, NULLs kept); a malformed line then fails the
job (FAILFAST), as the typed deserialiser did.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions.json_text import json_object
from reviewlens.schemas import SAMPLE_LINES
from reviewlens.sources.head import head_lines


def reserialize(lines: DataFrame, schema: T.StructType,
                defaults: dict[str, object] | None = None) -> DataFrame:
    """Parse each line to ``schema`` (FAILFAST) and write it back as JSON with
    every field present, escaped as the application's serializer escapes; ``defaults`` fill NULLs of non-nullable value types
    (a missing epoch time becomes 0)."""
    rec = F.from_json("value", schema, {"mode": "FAILFAST"})
    fields = []
    for f in schema.fields:
        c = rec[f.name]
        if defaults and f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        fields.append((f.name, c, f.dataType))
    return lines.select(json_object(fields).alias("value"))


def dev_sample(spark: SparkSession, source: str | list[str], target: str | None = None,
               n: int = SAMPLE_LINES, clean: bool = False,
               schema: T.StructType | None = None,
               defaults: dict[str, object] | None = None) -> DataFrame:
    """Sample ``source`` (files or folders of JSON lines); write to ``target``
    as text when given.  Returns the sample's lines (``value``)."""
    sample = head_lines(spark, source, n).where(F.length("value") > 0).select("value")
    if clean:
        if schema is None:
            raise ValueError("clean=True needs the record schema")
        sample = reserialize(sample, schema, defaults)
    if target is not None:
        sample.coalesce(1).write.mode("overwrite").text(target)
        return spark.read.text(target)
    return sample
