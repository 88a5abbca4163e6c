"""reviewlens: review sentiment and demand reports as Spark DataFrame jobs.

Layout
  session.py     session defaults and the shared working folder
  schemas.py     declared input / report schemas and fixed report parameters
  functions/     native column expressions (clean-up scalars, time buckets, text)
  sources/       readers: JSON lines, TSV, text samples, driver-table mapping
  operators/     clean-up, fact build, report aggregates, rankings, ML stages
  sinks/         report replace (parquet / JDBC), key checks, model save
  plans/         the end-to-end report job and the registered queries
  streaming/     intentionally empty (no streaming in the source application)
"""

__version__ = "0.1.0"
