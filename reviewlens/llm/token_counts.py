"""Token-count rollups kept up to date by signed changes, in idempotent batches.

A store is a folder with one Parquet folder per batch and a ``log`` table.  A
batch holds the signed sums by (source, lang, tokenizer) that its changes make
and the new state of the documents it touched; totals are the sums over the
batches in the log, so they are additive and never recounted.

A change is (doc_id, op, source, lang, tokenizer, tokens): ``insert`` and
``revise`` give the document's new count under that tokenizer version,
``delete`` ends it.  A batch subtracts what the document counted before and
adds what it counts now, so a late or repeated insert does not count twice.
Within a batch a document's last change by ``seq`` counts (ties: the greatest
row).

Commit: a batch is written to a fresh folder, and then one row with its id and
folder is appended to the log.  A batch id that the log has already is left
alone, so a retried or replayed batch changes nothing, and a batch that died
before its commit is never read.  Should the log get an id twice, the row with
the smallest number holds.  One writer at a time commits to a store.

Snapshots: every ``SNAPSHOT_EVERY``-th commit also writes the latest row of each
document that is live, and the totals, as a folder that stands for all batches
so far; it is logged like a batch, under a name that no batch can have.  Readers
start from the last snapshot, so what they read is bounded by the documents and
the batches since, not by the history.  The ids of all batches stay in the log.

Scale: a batch meets only the state rows of the documents that it touches (the
others are left out before anything is grouped); sums are partial aggregates by group, so a source that holds a third
of all rows is one row per task.  The list of batches is one small table.

Defined cases: a NULL source, lang or tokenizer is a group of its own; a NULL
count counts as 0; a change without a doc_id or with another op is ignored; a
delete of an unknown document changes nothing; an empty batch can be committed;
groups that fall to no documents leave the totals; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, text_or_empty
from .packing import token_ids

GROUP = ("source", "lang", "tokenizer")
OPS = ("insert", "revise", "delete")
SNAPSHOT_EVERY = 16
SNAPSHOT = "\u0000snapshot"        # followed by the number of the last batch in it
_DOC = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint"


def count_tokens(docs: DataFrame, tokenizer: str, vocab_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens) of every whole text."""
    require(docs, id_col, text_col, "source", "lang")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), "source", "lang",
                       text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(token_ids(vocab_path, t.as_py())) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())],
                ["doc_id", "source", "lang", "tokenizer", "tokens"])

    return rows.mapInArrow(run, _DOC)


class Rollup:
    """A store of committed batches under ``path``, a folder that all executors share."""

    _LOG = "number bigint, batch_id string, folder string"
    _STATE = f"{_DOC}, live boolean, number bigint"
    _DELTAS = "source string, lang string, tokenizer string, documents bigint, tokens bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], self._LOG).write.mode("ignore").parquet(f"{self.path}/log")

    def log(self) -> dict[str, tuple[int, str]]:
        """batch id -> (number, folder), one small row per batch."""
        rows = (self.spark.read.schema(self._LOG).parquet(f"{self.path}/log")
                .groupBy("batch_id").agg(F.min(F.struct("number", "folder")).alias("r")))
        return {r["batch_id"]: (r["r"]["number"], r["r"]["folder"]) for r in rows.collect()}

    def _folders(self) -> list[str]:
        """The last snapshot and the batches since."""
        log = self.log()
        last, folder = max((r for name, r in log.items() if name.startswith(SNAPSHOT)), default=(-1, None))
        since = [f for name, (n, f) in log.items() if n > last and not name.startswith(SNAPSHOT)]
        return since if folder is None else [folder, *since]

    def _read(self, name: str, schema: str) -> DataFrame:
        parts = [f"{folder}/{name}" for folder in self._folders()]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*parts)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches."""
        return (self._read("deltas", self._DELTAS).groupBy(*GROUP)
                .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
                .filter("documents <> 0"))

    def state(self, touched: DataFrame | None = None) -> DataFrame:
        """The latest row of every document (of those in ``touched``) that a batch touched;
        ``live`` is false once deleted."""
        rows = self._read("state", self._STATE)
        if touched is not None:
            rows = rows.join(touched.select("doc_id"), "doc_id", "left_semi")
        last = F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), "number").alias("r")
        return rows.groupBy("doc_id").agg(last).select("doc_id", "r.*")

    def _log(self, number: int, name: str, folder: str) -> None:
        (self.spark.createDataFrame([(number, name, folder)], self._LOG).coalesce(1)
         .write.mode("append").parquet(f"{self.path}/log"))

    def snapshot(self) -> None:
        """Write what all committed batches come to, for readers to start from."""
        numbers = [n for name, (n, _) in self.log().items() if not name.startswith(SNAPSHOT)]
        if not numbers or f"{SNAPSHOT}{max(numbers)}" in self.log():
            return
        folder = f"{self.path}/snapshot-{uuid.uuid4().hex}"
        self.state().filter("live").write.parquet(f"{folder}/state")
        self.totals().write.parquet(f"{folder}/deltas")
        self._log(max(numbers), f"{SNAPSHOT}{max(numbers)}", folder)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch; False if that batch id is committed already."""
        if batch_id.startswith(SNAPSHOT):
            raise ValueError("this id is a snapshot's")
        log = self.log()
        if batch_id in log:
            return False
        require(changes, "doc_id", "op", "seq", *GROUP, "tokens")
        number = 1 + max([n for n, _ in log.values()], default=-1)
        folder = f"{self.path}/batch-{uuid.uuid4().hex}"
        row = F.struct("seq", "op", *GROUP, F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
        (changes.filter(F.col("op").isin(*OPS) & F.col("doc_id").isNotNull())
         .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(row).alias("r"))
         .select("doc_id", "r.*").write.parquet(f"{folder}/changes"))
        new = self.spark.read.parquet(f"{folder}/changes")
        old = self.state(new).filter("live").select("doc_id", F.struct(*GROUP, "tokens").alias("old"))
        live = F.col("op") != "delete"
        (new.join(old, "doc_id", "left").filter(live | F.col("old").isNotNull())
         .select("doc_id", *GROUP, "tokens", live.alias("live"), F.lit(number).cast("long").alias("number"), "old")
         .write.parquet(f"{folder}/state"))
        applied = self.spark.read.parquet(f"{folder}/state")
        one = F.lit(1).cast("long")
        signed = F.array(
            F.when(F.col("live"), F.struct(*GROUP, one.alias("documents"), "tokens")),
            F.when(F.col("old").isNotNull(), F.struct(
                *[F.col(f"old.{c}").alias(c) for c in GROUP], (-one).alias("documents"),
                (-F.col("old.tokens")).alias("tokens"))))
        (applied.select(F.explode(F.filter(signed, lambda x: x.isNotNull())).alias("d")).select("d.*")
         .groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
         .write.parquet(f"{folder}/deltas"))
        self._log(number, batch_id, folder)
        if (number + 1) % SNAPSHOT_EVERY == 0:
            self.snapshot()
        return True
