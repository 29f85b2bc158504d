"""X1 with the newest text of each product as streaming state.

``streaming.incremental`` keeps every arrival and finds the newest one by an
aggregate over all of them.  Here the id of the newest text is a value state
keyed by ``uid`` (``transformWithState``), so the work of a micro-batch
grows with the batch:

1. of the rows of one Arrow batch the largest id per ``uid`` goes on (a combine
   before the shuffle, so a hot product is one row per Arrow batch), with the place
   of its text, not the text (``places``);
2. the state gives on a product only if its newest text has changed - a repeated
   row ends here;
3. those documents are embedded and classified if the store lacks them (only then are
   their texts read again); a text that comes back finds its vector and answer stored.

The answers are read from the state (one row per product, Spark's state reader)
and the store; no table of arrivals is written or read.  A replayed batch starts
from the state of the batch before and finds its ids stored, so it adds nothing.
Of several texts of a product in one batch that of the largest id counts, as in
``incremental.answers``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from taxomatch.sources.collections import PRODUCTS, VectorStore
from taxomatch.streaming import places as P
from taxomatch.streaming.incremental import doc_ids, store_answers

STATE = "newest"
#: Value states of ``transformWithState`` need this state store.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Many small stores, one per partition: no disk is set aside for what they may write.
NO_RESERVE = ("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")


class Newest(StatefulProcessor):
    """Keeps the id of the newest text of a product; gives on a row when it changes."""

    def init(self, handle) -> None:
        self.current = handle.getValueState(STATE, "id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = None
        for row in rows:
            if last is None or row["id"] > last["id"]:
                last = row
        if last is None or (self.current.exists() and self.current.get()[0] == last["id"]):
            return
        self.current.update((last["id"],))
        yield last

    def close(self) -> None:
        pass


def _largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows.sort_values("id", kind="stable").drop_duplicates("uid", keep="last")


def changes(stream: DataFrame, carried: tuple[str, ...] = ("text",)) -> DataFrame:
    """``uid, id`` and the columns ``carried`` of the products of a stream (``uid, text``, places)
    whose newest text has changed.  Rows without a ``uid`` take no part."""
    docs = doc_ids(stream).where("uid IS NOT NULL").select("uid", "id", *carried)
    docs = docs.mapInPandas(_largest, docs.schema)
    return docs.groupBy("uid").transformWithState(Newest(), docs.schema, "Update", "None")


def start(spark: SparkSession, source_dir: str, schema: str, store_root: str, checkpoint: str,
          model: str, embed: Callable[[DataFrame], DataFrame], category_docs: DataFrame,
          available_now: bool = True, max_files_per_trigger: int | None = None, **search_kw):
    """Start the stream; the arguments are those of ``incremental.start``.

    The query takes the state store it needs; the session's own setting is put back."""
    store = VectorStore(spark, store_root)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def sink(changed: DataFrame, number: int) -> None:
        changed.persist()
        try:
            files = sorted(r.file for r in changed.select("file").distinct().collect())
            if files:
                texts = doc_ids(P.read(spark, source_dir, schema, files, "uid", "text"))
                store_answers(changed, texts, store, model, embed, category_docs, **search_kw)
        finally:
            changed.unpersist()

    w = (changes(P.with_places(reader.parquet(source_dir), "uid", "text"), P.PLACE).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    before = {key: spark.conf.get(key, None) for key, _ in (PROVIDER, NO_RESERVE)}
    for key, value in (PROVIDER, NO_RESERVE):
        spark.conf.set(key, value)
    try:
        return w.start()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def run_available(spark: SparkSession, *args, **kw) -> None:
    q = start(spark, *args, available_now=True, **kw)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def newest_ids(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``uid, id``: the state after the last finished micro-batch."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    return state.select("key.uid", "value.id")


def answers(spark: SparkSession, store_root: str, model: str, checkpoint: str) -> DataFrame:
    """The answer table: one row per product, the answer to its newest text."""
    store = VectorStore(spark, store_root)
    stored = store.scan(PRODUCTS, model)
    if stored is None:
        return spark.createDataFrame([], "_id string, category string")
    return (newest_ids(spark, checkpoint).join(stored.select("id", "category"), "id")
            .select(F.col("uid").alias("_id"), "category"))
