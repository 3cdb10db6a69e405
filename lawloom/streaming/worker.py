"""The outbox as a stream: task messages to idempotent upserts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lawloom.schemas import OUTBOX
from lawloom.sources.store import Store

#: Gets the units of a micro-batch, each with the ``batch_id`` of its message.
Handler = Callable[[DataFrame], None]
#: Files of messages in a micro-batch at most.
FILES = 32


def units_of(store: Store, messages: DataFrame) -> DataFrame:
    """The units that messages name, each once, with ``batch_id``; ids without a unit are left out."""
    ids = messages.select("batch_id", F.explode("unit_ids").alias("id")).groupBy("id").agg(F.min("batch_id").alias("batch_id"))
    return store.read("law_units").join(ids, "id")


def consume(store: Store, handlers: dict[str, Handler], checkpoint: str, outbox: str = "outbox", once: bool = True, files: int = FILES) -> StreamingQuery:
    """Run the handler of each task over the units its messages name. Missing ids are left out.

    A micro-batch takes at most ``files`` files and reads the ids of a task with one join; a task without messages is not
    run. An error ends the query with the offset not advanced; a restart gives the batch again, which keyed upserts make
    harmless. ``once`` drains what is there and ends.
    """

    def batch(messages: DataFrame, _: int) -> None:
        asked = {r[0] for r in messages.select("task").distinct().collect()}  # a handful of names
        for task, handle in handlers.items():
            if task in asked:
                handle(units_of(store, messages.where(F.col("task") == task)))

    stream = store.spark.readStream.schema(OUTBOX).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files).parquet(f"{store.root}/{outbox}")
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def stop(query: StreamingQuery, seconds: float = 15) -> bool:
    """Stop between two batches: wait for the one that is running, at most some seconds; whether it had come to its end."""
    until = time.monotonic() + seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.05)
    idle = not query.isActive or not query.status["isTriggerActive"]
    query.stop()
    return idle
