"""A stream of changes into an index of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quarrystone.functions.frames import cut
from quarrystone.operators.records import RECORD_SCHEMA, latest_per_key
from quarrystone.operators.store import RecordIndex

COLUMNS = tuple(c.split()[0] for c in RECORD_SCHEMA.split(", "))


def apply_changes(index: RecordIndex, changes: DataFrame, order: tuple[str, ...] = ("arrived_at", "delivery_id")) -> None:
    """Applies upserts and deletes; of one record's changes the last counts, by the columns of `order`."""
    last = changes.groupBy("collection", "id").agg(F.max_by(F.struct("op", *(c for c in COLUMNS if c not in ("collection", "id"))), F.struct(*order)).alias("r"))
    rows = cut(last.select("collection", "id", "r.*"))
    index.delete_keys(rows.where("op = 'delete'"))
    index.upsert(rows.where("op = 'upsert'").select(*COLUMNS))


def stream_into(index: RecordIndex, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs apply_changes on every micro-batch. A batch that is sent again after a failure changes nothing more, as
    upserts and deletes of the same rows lead to the same records."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: apply_changes(index, batch)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_in_batches(stream: DataFrame, out: str, checkpoint: str, order: tuple[str, ...] = ("arrived_at", "delivery_id"), **trigger) -> StreamingQuery:
    """Writes the last row of each record in every micro-batch to out/batch=<number>. A batch that is sent again
    overwrites its own folder, so a failure neither loses nor doubles rows."""

    def write(batch: DataFrame, number: int) -> None:
        last = latest_per_key(batch.withColumn("__at", F.struct(*order)), "__at").drop("__at")
        last.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_of_batches(written: DataFrame, order: tuple[str, ...] = ("arrived_at", "delivery_id")) -> DataFrame:
    """The last row of each record over all batches."""
    return latest_per_key(written.drop("batch").withColumn("__at", F.struct(*order)), "__at").drop("__at")
