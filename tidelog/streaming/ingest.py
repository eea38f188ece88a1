"""Change-log ingest, mirror maintenance and routed delivery as streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidelog.operators import routes as routing
from tidelog.sinks.mirror import Mirror


def batch_folder(batch: DataFrame, batch_id: int, path: str, checkpoint: str) -> str:
    """Folder of a batch, below one of its checkpoint: a repeated batch finds its own, while
    a new checkpoint, whose batches count from 0 again, overwrites nothing."""
    known = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()
    return f"{path}/run={json.loads(known.value)['id']}/batch={batch_id}"


def append_stream(changes: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ("op_date",)) -> DataStreamWriter:
    """Append-all sink. The file sink commits each batch once, so a restart from the
    checkpoint neither loses nor repeats changes; a new checkpoint replays."""
    dated = changes.withColumn("op_date", F.to_date("op_ts")) if "op_date" in partition_by else changes
    return (
        dated.writeStream.format("parquet").outputMode("append").partitionBy(*partition_by)
        .option("path", path).option("checkpointLocation", checkpoint)
    )


def mirror_stream(changes: DataFrame, mirror: Mirror, checkpoint: str, keep_versions: int | None = 2) -> DataStreamWriter:
    """Keep a mirror current. A repeated batch changes nothing. Runs are folded between batches, as their sizes ask for."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        mirror.apply(batch)
        mirror.compact()
        if keep_versions:
            mirror.vacuum(keep_versions)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def routed_stream(changes: DataFrame, load_routes, load_overrides, path: str, checkpoint: str) -> DataStreamWriter:
    """Deliver changes to their targets with the routes of the moment.

    ``load_routes`` and ``load_overrides`` return the inventory and the override log
    (or None); both are read anew per batch, so quarantined tables stop at once.
    Each batch owns a folder, which a repeated batch overwrites.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        current, overrides = load_routes(), load_overrides()
        if overrides is not None:
            current = routing.apply_overrides(current, overrides)
        routed = routing.route_changes(batch, current)
        by = ["target", "target_schema", "table_name"]
        routed.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(batch_folder(batch, batch_id, path, checkpoint))

    return changes.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
