"""What streams did, as a table: rows, rates, lag and a batch's own observations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from sightline.sources.folders import names, put_new, qualified

PROGRESS = "name string, run string, batch bigint, at string, rows bigint, rows_a_second double, done_a_second double, took_ms bigint, behind_ms bigint, observed map<string, string>"


class Measured(StreamingQueryListener):
    """Writes a row for each batch of the session's streams under a folder; a batch is told of once.

    behind_ms is the time between the latest event and the end of the batch, where a stream has a watermark; observed holds
    what DataFrame.observe() counted in the batch.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, qualified(spark, path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = (p.durationMs or {}).get("triggerExecution")
        latest = (p.eventTime or {}).get("max")
        row = {"name": p.name, "run": str(p.runId), "batch": p.batchId, "at": p.timestamp, "rows": p.numInputRows, "rows_a_second": p.inputRowsPerSecond, "done_a_second": p.processedRowsPerSecond, "took_ms": took, "behind_ms": _apart(latest, p.timestamp, took)}
        row["observed"] = {f"{name}.{k}": str(v) for name, values in (p.observedMetrics or {}).items() for k, v in values.asDict().items()}
        put_new(self.spark, f"{self.path}/{p.runId}-{p.batchId:09d}.json", json.dumps(row))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _apart(latest: str | None, began: str, took: int | None) -> int | None:
    import datetime

    if latest is None:
        return None
    a, b = (datetime.datetime.fromisoformat(x.replace("Z", "+00:00")) for x in (latest, began))
    return int((b - a).total_seconds() * 1000) + (took or 0)


def measured(spark: SparkSession, path: str) -> DataFrame:
    """The table that Measured keeps."""
    path = qualified(spark, path)
    files = [f"{path}/{n}" for n in names(spark, path) if n.endswith(".json")]
    return spark.read.schema(PROGRESS).json(files) if files else spark.createDataFrame([], PROGRESS)
