"""Counts taken in passing: of what a job writes, without a second job, and of what a stream has taken in so far."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def written_with(df: DataFrame, write: Callable[[DataFrame], None], **metrics: Column) -> dict:
    """What ``metrics``, aggregates of ``df``, are over the rows that ``write`` wrote; ``rows`` is their number.

    Tasks that run twice, after a failure or for speed, count once, as Spark takes the metrics of the attempt that completes a stage.
    """
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items())))
    return seen.get


class Progress(StreamingQueryListener):
    """Rows and observed numbers by stream, added up over its batches; a batch that comes again after a failure counts once.

    ``name`` of ``df.observe(name, ...)`` in the stream says which numbers these are. For a Spark Connect session, add it to that.
    """

    def __init__(self):
        self._seen: dict[str, dict[int, dict]] = {}
        self._lock = threading.Lock()
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._seen.setdefault(str(event.id), {})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        numbers = {"rows": p.numInputRows} | {f"{name}.{k}": v for name, row in p.observedMetrics.items() for k, v in row.asDict().items() if isinstance(v, int | float)}
        with self._lock:
            batch = self._seen.setdefault(str(p.id), {}).setdefault(p.batchId, {})
            batch.update({k: max(v, batch.get(k, v)) for k, v in numbers.items()})  # a trigger without rows reports the batch before it

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.ended[str(event.id)] = event.exception

    def totals(self, query_id: str) -> dict[str, float]:
        """Sums over the batches of a stream so far."""
        out: dict[str, float] = {}
        with self._lock:
            for batch in self._seen.get(str(query_id), {}).values():
                for k, v in batch.items():
                    out[k] = out.get(k, 0) + v
        return out
