"""Counters that are taken in the pass that writes, and not by reading its result again."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, whose one run (a write, as a rule) also gives the metrics: ``observation.get`` holds them once it is done."""
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen


class StreamCounters(StreamingQueryListener):
    """Adds up what streams observe under a name (``df.observe(name, ...)``), batch by batch; a batch that is repeated counts once.

    ``spark.streams.addListener(counters)`` starts it; progress arrives a little after a batch.
    """

    def __init__(self, name: str):
        self.name, self.batches, self.ended = name, defaultdict(dict), set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if (row := p.observedMetrics.get(self.name)) is not None:
            self.batches[str(p.id)][p.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))

    def totals(self, query_id: str | None = None) -> dict:
        """The sums over the batches of a query, or of all."""
        out: dict = defaultdict(int)
        for own, batches in self.batches.items():
            if query_id is None or own == str(query_id):
                for row in batches.values():
                    for k, v in row.items():
                        out[k] += v or 0
        return dict(out)
