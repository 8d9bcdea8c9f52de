"""Incremental indexing of a stream of files; an extension of the batch refresh."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators import incremental as N


def index_stream(arrivals: DataFrame, store: N.Store, parse, schema, checkpoint: str, **trigger):
    """Apply each micro-batch of (path, source) to the store; the last text of a path counts.

    A path missing from a batch stays; batches replayed after a failure change nothing,
    as entries are keyed by content.
    """

    def apply(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("source", "at").alias("source")) if "at" in batch.columns else batch.dropDuplicates(["path"])
        current, old = N.with_hash(last), store.load(schema)
        new = N.misses(current, old)
        if new.isEmpty():
            return
        kept = old.join(current.select("path"), "path", "left_anti").unionByName(old.join(current.select(*N.KEY), N.KEY, "left_semi"))
        store.publish(kept.select(*[f.name for f in schema]).unionByName(parse(new).select(*[f.name for f in schema])))

    return arrivals.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_budget(events: DataFrame, budget: float) -> DataFrame:
    """(user_id, spent, left, admitted) per user and batch: arbitrary state by user.

    events: streaming (user_id, value). A value that doesn't fit what is left is passed over.
    """

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, admitted = (state.get if state.exists else (0.0, 0))
        for batch in batches:
            for v in batch["value"]:
                if spent + v <= budget:
                    spent, admitted = spent + float(v), admitted + 1
        state.update((spent, admitted))
        yield pd.DataFrame({"user_id": [key[0]], "spent": [spent], "left": [budget - spent], "admitted": [admitted]})

    return events.groupBy("user_id").applyInPandasWithState(
        fold, "user_id bigint, spent double, left double, admitted bigint", "spent double, admitted bigint", "update", GroupStateTimeout.NoTimeout)
