"""The review log as a stream: one state a record, updated by the same fold as the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinloom.operators import review

_STATE = "b_record_id string, decision string, reviewer string, decided_at timestamp"


def _order(b: str, d: str, r: str, at) -> tuple:
    return (pd.Timestamp("1700-01-01") if at is None or pd.isna(at) else pd.Timestamp(at), b, d, r)


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The later of the state and the new events, in the order of ``review.fold``."""
    best = state.get if state.exists else None
    for pdf in batches:
        for row in zip(pdf["b_record_id"], pdf["decision"], pdf["reviewer"], pdf["decided_at"]):
            if best is None or _order(*row) > _order(*best):
                best = tuple(None if x is None or x is pd.NaT else x for x in row)
    if best is not None:
        state.update(tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in best))
        out = pd.DataFrame([(key[0], *best)], columns=["a_record_id", "b_record_id", "decision", "reviewer", "decided_at"])
        yield out.astype({"decided_at": "datetime64[ns]"})


def latest(log: DataFrame) -> DataFrame:
    """A stream of the state of every record that an event touched (withdrawals included); output mode ``update``.

    The state lies in the state store by ``a_record_id``, so a batch costs what it holds and not what came before.
    """
    return review.events(log).groupBy("a_record_id").applyInPandasWithState(_update, review.EVENT, _STATE, "update", GroupStateTimeout.NoTimeout)


def write_latest(log: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Start-able writer of the changed states, batch by batch; ``write`` must replace rows by ``a_record_id``."""
    return latest(log).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")


def current(changes: DataFrame) -> DataFrame:
    """The standing decisions out of all changes written so far."""
    return review.fold(changes).where("decision <> 'withdraw'")


def follow_cases(opened: DataFrame, log: DataFrame, within: str = "365 days") -> DataFrame:
    """Cases (with ``opened_at``) beside the decisions on their pair as both arrive; unusable decisions change nothing.

    A case waits for a decision as long as the watermark allows: ``within`` after it was opened.
    """
    d = review.events(log.withWatermark("decided_at", within)).where("decision <> 'withdraw'").select(F.col("a_record_id").alias("_a"), F.col("b_record_id").alias("_b"), "decision", F.col("reviewer").alias("decided_by"), "decided_at")
    c = opened.drop("status").withWatermark("opened_at", within)
    met = c.join(d, F.expr(f"a_record_id = _a and b_record_id = _b and decided_at >= opened_at and decided_at <= opened_at + interval {within}"))
    return met.drop("_a", "_b").withColumn("status", F.lit("reviewed"))


def audit_to(resolved: DataFrame, path: str, checkpoint: str):
    """Append-only audit of resolved cases."""
    return review.audit(resolved).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
