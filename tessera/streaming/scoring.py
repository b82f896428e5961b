"""Batch scoring applied to a stream.

Scoring is stateless (``PipelineModel.transform``), so the same validated
model scores a Structured Streaming source: each micro-batch is checked
(names, numeric finiteness, reserved marker) and scored on executors, and
each micro-batch lands in its own ``batch_id=`` folder (idempotent on
replay) under a stream checkpoint.  This is the
batch scoring operator reused per micro-batch, not a stream-specific model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.artifacts import Artifact
from ..plans.scoring import score_table


def score_stream(
    artifact: Artifact,
    stream: DataFrame,
    *,
    key: list[str],
    output_path: str,
    checkpoint_location: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Score every micro-batch of ``stream`` into parquet at ``output_path``."""

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        # One folder per micro-batch, overwritten on replay: a batch retried
        # after a failure replaces its own output instead of duplicating it.
        if batch.isEmpty():
            return
        # Checked in the pass that scores it; a refused batch leaves no folder.
        score_table(artifact, batch, f"{output_path}/batch_id={batch_id}", key=key, replace=True)

    writer = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
