"""A stream of keyed tasks: each batch runs those that are not done and appends their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from perkolat.sources.tables import append_new


def run_tasks(tasks: DataFrame, run: Callable[[DataFrame], DataFrame], out: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Start a stream over tasks. A batch that is replayed after a failure adds nothing twice: finished keys are left out."""

    def batch(df: DataFrame, _: int) -> None:
        append_new(run(df.dropDuplicates(keys)), out, keys)

    return tasks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
