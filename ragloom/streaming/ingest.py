"""Structured Streaming wrappers: a watched folder of documents, and a session's last messages as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MEMORY = 4


def watch(spark: SparkSession, path: str, schema: str, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """New Parquet files of a folder go through `step` in micro-batches; a batch is repeated whole after a failure."""
    stream = spark.readStream.schema(schema).parquet(path)
    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def conversation_memory(messages: DataFrame, size: int = MEMORY) -> DataFrame:
    """session_id, turn, memory: the last `size` messages before each message. messages: session_id, turn, role, text."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for b in batches:
            out = []
            for _, turn, role, text in b.sort_values("turn")[["session_id", "turn", "role", "text"]].itertuples(index=False):
                out.append((key[0], turn, "\n".join(held)))
                held = [*held, f"{role}: {text}"][-size:]
            yield pd.DataFrame(out, columns=["session_id", "turn", "memory"])
        state.update((held,))

    return messages.groupBy("session_id").applyInPandasWithState(run, "session_id long, turn long, memory string", "held array<string>", "append", GroupStateTimeout.NoTimeout)
