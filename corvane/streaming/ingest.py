"""Streaming: folders that are indexed as files arrive, and conversations kept up to date."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..collection import Collection
from ..sources import files


def index_stream(collection: Collection, path: str, checkpoint: str, formats: tuple[str, ...] = ("txt", "markdown"), max_files: int = 1000, once: bool = True):
    """Starts a query that adds each batch of new files to the collection.

    Adding is idempotent: a batch that runs again after a failure changes nothing, so
    each file counts exactly once. With ``once`` it stops when all files are in.
    """
    stream = files.stream_directory(collection.spark, path, formats, max_files)

    def add(batch: DataFrame, number: int) -> None:
        # Folders are read to any depth, so ids hold a hash of the path.
        docs = files.extract(batch.select("path", "content"), unique_ids=True)
        collection.add_documents(docs.where("error is null"))

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour", at: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by event-time window and key, closed by a watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), key, "n", "total")


def live_history(messages: DataFrame, max_turns: int = 10, max_tokens: int = 2000) -> DataFrame:
    """A stream of messages with each conversation's pruned history after every batch.

    The state of a conversation is its pruned history, which is bounded by
    ``max_turns`` pairs; the messages of one conversation in one batch are held
    together. ``conv_id, num_messages, history``.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, parts, state: GroupState):
        roles, texts = (list(x) for x in state.get) if state.exists else ([], [])
        # What came for a conversation in one batch is put in order as a whole, over all parts that Spark hands on.
        for r in pd.concat(list(parts)).sort_values("turn", kind="stable").itertuples():
            roles.append(r.role)
            texts.append(r.text or "")
        # Pairs are counted from the front, so whole pairs go.
        while len(texts) > 2 * max_turns or len(texts) > 2 and sum(len(t) // 4 for t in texts) > max_tokens:
            roles, texts = roles[2:], texts[2:]
        state.update((roles, texts))
        yield pd.DataFrame([(key[0], len(texts), "\n".join(f"{a}: {b}" for a, b in zip(roles, texts, strict=True)))], columns=["conv_id", "num_messages", "history"])

    return messages.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, num_messages long, history string", "roles array<string>, texts array<string>", "update", GroupStateTimeout.NoTimeout)
