"""Conversations: pruning, statistics and histories over tables, and one live conversation."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import estimated_tokens


def with_turns(messages: DataFrame) -> DataFrame:
    """``messages`` with ``pair``: two messages after one another are one turn, whatever their roles."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return messages.withColumn("pair", F.floor((F.row_number().over(order) - 1) / 2))


def prune(messages: DataFrame, max_turns: int = 10, max_tokens: int = 2000) -> DataFrame:
    """The last turns of each conversation: at most ``max_turns``, and of those as many as fit the tokens.

    The last turn always stays. Tokens are a quarter of each message's length, rounded
    down for each message.
    """
    rows = with_turns(messages).withColumn("_tokens", estimated_tokens("text"))
    turns = rows.groupBy("conv_id", "pair").agg(F.sum("_tokens").alias("_tokens"))
    back = Window.partitionBy("conv_id").orderBy(F.desc("pair"))
    turns = turns.select("conv_id", "pair", F.row_number().over(back).alias("_n"), F.sum("_tokens").over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"))
    kept = turns.where((F.col("_n") <= max_turns) & ((F.col("_sum") <= max_tokens) | (F.col("_n") == 1))).select("conv_id", "pair")
    return rows.join(kept, ["conv_id", "pair"], "left_semi").select(*messages.columns)


def statistics(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("num_messages"), F.floor(F.count(F.lit(1)) / 2).alias("num_turns"), F.coalesce(F.sum(estimated_tokens("text")), F.lit(0)).alias("total_tokens"))


def formatted_history(messages: DataFrame) -> DataFrame:
    """``conv_id, history``: ``role: text`` lines in order."""
    line = F.concat_ws(": ", "role", F.coalesce("text", F.lit("")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return messages.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("history"))


@dataclass
class Conversation:
    """A live conversation; the same pruning rule as :func:`prune`."""

    max_turns: int = 10
    max_tokens: int = 2000
    session_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    messages: list[dict] = field(default_factory=list)

    def add_turn(self, user: str, assistant: str) -> None:
        self.messages += [{"role": "user", "content": user}, {"role": "assistant", "content": assistant}]
        kept = self.messages[-2 * self.max_turns :]
        while len(kept) > 2 and sum(len(m["content"]) // 4 for m in kept) > self.max_tokens:
            kept = kept[2:]
        self.messages = kept

    def history(self) -> list[dict]:
        return [dict(m) for m in self.messages]

    def formatted(self) -> str:
        return "\n".join(f"{m['role']}: {m['content']}" for m in self.messages)

    def clear(self) -> None:
        self.messages = []

    def stats(self) -> dict:
        return {"session_id": self.session_id, "num_messages": len(self.messages), "num_turns": len(self.messages) // 2, "total_tokens": sum(len(m["content"]) // 4 for m in self.messages)}

    def save(self, path: str | Path) -> None:
        state = {"session_id": self.session_id, "created_at": self.created_at, "max_turns": self.max_turns, "max_tokens": self.max_tokens, "messages": self.messages}
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(state, ensure_ascii=False, indent=2), encoding="utf-8")

    @staticmethod
    def load(path: str | Path) -> Conversation:
        state = json.loads(Path(path).read_text(encoding="utf-8"))
        return Conversation(state["max_turns"], state["max_tokens"], state["session_id"], state["created_at"], state["messages"])

    def rows(self, spark, conv_id: int) -> DataFrame:
        """As rows of a conversations table."""
        return spark.createDataFrame([(conv_id, i, m["role"], m["content"]) for i, m in enumerate(self.messages)], "conv_id long, turn long, role string, text string")
