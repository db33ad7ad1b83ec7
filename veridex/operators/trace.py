"""Conversation traces and memory: span trees, token usage, turns, pruning and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = "type string, _timestamp long, span_id string, parent_span_id string, turn long, session_id string, name string, arguments string, result string, user string, finish_reason string, usage struct<input_tokens:long,output_tokens:long>"


def read_trace(spark, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def span_tree(events: DataFrame, depth: int = 8) -> DataFrame:
    """events with depth (0 for roots; null beyond `depth` levels or in a cycle) and n_children. Events are session > turn > inference > tool, so few levels do."""
    spans = events.select("span_id", "parent_span_id").where("span_id is not null").distinct()
    level = spans.join(spans.select(F.col("span_id").alias("parent_span_id")), "parent_span_id", "left_anti").select("span_id", F.lit(0).alias("depth"))
    every = level
    for k in range(1, depth + 1):
        level = spans.join(level.select(F.col("span_id").alias("parent_span_id")), "parent_span_id").select("span_id", F.lit(k).alias("depth"))
        every = every.union(level)
    children = spans.groupBy(F.col("parent_span_id").alias("span_id")).agg(F.count("*").alias("n_children"))
    return events.join(every, "span_id", "left").join(children, "span_id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one for a text that isn't empty."""
    return F.ceil(F.length(text) / 4).cast("long")


def usage(reported: Column, text: Column, mode: str = "hybrid") -> Column:
    """Tokens as the service reported them ('api'), as estimated, or reported where there is a report ('hybrid')."""
    if mode not in ("api", "estimate", "hybrid"):
        raise ValueError(f"no mode {mode}")
    return reported if mode == "api" else estimated_tokens(text) if mode == "estimate" else F.coalesce(reported, estimated_tokens(text))


def with_turns(messages: DataFrame, conversation: str = "conv_id", position: str = "turn", injected: str | None = None) -> DataFrame:
    """Adds user_turn: how many real user messages came up to each message; injected names a flag of messages that no user wrote."""
    real = F.col("role") == "user"
    if injected:
        real = real & ~F.coalesce(F.col(injected), F.lit(False))
    w = Window.partitionBy(conversation).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("user_turn", F.sum(real.cast("long")).over(w))


def keep_zone(messages: DataFrame, k: int, conversation: str = "conv_id", position: str = "turn") -> DataFrame:
    """Adds kept: whether a message lies in its conversation's last k user turns."""
    return with_turns(messages, conversation, position).withColumn("kept", F.col("user_turn") > F.max("user_turn").over(Window.partitionBy(conversation)) - k)


def clear_results(messages: DataFrame, k: int, role: str = "tool", name: str = "name", conversation: str = "conv_id", position: str = "turn") -> DataFrame:
    """messages with those of a role before the last k user turns cleared to a marker with the tool's name; cleared tells which."""
    out = keep_zone(messages, k, conversation, position).withColumn("cleared", ~F.col("kept") & (F.col("role") == role))
    marker = F.concat(F.lit("[cleared: "), F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit("]"))
    return out.withColumn("text", F.when(F.col("cleared"), marker).otherwise(F.col("text")))


def within_budget(messages: DataFrame, tokens: int, conversation: str = "conv_id", position: str = "turn") -> DataFrame:
    """The newest user turns of each conversation whose estimated tokens fit the budget; system messages count and stay, and so does the last turn. A turn goes as a whole, so no answer loses its question."""
    turned = with_turns(messages, conversation, position).withColumn("tokens", F.coalesce(estimated_tokens(F.col("text")), F.lit(0)))
    system = F.col("role") == "system"
    fixed = F.sum(F.when(system, F.col("tokens")).otherwise(0)).over(Window.partitionBy(conversation))
    rest = F.when(system, 0).otherwise(F.col("tokens"))
    after = F.sum(rest).over(Window.partitionBy(conversation).orderBy(F.desc("user_turn")).rangeBetween(Window.unboundedPreceding, 0))
    last = F.max("user_turn").over(Window.partitionBy(conversation))
    marked = turned.withColumns({"_fixed": fixed, "_after": after, "_last": last})
    return marked.where(system | (F.col("user_turn") == F.col("_last")) | (F.col("_fixed") + F.col("_after") <= tokens)).drop("_fixed", "_after", "_last")


def last_messages(messages: DataFrame, n: int = 300, conversation: str = "conv_id", position: str = "turn") -> DataFrame:
    """The newest n messages of each conversation, from the first that isn't a tool's, so that no tool result lacks its call."""
    newest = Window.partitionBy(conversation).orderBy(F.desc(position))
    kept = messages.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n)
    begun = F.max((F.col("role") != "tool").cast("int")).over(Window.partitionBy(conversation).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("_b", begun).where("_b = 1").drop("_r", "_b")
