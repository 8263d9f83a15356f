"""Measures of logged conversations: a JSON object per line, of no fixed schema, read as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The counters of a message's usage, and what they are called here.
COUNTERS = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_input_tokens": "cache_read_tokens", "cache_creation_input_tokens": "cache_creation_tokens"}


def messages(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds `message`, a line's JSON object as VARIANT, null where the line holds none; blank lines are left out."""
    value = F.try_parse_json(F.col(line))
    return lines.where(F.trim(F.regexp_replace(line, r"\s+", " ")) != "").withColumn("message", F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT<")), value))


def _part(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def totals(lines: DataFrame, conversation: str = "conv_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """One row per conversation: tokens by kind and in all, tool_calls, turns, wall_clock_s, malformed.

    Tokens, tool calls and turns are those of the assistant's messages; usage
    stands in the message or, where it has none or an empty one, in an inner
    `message`. Counters that aren't numbers count 0. The wall clock is the time
    from the first line with a timestamp to the last one, by `order`; 0 if one
    of them can't be read. Lines that hold no JSON object are only counted.
    """
    m = messages(lines, line)
    told, inner = _part(F.col("message"), "$.usage", "variant"), _part(F.col("message"), "$.message.usage", "variant")
    said = _part(F.col("message"), "$.timestamp", "string")
    m = m.withColumns({
        "own_": F.coalesce(_part(F.col("message"), "$.role", "string") == "assistant", F.lit(False)),
        "usage_": F.when(F.coalesce(F.to_json(told), F.lit("{}")).isin("{}", "null"), inner).otherwise(told),
        "blocks_": _part(F.col("message"), "$.content", "array<variant>"),
        "at_": F.when(said != "", F.struct(F.col(order).alias("order"), said.alias("ts"))),
    })
    uses = F.size(F.filter("blocks_", lambda b: _part(b, "$.type", "string") == "tool_use"))
    counted = lambda c: F.coalesce(F.sum(F.when(F.col("own_"), c)), F.lit(0)).cast("long")
    sums = m.groupBy(conversation).agg(
        *[counted(_part(F.col("usage_"), f"$.{key}", "bigint")).alias(name) for key, name in COUNTERS.items()],
        counted(F.when(F.col("blocks_").isNotNull(), uses)).alias("tool_calls"), F.count_if("own_").alias("turns"),
        F.min("at_")["ts"].alias("first_"), F.max("at_")["ts"].alias("last_"), F.count_if(F.col("message").isNull()).alias("malformed"),
    )
    micros = lambda c: F.unix_micros(F.try_to_timestamp(F.col(c)))
    return sums.select(
        conversation, *COUNTERS.values(), sum((F.col(c) for c in COUNTERS.values()), F.lit(0)).cast("long").alias("total_tokens"), "tool_calls", "turns",
        F.coalesce(F.round((micros("last_") - micros("first_")) / 1e6, 1), F.lit(0.0)).alias("wall_clock_s"), "malformed",
    )
