"""Context-window usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.js import field, is_object, text_at
from seslog.functions.memo import build_once
from seslog.operators.timing import half_up

# Where token records keep usage, and under which names.
LIMIT_PLACES = (
    "total_token_usage", "totalTokenUsage", "last_token_usage", "lastTokenUsage", "context_usage", "contextUsage", "usage",
    "token_usage", "tokenUsage", "context",
)
USED_PLACES = (
    "last_token_usage", "lastTokenUsage", "context_usage", "contextUsage", "usage", "token_usage", "tokenUsage", "context",
)
PERCENT_KEYS = (
    "context_percent", "contextPercent", "context_usage_percent", "contextUsagePercent", "context_window_percent",
    "contextWindowPercent", "percent", "percentage",
)
DIRECT_USED_KEYS = ("context_used", "contextUsed")
USED_KEYS = (
    "context_used", "contextUsed", "used_tokens", "usedTokens", "tokens_used", "tokensUsed", "total_tokens", "totalTokens",
    "tokens",
)
INPUT_KEYS = ("input_tokens", "inputTokens", "prompt_tokens", "promptTokens")
OUTPUT_KEYS = ("output_tokens", "outputTokens", "completion_tokens", "completionTokens")
LIMIT_KEYS = (
    "context_window", "contextWindow", "context_window_tokens", "contextWindowTokens", "max_context", "maxContext",
    "max_context_tokens", "maxContextTokens", "model_context_window", "modelContextWindow", "context_length",
    "contextLength", "token_limit", "tokenLimit", "max_tokens", "maxTokens",
)


def numeric(text: Column) -> Column:
    """Number of a text that may carry thousands separators; booleans are 0 or 1."""
    return F.when(text == "true", 1.0).when(text == "false", 0.0).when(
        text != "", F.replace(text, F.lit(","), F.lit("")).try_cast("double")
    )


def _first_number(source: Column, keys) -> Column:
    return F.coalesce(*[numeric(text_at(source, k)) for k in keys])


def clamp_percent(percent: Column) -> Column:
    """Whole percent in 1..100."""
    return F.when(percent <= 0, 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(100.0), F.floor(percent + 0.5).cast("double"))))


def percent_of(percent: Column, used: Column, limit: Column) -> Column:
    """A direct percentage (a value in (0, 1] is a fraction), else used / limit."""
    direct = F.when((percent > 0) & (percent <= 1), percent * 100).otherwise(percent)
    return F.when(percent.isNotNull(), clamp_percent(direct)).when(limit > 0, clamp_percent(used / limit * 100))


def context_usage(info: Column) -> Column:
    """struct(percent, used, limit) of a token record's info object; NULL without a usable percentage."""
    nested = lambda places: [field(info, p) for p in places]
    objects = lambda values: F.filter(F.array_compact(F.array(*values)), is_object)
    info_sources = objects([info, *nested(LIMIT_PLACES)])
    usage_sources = objects([*nested(USED_PLACES), info, *nested(LIMIT_PLACES[:2])])
    pick = lambda sources, keys: F.get(F.array_compact(F.transform(sources, lambda s: _first_number(s, keys))), 0)

    def in_out(source: Column) -> Column:
        given, made = numeric(F.coalesce(*[text_at(source, k) for k in INPUT_KEYS])), numeric(
            F.coalesce(*[text_at(source, k) for k in OUTPUT_KEYS]))
        return F.when(given.isNotNull() | made.isNotNull(), F.coalesce(given, F.lit(0.0)) + F.coalesce(made, F.lit(0.0)))

    totals = F.get(F.array_compact(F.transform(usage_sources, in_out)), 0)
    used = F.coalesce(pick(info_sources, DIRECT_USED_KEYS), pick(usage_sources, USED_KEYS), totals)
    limit = pick(info_sources, LIMIT_KEYS)
    percent = percent_of(pick(info_sources, PERCENT_KEYS), used, limit)
    whole = lambda v: F.floor(v + 0.5).cast("bigint")
    return F.when(percent.isNotNull(), F.struct(percent.alias("percent"), whole(used).alias("used"), whole(limit).alias("limit")))


@build_once
def payload_context_usage() -> Column:
    return F.when(F.col("payload_type") == "token_count", context_usage(field(F.col("payload"), "info")))


def model_window_usage(rows: DataFrame, windows: DataFrame, tokens: str) -> DataFrame:
    """Percent of the model's window used, one decimal, at most 100; NULL without a positive window.

    The dimension is small in practice, but its size is not known here: Spark broadcasts it only below its own
    threshold and shuffles it otherwise.
    """
    joined = rows.join(windows, "model", "left")
    limit = F.nullif(F.greatest(half_up(F.col("context_window")), F.lit(0)), F.lit(0))
    percent = F.least(F.lit(100.0), half_up(F.col(tokens) / limit * 100, 1))
    return joined.withColumn("percent", F.when(limit.isNotNull() & F.col(tokens).isNotNull(), percent))
