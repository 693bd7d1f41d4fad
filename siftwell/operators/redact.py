"""Redaction: findings replaced in their texts, line ends and JSON kept."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.spans import end_length, plain_building
from siftwell.model import ALLOW_MARK, Config
from siftwell.operators.scan import _SPAN, all_spans, may_hold, settle
from siftwell.plans.catalog import rules
from siftwell.plans.fixed import INFRA_TAGS


class UnsafeRedaction(RuntimeError):
    """A span no longer holds its value, or JSON would break."""


def replacement(category: Column, rule: Column) -> Column:
    """What stands for a finding."""
    short = F.element_at(F.split(rule, ":"), -1)
    infra = F.lit("<INFRA>")
    for name, tag in INFRA_TAGS.items():
        infra = F.when(rule == name, tag).otherwise(infra)
    return (
        F.when(category == "secret", F.concat(F.lit("[REDACTED:"), short, F.lit("]")))
        .when(category == "pii", F.concat(F.lit("[PII:"), short, F.lit("]")))
        .when(category == "custom", "[PRIVATE]")
        .when(category == "infra", infra)
        .otherwise("[REDACTED]")
    )


def replace_spans(line: Column, spans: Column) -> Column:
    """A line with its (disjoint) spans replaced, right to left."""
    back = F.reverse(F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"), s["rule"].alias("rule")))))
    return F.aggregate(back, line, lambda text, s: F.concat(F.substring(text, F.lit(1), s["start"]), replacement(s["category"], s["rule"]), F.substring(text, s["end"] + 1, F.length(text))))


@plain_building()
def redact(segments: DataFrame, config: Config = Config(), text: str = "text") -> DataFrame:
    """``segments`` with ``text`` redacted and ``n_redacted`` added: no shuffle, one row in, one out.

    Null texts stay null. Lines with the allow mark stay as they are. Line ends are kept.
    """
    active = rules(config)
    # A line end is cut off behind its line: split in front of nothing, after an end.
    cut = F.split(F.coalesce(F.col(text), F.lit("")), f"(?<=\\r\\n)|(?<=[\\n\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029])|(?<=\\r)(?!\\n)")

    none = F.array().cast(f"array<{_SPAN}>")

    # Each step binds what the next one names many times.
    def parted(raw: Column) -> Column:
        n = F.length(raw) - end_length(raw)
        line = F.substring(raw, F.lit(1), n)
        return F.struct(line.alias("line"), F.lower(line).alias("low"), F.substring(raw, n + 1, F.lit(2)).alias("end"))

    def found(x: Column) -> Column:
        line = x["line"]
        closed = line.contains(ALLOW_MARK) | ~may_hold(line, active)
        spans = F.when(closed, none).otherwise(settle(all_spans(line, x["low"], active, config.allow)))
        return F.struct(line.alias("line"), x["end"].alias("end"), spans.alias("spans"))

    def replaced(x: Column) -> Column:
        return F.struct(F.concat(replace_spans(x["line"], x["spans"]), x["end"]).alias("text"), F.size(x["spans"]).alias("n"))

    lines = F.transform(F.transform(F.transform(cut, parted), found), replaced) if active else F.transform(cut, lambda x: F.struct(x.alias("text"), F.lit(0).alias("n")))
    rest = [c for c in segments.columns if c != text]
    done = segments.withColumn("_lines", lines)
    new = F.when(F.col(text).isNotNull(), F.array_join(F.col("_lines.text"), ""))
    return done.select(*[F.col(f"`{c}`") for c in rest], new.alias(text), F.aggregate(F.col("_lines.n"), F.lit(0), lambda a, b: a + b).alias("n_redacted"))


def redact_with(segments: DataFrame, findings: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Apply given ``findings(<key>, start, end, value, category, rule)`` to single-line texts.

    ``stale`` tells rows in which a span no longer holds its value; they stay as they are.
    """
    spans = findings.groupBy(key).agg(F.collect_list(F.struct("start", "end", "value", "category", "rule")).alias("_spans"))
    met = segments.join(spans, key, "left")
    none = F.array().cast("array<struct<start:int,end:int,value:string,category:string,rule:string>>")
    own = F.coalesce(F.col("_spans"), none)
    stale = F.exists(own, lambda s: F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"]) != s["value"])
    return met.withColumn("stale", stale).withColumn(text, F.when(F.col("stale"), F.col(text)).otherwise(replace_spans(F.col(text), own))).drop("_spans")


def _parses(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def json_guard(pairs: DataFrame, before: str = "before", after: str = "after", per_line: bool = True) -> DataFrame:
    """Adds ``safe``: every line (or the whole) of ``before`` that is JSON still is in ``after``.

    JSON is what Python's parser takes, which is neither Spark's nor the standard's idea.
    """

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = []
            for old, new in zip(frame[before], frame[after], strict=True):
                olds, news = ((old or "").splitlines(), (new or "").splitlines()) if per_line else ([old or ""], [new or ""])
                told.append(all(k < len(news) and (a == news[k] or not _parses(a) or _parses(news[k])) for k, a in enumerate(olds)))
            yield frame.assign(safe=told)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(judge, f"{names}, safe boolean")
