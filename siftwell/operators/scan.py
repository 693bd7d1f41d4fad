"""The scan: segments to lines to findings, without a shuffle.

All rules of a line yield one array; overlaps are settled inside the row; the array
is unfolded last. Lines that no gate lets through are dropped before any pattern.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.checks import placeholder
from siftwell.functions.spans import find_all, lines, plain_building
from siftwell.model import ALLOW_MARK, PRIORITY, Config
from siftwell.plans.catalog import MARKS, Rule, rules

_SPAN = "struct<priority:int,shorter:int,ord:int,start:int,end:int,category:string,rule:string,value:string>"
_FOUND = _SPAN[:-1] + ",context:string>"
#: The column of a line's lower case.
_LOW = "_line_in_lower_case"


_CHARS = "(?:[^\\\\\\[\\](){}|?*+.^$]|\\[[^\\]\\\\^-]\\])+"
_LITERALS = re.compile(f"{_CHARS}(?:[|]{_CHARS})*")


def _literals(gate: str) -> set[str]:
    """The alternatives of a gate without regular operators; none of any other gate."""
    return {re.sub(r"\[(.)\]", r"\1", x) for x in gate.split("|")} if _LITERALS.fullmatch(gate) else set()


def _passes(line: Column, low: Column, gate: str) -> Column:
    """Whether a line, whose lower case is ``low``, may hold a match."""
    anyhow = gate.startswith("(?i)")
    literals = sorted(_literals(gate[4:] if anyhow else gate))
    if not literals:
        return line.rlike(gate)
    return reduce(lambda a, b: a | b, (low.contains(x.lower()) if anyhow else line.contains(x) for x in literals))


@lru_cache(maxsize=64)
def _gateway(gates: frozenset[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Literals and patterns, one of which is in every line that one of the gates lets through.

    Searching a literal reads a line's bytes as they are; every pattern decodes the line
    anew. So alternatives without a regular operator are searched as literals, those in
    any case by one pattern, and all else by another; what contains another literal goes.
    """
    exact: set[str] = set()
    loose: set[str] = set()
    other: set[str] = set()
    for gate in gates:
        if gate.startswith("(?i)"):
            loose |= set(gate[4:].split("|")) if _literals(gate[4:]) else {gate[4:]}
        elif literals := _literals(gate):
            exact |= literals
        else:
            other.add(gate)
    exact = {x for x in exact if not any(y != x and y in x for y in exact)}
    loose = {x for x in loose if not any(y != x and y.lower() in x.lower() for y in loose)}
    if "[0-9]" in other:
        other = {x for x in other if x == "[0-9]" or not x.startswith("[0-9]")}
        exact = {x for x in exact if not re.search("[0-9]", x)}
    patterns = ["|".join(sorted(other))] * bool(other) + ["(?i)" + "|".join(sorted(loose))] * bool(loose)
    return tuple(sorted(exact)), tuple(patterns)


def may_hold(line: Column, active: list[Rule]) -> Column:
    """False only for lines that no rule's gate lets through, or that no match can lie in.

    Most prose holds none of MARKS and no gate of the few rules that need none.
    """
    if not all(r.gate for r in active):
        return F.lit(True)

    def any_of(gates: frozenset[str], *more: str) -> Column:
        literals, patterns = _gateway(gates)
        return reduce(lambda a, b: a | b, [*(line.rlike(p) for p in (*more, *patterns)), *(line.contains(x) for x in literals)], F.lit(False))

    return any_of(frozenset(r.gate for r in active if r.free), *MARKS) & any_of(frozenset(r.gate for r in active))


def explode_lines(segments: DataFrame, text: str = "text") -> DataFrame:
    """``segments`` with ``text`` replaced by ``line`` (from 1) and ``line_text``."""
    rest = [F.col(f"`{c}`") for c in segments.columns if c != text]
    return segments.select(*rest, F.posexplode(lines(F.col(text))).alias("_at", "line_text")).withColumn("line", F.col("_at") + 1).drop("_at")


def _spans(rule: Rule, order: int, line: Column, low: Column) -> Column:
    found = find_all(line, rule.pattern)
    if rule.check:
        found = F.filter(found, lambda s: rule.check(line, s))
    priority = PRIORITY[rule.category] if rule.priority is None else rule.priority

    def told(s: Column) -> Column:
        value = rule.narrow(s["value"]) if rule.narrow else s["value"]
        if rule.name == "onedrive-tenant":
            value = F.trim(value)
        n = F.length(value)
        return F.struct(
            F.lit(priority).alias("priority"), (-n).alias("shorter"), F.lit(order).alias("ord"), s["start"].alias("start"), (s["start"] + n).alias("end"),
            F.lit(rule.category).alias("category"), F.lit(rule.name).alias("rule"), value.alias("value"),
            (F.substring(line, s["from"] + 1, s["to"] - s["from"] + 1) if rule.opaque else F.lit(None).cast("string")).alias("context"),
        )

    out = F.filter(F.transform(found, told), lambda s: s["value"] != "")
    none = F.array().cast(f"array<{_FOUND}>")
    return F.when(_passes(line, low, rule.gate), out).otherwise(none) if rule.gate else out


@plain_building()
def all_spans(line: Column, low: Column, active: list[Rule], allow: tuple[str, ...] = ()) -> Column:
    """The spans of all rules in a line, whose lower case is ``low``, before overlaps are settled.

    Placeholders and the allowlist are judged once for all rules, which keeps the plan small.
    """

    def stays(s: Column) -> Column:
        out = s["context"].isNull() | ~placeholder(s["value"], s["context"])
        for regex in allow:
            out &= ~s["value"].rlike(regex)
        return out

    found = F.filter(F.flatten(F.array(*[_spans(r, k, line, low) for k, r in enumerate(active)])), stays)
    return F.transform(found, lambda s: s.dropFields("context"))


@lru_cache(maxsize=64)
def _spans_of(line: str, active: tuple[Rule, ...], allow: tuple[str, ...], gateway: int) -> Column:
    """The expression over a named column; building one takes longer than planning with it."""
    return all_spans(F.col(line), F.col(_LOW), list(active), allow)


def settle(spans: Column, kind: str = _SPAN) -> Column:
    """Spans that stay: in order of priority, length and rule, each that meets none kept before."""
    zero = F.array().cast(f"array<{kind}>")
    meets = lambda kept, s: F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
    return F.aggregate(F.sort_array(spans), zero, lambda kept, s: F.when(meets(kept, s), kept).otherwise(F.concat(kept, F.array(s))))


@plain_building()
def scan_lines(df: DataFrame, config: Config = Config(), line: str = "line_text") -> DataFrame:
    """Findings of a table with one line of text per row; its other columns are kept."""
    active = rules(config)
    text = F.col(line)
    rest = [F.col(f"`{c}`") for c in df.columns if c != line]
    if not active:
        return df.select(*rest, *[F.lit(None).cast(t).alias(n) for n, t in (("start", "int"), ("end", "int"), ("category", "string"), ("rule", "string"), ("value", "string"))]).where("false")
    open_ = df.where(~text.contains(ALLOW_MARK))
    open_ = open_.where(may_hold(text, active))
    found = _spans_of(line, tuple(active), config.allow, id(SparkContext._gateway))
    # A filter on the spans would be pushed below them and compute them twice.
    met = open_.select(*rest, text, F.lower(text).alias(_LOW)).select(*rest, found.alias("_spans"))
    out = met.select(*rest, F.explode(settle(F.col("_spans"))).alias("_s"))
    return out.select(*rest, *[F.col(f"_s.{c}").alias(c) for c in ("start", "end", "category", "rule", "value")])


def scan(segments: DataFrame, config: Config = Config()) -> DataFrame:
    """Findings of ``segments(text, ...)``: its other columns, line, start, end, category, rule, value, engine.

    Null texts have no lines. ``value`` is raw: publish with :func:`siftwell.operators.report.published`.
    """
    return scan_lines(explode_lines(segments), config).withColumn("engine", F.lit("builtin"))


_MERGED = _SPAN[:-1] + ",engine:string>"


def merge(*findings: DataFrame) -> DataFrame:
    """Findings of several detectors with overlaps settled per line; on a tie the earlier one stays.

    Groups are single lines, so none grows with the corpus.
    """
    rows = reduce(DataFrame.unionByName, (f.select("path", "where", "line", "start", "end", "category", "rule", "value", "engine", F.lit(k).alias("ord")) for k, f in enumerate(findings)))
    priority = F.when(F.col("rule") == "known-value", 0)
    for name, p in PRIORITY.items():
        priority = priority.when(F.col("category") == name, p)
    span = F.struct(priority.otherwise(9).alias("priority"), (F.col("start") - F.col("end")).alias("shorter"), "ord", "start", "end", "category", "rule", "value", "engine").cast(_MERGED)
    kept = rows.groupBy("path", "where", "line").agg(F.collect_list(span).alias("_s")).select("path", "where", "line", F.explode(settle(F.col("_s"), _MERGED)).alias("_s"))
    return kept.select("path", "where", "line", *[F.col(f"_s.{c}").alias(c) for c in ("start", "end", "category", "rule", "value", "engine")])
