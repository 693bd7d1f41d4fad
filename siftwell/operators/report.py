"""Masks, counters and renderings. Nothing here shows a raw value."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "0.1.0"


def mask(value: Column) -> Column:
    """Enough to recognise a value's kind, too little to use it."""
    v = F.regexp_replace(value, "(?U)^\\s+|\\s+$", "")
    n = F.length(v)
    shown = F.concat(F.substring(v, F.lit(1), F.when(n >= 16, 4).otherwise(2)), F.lit("…****("), n.cast("string"), F.lit(" chars)"))
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(shown)


def published(findings: DataFrame) -> DataFrame:
    """Findings with ``masked`` in place of ``value``."""
    return findings.withColumn("masked", mask(F.col("value"))).drop("value")


def summary(findings: DataFrame, *by: str) -> DataFrame:
    """Number of findings by category, rule and further columns."""
    return findings.groupBy(*by, "category", "rule").agg(F.count("*").alias("n_findings"))


def totals(findings: DataFrame) -> DataFrame:
    """Findings by category and rule with subtotals (null: all)."""
    return findings.rollup("category", "rule").agg(F.count("*").alias("n_findings"))


def recall(corpus: DataFrame, findings: DataFrame) -> DataFrame:
    """Entries and hits by category of ``corpus(idx, category, ...)``; an entry is hit if any of its lines is.

    In a category of clean entries the hits are false alarms.
    """
    hit = findings.select("idx").distinct().withColumn("_hit", F.lit(1))
    return corpus.select("idx", "category").join(hit, "idx", "left").groupBy("category").agg(F.count("*").alias("n_entries"), F.count("_hit").alias("n_hit"))


def _where(path: str = "path", where: str = "where") -> Column:
    shown = F.when(F.coalesce(F.col(path), F.lit("")) == "", "<stdin>").otherwise(F.col(path))
    inner = F.when(F.coalesce(F.col(where), F.lit("")) != "", F.concat(F.lit(" ["), F.col(where), F.lit("]"))).otherwise("")
    return F.concat(shown, inner)


def text_lines(findings: DataFrame) -> DataFrame:
    """One report line per published finding, in ``report``."""
    place = F.concat_ws(":", _where(), F.col("line"), F.col("start") + 1)
    line = F.concat(place, F.lit("  "), F.rpad("category", 6, " "), F.lit(" "), F.rpad("rule", 28, " "), F.lit(" "), F.col("masked"))
    return findings.select("path", "where", "line", "start", line.alias("report"))


def json_lines(findings: DataFrame) -> DataFrame:
    """One JSON object per published finding, in ``report``."""
    names = [c for c in ("category", "rule", "line", "start", "end", "engine", "path", "where", "masked") if c in findings.columns]
    return findings.select("path", "where", "line", "start", F.to_json(F.struct(*names)).alias("report"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 result per published finding, in ``report``."""
    inner = F.when(F.coalesce(F.col("where"), F.lit("")) != "", F.concat(F.lit(" in "), F.col("where"))).otherwise("")
    message = F.concat("category", F.lit(": "), "rule", F.lit(" ("), "masked", F.lit(")"), inner)
    uri = F.replace(F.when(F.coalesce(F.col("path"), F.lit("")) == "", "stdin").otherwise(F.col("path")), F.lit("\\"), F.lit("/"))
    region = F.struct(F.col("line").alias("startLine"), (F.col("start") + 1).alias("startColumn"), (F.col("end") + 1).alias("endColumn"))
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), F.when(F.col("category") == "secret", "error").otherwise("warning").alias("level"), F.struct(message.alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("path", "where", "line", "start", F.to_json(result).alias("report"))


def render(findings: DataFrame, fmt: str, files: int = 0, notes: tuple[str, ...] = (), unscanned: tuple[tuple[str, str], ...] = (), images: int = 0) -> str:
    """A whole report as one string, for the command line (findings come to the driver)."""
    shown = published(findings)
    kinds = {"text": text_lines, "json": json_lines, "sarif": sarif_results}
    rows = [r["report"] for r in kinds[fmt](shown).orderBy("path", "where", "line", "start").collect()]
    if fmt == "text":
        counts = summary(shown).groupBy("category").agg(F.sum("n_findings").alias("n")).orderBy("category").collect()
        told = ", ".join(f"{r['category']} {r['n']}" for r in counts) or "clean"
        rows.append(f"\n{len(rows)} finding(s) in {files} file(s): {told}")
        rows += [f"note: engine unavailable: {n}" for n in notes] + [f"UNSCANNED: {p}: {why}" for p, why in unscanned]
        return "\n".join(rows + ([f"note: {images} image(s) not read"] if images else []))
    items = [json.loads(r) for r in rows]
    if fmt == "json":
        head = {"version": VERSION, "files_scanned": files, "unavailable_engines": list(notes), "unscanned": [dict(path=p, reason=w) for p, w in unscanned], "images_skipped": images}
        return json.dumps(head | {"findings": items}, ensure_ascii=False, indent=1)
    driver = {"name": "siftwell", "version": VERSION, "rules": [{"id": r} for r in sorted({i["ruleId"] for i in items})]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": items}]}, indent=1)
