"""The engine: one object that plans scans, redactions, summaries and reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.model import ALLOW_MARK, Config
from siftwell.operators import report
from siftwell.operators.redact import redact
from siftwell.operators.scan import explode_lines, merge, scan, scan_lines
from siftwell.sources import engines, files, history

COLUMNS = ("path", "where", "line", "start", "end", "category", "rule", "value", "engine")


@dataclass
class Scanned:
    """Findings, files that could not be read (``path, reason``), images that were not, and the number of files."""

    findings: DataFrame
    unscanned: DataFrame
    images: DataFrame
    files: int


class Engine:
    """Plans over DataFrames of ``(path, where, text)`` segments."""

    def __init__(self, spark: SparkSession, config: Config = Config(), ocr: bool = False):
        self.spark, self.config, self.ocr = spark, config, ocr
        self.unavailable = engines.missing(config.engines)

    @property
    def _there(self) -> list[str]:
        return [e for e in self.config.engines if e not in self.unavailable]

    def _told(self, segments: DataFrame) -> DataFrame:
        """What further engines find, without marked lines and allowed values."""
        more = reduce(DataFrame.unionByName, (engines.scan_with(e, segments) for e in self._there))
        marked = explode_lines(segments).where(F.col("line_text").contains(ALLOW_MARK)).select("path", "where", "line")
        more = more.join(marked, ["path", "where", "line"], "left_anti")
        for regex in self.config.allow:
            more = more.where(~F.col("value").rlike(regex))
        return more

    def scan(self, segments: DataFrame) -> DataFrame:
        found = scan(segments, self.config)
        return merge(found, self._told(segments)) if self._there else found

    def _scan_added(self, lines: DataFrame) -> DataFrame:
        """Findings in added lines; further engines read a commit's lines of a file as one text."""
        found = scan_lines(lines, self.config).withColumn("engine", F.lit("builtin"))
        if not self._there:
            return found
        texts, numbers = history.joined(lines)
        told = self._told(texts).join(numbers, ["path", "where"]).withColumn("line", F.element_at("numbers", F.col("line"))).drop("numbers")
        return merge(found, told)

    def redact(self, segments: DataFrame) -> DataFrame:
        return redact(segments, self.config)

    def scan_text(self, text: str, path: str = "", where: str = "") -> DataFrame:
        return self.scan(self.spark.createDataFrame([(path, where, text)], "path string, where string, text string")).select(*COLUMNS)

    def scan_paths(self, targets: list[str]) -> Scanned:
        """Findings in files and folders."""
        found = reduce(DataFrame.unionByName, (files.files(self.spark, t, self.config.exclude) for t in targets))
        parts = files.container_parts(found, self.ocr)
        plain = files.text_segments(found)
        segments = plain.unionByName(parts.where("text is not null").select("path", "where", "text"))
        findings = self.scan(segments).select(*COLUMNS)
        if "pii" in self.config.categories:
            findings = merge(findings, files.document_authors(parts))
        images = files.images(found).limit(0) if self.ocr else files.images(found)
        n = plain.select("path").unionByName(parts.select("path").distinct()).count()
        return Scanned(findings, parts.where("reason is not null").select("path", "reason"), images, n)

    def scan_history(self, repo: str, rev: str | None = None) -> Scanned:
        """Findings in what the commits of a repository added."""
        lines = history.added_lines(self.spark, repo, rev)
        shown = lambda df: df.withColumn("path", F.concat(F.lit(repo.rstrip("/") + "/"), "path"))
        found = shown(self._scan_added(history.history_segments(lines))).select(*COLUMNS)
        parts = shown(history.document_parts(self.spark, repo, rev, ocr=self.ocr))
        told = self.scan(parts.where("text is not null").select("path", "where", "text")).select(*COLUMNS)
        n = lines.select("commit", "path").distinct().count()
        return Scanned(found.unionByName(told), parts.where("reason is not null").select("path", "reason"), lines.select("path").limit(0), n)

    def summary(self, segments: DataFrame) -> DataFrame:
        return report.summary(self.scan(segments))

    def report(self, scanned: Scanned, fmt: str = "text") -> str:
        unscanned = tuple((r["path"], r["reason"]) for r in scanned.unscanned.orderBy("path").collect())
        return report.render(scanned.findings, fmt, scanned.files, self.unavailable, unscanned, scanned.images.count())
