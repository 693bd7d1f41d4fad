"""Added lines of a git history as a DataFrame, read by commit ranges in parallel."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.spans import LINE_END
from siftwell.plans import fixed
from siftwell.sources.files import CONTAINERS, PARTS, suffix
from siftwell.sources.office import extract

ADDED = "commit string, path string, line int, line_text string, binary boolean"
_HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def git(repo: str, *args: str) -> bytes:
    """Output of a git command; its error text as RuntimeError."""
    done = subprocess.run(["git", "-C", repo, "-c", "core.quotePath=false", *args], capture_output=True)
    if done.returncode:
        raise RuntimeError(done.stderr.decode("utf-8", "replace").strip() or "git failed")
    return done.stdout


def added(diff: str, commit: str) -> Iterator[tuple[str, str, int, str, bool]]:
    """Added lines of one commit's zero-context diff, told from headers by the hunks' counts."""
    path, gone, new, at = "", 0, 0, 0
    for line in diff.split("\n"):
        if new or gone:
            if line.startswith("+") and new:
                yield commit, path, at, line[1:].rstrip("\r"), False
                at, new = at + 1, new - 1
            elif line.startswith("-") and gone:
                gone -= 1
            continue
        if m := _HUNK.match(line):
            gone, at, new = int(m[1] or 1), int(m[2]), int(m[3] if m[3] is not None else 1)
        elif line.startswith("+++ "):
            path = line[4:].rstrip("\t").removeprefix("b/").strip('"')
        elif line.startswith("Binary files ") and (m := re.search(r" and b/(.+) differ$", line)):
            yield commit, m[1], 0, "", True


def _commits(spark: SparkSession, repo: str, rev: str | None, tasks: int) -> DataFrame:
    """The commits of ``rev`` (several words: as git takes them), dealt to tasks."""
    commits = git(repo, "rev-list", *(rev.split() if rev else ["--all"])).decode().split()
    return spark.createDataFrame([(c,) for c in commits], "commit string").repartition(max(1, min(tasks, len(commits))))


def added_lines(spark: SparkSession, repo: str, rev: str | None = None, tasks: int = 8) -> DataFrame:
    """``(commit, path, line, line_text, binary)`` of ``rev`` or of all commits.

    The driver lists commit numbers; tasks read their diffs (the repository must be on a shared folder).
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for commit in frame["commit"]:
                diff = git(repo, "show", "--format=", "-p", "--unified=0", "--no-renames", "--no-ext-diff", "-m", "--first-parent", commit)
                yield pd.DataFrame(list(added(diff.decode("utf-8", "replace"), commit)), columns=["commit", "path", "line", "line_text", "binary"])

    return _commits(spark, repo, rev, tasks).mapInPandas(read, ADDED)


def document_parts(spark: SparkSession, repo: str, rev: str | None = None, tasks: int = 8, ocr: bool = False) -> DataFrame:
    """``(path, where, text, reason)`` of documents that commits added or changed, read by their suffix."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for commit in frame["commit"]:
                names = git(repo, "show", "--format=", "--name-only", "-z", "--no-renames", "--diff-filter=d", "-m", "--first-parent", commit).decode("utf-8", "replace")
                rows = []
                for path in filter(_is_document(ocr), names.strip("\n").split("\0")):
                    parts, why = extract(path, git(repo, "show", f"{commit}:{path}"), ocr)
                    rows += [(path, f"commit {commit[:10]} {where}", text, None) for where, text in parts] + ([(path, f"commit {commit[:10]}", None, why)] if why else [])
                yield pd.DataFrame(rows, columns=["path", "where", "text", "reason"])

    return _commits(spark, repo, rev, tasks).mapInPandas(read, PARTS)


def _is_document(ocr: bool):
    kinds = (*CONTAINERS, *(fixed.IMAGES if ocr else ()))
    return lambda path: PurePosixPath(path).suffix.lower() in kinds


def history_segments(df: DataFrame) -> DataFrame:
    """Added lines of what is no document, with ``where`` telling the commit, ready for a line scan."""
    text = df.where(~F.col("binary") & ~suffix().isin(*CONTAINERS, *fixed.IMAGES))
    return text.select("path", F.concat(F.lit("commit "), F.substring("commit", 1, 10)).alias("where"), "line", "line_text")


def joined(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(path, where, text)`` of added lines, joined by file and commit, and ``(path, where, numbers)``
    of the lines' own numbers. Line ends inside a line become blanks, so that the count holds."""
    own = F.sort_array(F.collect_list(F.struct("line", "line_text")))
    each = lines.groupBy("path", "where").agg(own.alias("own"))
    text = F.array_join(F.transform("own.line_text", lambda x: F.regexp_replace(x, LINE_END, " ")), "\n")
    return each.select("path", "where", text.alias("text")), each.select("path", "where", F.col("own.line").alias("numbers"))
