"""Files as segments: walk, binary check, text decoding, containers and what can't be read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.model import glob_regex
from siftwell.plans import fixed
from siftwell.sources.office import CONTAINER_LIMIT, extract

TEXT_LIMIT = 10 << 20
CONTAINERS = (*fixed.ZIPPED, *fixed.OPAQUE, ".pdf")
PARTS = "path string, where string, text string, reason string"


def suffix(path: str = "path") -> Column:
    return F.lower(F.regexp_extract(path, "([.][^./]+)$", 1))


def files(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``(path, length, content)`` of a folder's files without skipped folders and excluded globs.

    A single file is taken whatever the globs say. ``content`` is only read where a
    later step uses it.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/")
    inside = F.expr(f"substring(path, instr(path, '{root}') + {len(root)})")
    skipped = "|".join(re.escape(d) for d in fixed.SKIPPED_FOLDERS)
    df = df.where(~inside.rlike(f"^(?:/.*)?/(?:{skipped})/"))
    for glob in exclude:
        df = df.where((inside == "") | ~(F.regexp_replace("path", "^file:(//)?", "").rlike(glob_regex(glob)) | F.ltrim(inside, F.lit("/")).rlike(glob_regex(glob))))
    return df.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "length", "content")


def text_segments(df: DataFrame) -> DataFrame:
    """``(path, where, text)`` of plain-text files; undecodable bytes become U+FFFD."""
    plain = df.where(~suffix().isin(*CONTAINERS, *fixed.IMAGES, *fixed.BINARY) & ~F.col("path").rlike("/~[$][^/]*$") & (F.col("length") <= TEXT_LIMIT))
    plain = plain.where(~F.contains(F.substring("content", 1, 8192), F.lit(bytearray(b"\x00"))))
    text = F.expr("regexp_replace(make_valid_utf8(cast(content as string)), '\\\\r\\\\n?', '\\n')")
    return plain.select("path", F.lit("").alias("where"), text.alias("text"))


def container_parts(df: DataFrame, ocr: bool = False) -> DataFrame:
    """``(path, where, text, reason)`` of containers and opaque files; a row with a reason is an unscanned file.

    Oversized files are told without reading them.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                parts, why = extract(path, bytes(content), ocr)
                rows = [(path, where, text, None) for where, text in parts] + ([(path, "", None, why)] if why else [])
                yield pd.DataFrame(rows, columns=["path", "where", "text", "reason"])

    held = suffix().isin(*CONTAINERS, *(fixed.IMAGES if ocr else ())) | F.col("path").rlike("/~[$][^/]*$")
    small = df.where(held & (F.col("length") <= CONTAINER_LIMIT)).select("path", "content").mapInPandas(read, PARTS)
    plain = ~held & ~suffix().isin(*fixed.IMAGES, *fixed.BINARY) & (F.col("length") > TEXT_LIMIT)
    reason = F.when(held & (F.col("length") > CONTAINER_LIMIT), f"larger than {CONTAINER_LIMIT >> 20} MB").when(plain, f"text larger than {TEXT_LIMIT >> 20} MB")
    large = df.select("path", F.lit("").alias("where"), F.lit(None).cast("string").alias("text"), reason.alias("reason")).where("reason is not null")
    return small.unionByName(large)


def images(df: DataFrame) -> DataFrame:
    """Paths of images, which only OCR reads."""
    return df.where(suffix().isin(*fixed.IMAGES)).select("path")


def document_authors(parts: DataFrame) -> DataFrame:
    """Findings of persons in author and property segments."""
    at = F.col("where").rlike("\\[(?:authors|properties|annotations)\\]$") | (F.col("where") == "metadata")
    lines = parts.where(at & F.col("text").isNotNull()).select("path", "where", F.posexplode(F.split("text", "\n")).alias("k", "t"))
    key, value = F.regexp_extract("t", "^(.*?): (.*)$", 1), F.trim(F.regexp_extract("t", "^(.*?): (.*)$", 2))
    good = lines.where(key.isin(*fixed.PERSON_KEYS) & (value != "") & ~F.lower(value).isin(*fixed.GENERIC_AUTHORS))
    start = F.length(key) + 2
    return good.select(
        "path", "where", (F.col("k") + 1).alias("line"), start.alias("start"), (start + F.length(value)).alias("end"),
        F.lit("pii").alias("category"), F.lit("document-author").alias("rule"), value.alias("value"), F.lit("builtin").alias("engine"),
    )
