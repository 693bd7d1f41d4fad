"""Find all matches of a pattern with code-point offsets, inside the JVM.

Spark has no such function. Every match is bracketed by private-use characters with
its parts set apart, the result is split, and one fold adds up lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import utils
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.model import SPAN

EDGE, SEAM = "\ue000", "\ue001"
#: Characters that end a line; a carriage return and line feed are one end.
LINE_END = "[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029](?:(?<=\r)\n)?"
_ENDS = "\n\x0B\f\r\x1C\x1D\x1E\x85\u2028\u2029"


@contextmanager
def plain_building() -> Iterator[None]:
    """Leaves out the recording of each expression's call site, most of the time that a plan of thousands takes to build."""
    before = getattr(utils, "_enable_debugging_cache", None)
    utils._enable_debugging_cache = False
    try:
        yield
    finally:
        utils._enable_debugging_cache = before


def end_length(text: Column) -> Column:
    """Characters of the line end that a text ends with."""
    return F.when(text.endswith("\r\n"), 2).when(reduce(lambda a, b: a | b, map(text.endswith, _ENDS)), 1).otherwise(0)


def lines(text: Column) -> Column:
    """The lines of a text; a trailing line end adds none."""
    text = F.coalesce(text, F.lit(""))
    # The text is cut before it is split: the parts would be split again for each use of them.
    cut = end_length(text)
    body = F.when(cut == 0, text).otherwise(F.substring(text, F.lit(1), F.length(text) - cut))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END))


def find_all(line: Column, pattern: str) -> Column:
    """``array<struct<start,end,value,from,to>>`` of a pattern with named groups p, v and r.

    ``p``, ``v`` and ``r`` follow each other and make up the match; ``start`` and ``end``
    bound v, ``from`` and ``to`` the match. Offsets count code points from 0.
    """
    plain = F.translate(line, EDGE + SEAM, "\ufffd\ufffd")
    marked = F.regexp_replace(plain, F.lit(pattern), F.lit(f"{EDGE}${{p}}{SEAM}${{v}}{SEAM}${{r}}{EDGE}"))
    parts = F.transform(F.split(marked, EDGE), lambda x, i: F.struct((i % 2 == 1).alias("hit"), F.split(x, SEAM).alias("f")))
    n = F.length

    def step(a: Column, e: Column) -> Column:
        start = a["pos"] + n(e["f"][0])
        end = start + n(e["f"][1])
        to = end + n(e["f"][2])
        span = F.struct(start.alias("start"), end.alias("end"), e["f"][1].alias("value"), a["pos"].alias("from"), to.alias("to"))
        found = F.struct(to.alias("pos"), F.concat(a["out"], F.array(span)).alias("out"))
        return F.when(e["hit"], found).otherwise(F.struct(start.alias("pos"), a["out"].alias("out")))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(parts, zero, step, lambda a: a["out"])


def before(line: Column, span: Column, width: int) -> Column:
    """Up to ``width`` characters in front of a match."""
    at = F.greatest(span["from"] - width, F.lit(0))
    return F.substring(line, at + 1, span["from"] - at)


def after(line: Column, span: Column, width: int = 1) -> Column:
    return F.substring(line, span["to"] + 1, F.lit(width))
