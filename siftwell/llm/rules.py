"""Quality rules: fixed base rules and thresholds that adapt to language and source.

Everything is a DataFrame expression. Documents are measured inside their row; only
a mergeable quantile sketch per (language, source) crosses a shuffle. A sketch's
quartiles give the group's limits, which are joined back and decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import SPACE, materialise, words

WINDOW = 5
#: metric -> (expression, least spread, lower limit too). Limits lie REACH spreads from the median.
METRICS = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", 0.02, False),
    "repeated_lines": ("100 * n_dup_lines / greatest(n_words, 1)", 1.5, False),
    "word_length": ("word_chars / greatest(n_words, 1)", 0.5, True),
}
REACH = 4.0
#: Sketch error is the group's rows over this.
ACCURACY = 10_000


def _part(array: str, start: int, length: str) -> str:
    return f"slice({array}, {start}, greatest({length}, 0))"


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``_m`` of the base measures behind its own columns.

    Positions covered by a repeated window are found in the row: windows are hashed
    pairwise from word hashes, sorted with their positions where any repeats, and
    equal neighbours mark positions.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    a = docs.select(own, text.alias("_text"), words(F.col("text")).alias("_w"))
    lines = "filter(split(_text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    b = a.select(
        "_row",
        F.size("_w").alias("_n"),
        F.length(F.array_join("_w", "")).cast("long").alias("_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]+", ""))).cast("long").alias("_symbols"),
        F.expr(lines).alias("_lines"),
        F.expr("transform(_w, x -> xxhash64(x))").alias("_h"),
    )
    b = b.withColumn("_dup", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    c = b.withColumn("_p2", F.expr(f"zip_with({_part('_h', 1, '_n - 1')}, {_part('_h', 2, '_n - 1')}, (a, b) -> xxhash64(a, b))"))
    c = c.withColumn("_p4", F.expr(f"zip_with({_part('_p2', 1, '_n - 3')}, {_part('_p2', 3, '_n - 3')}, (a, b) -> xxhash64(a, b))")).drop("_p2")
    c = c.withColumn("_p5", F.expr(f"zip_with({_part('_p4', 1, '_n - 4')}, {_part('_h', 5, '_n - 4')}, (a, b) -> xxhash64(a, b))")).drop("_p4", "_h")
    c = c.withColumn("_s", F.expr("if(size(array_distinct(_p5)) < size(_p5), sort_array(transform(_p5, (x, i) -> struct(x as h, i as i))), null)")).drop("_p5")
    c = c.withColumn("_at", F.expr("sort_array(array_compact(transform(_s, (x, i) -> if(x.h <=> get(_s, i - 1).h or x.h <=> get(_s, i + 1).h, x.i, null))))")).drop("_s")
    repeated = F.expr(f"coalesce(aggregate(_at, struct(0L as n, cast(-{WINDOW} as int) as last), (s, p) -> struct(s.n + least({WINDOW}, p - s.last) as n, p as last), s -> s.n), 0L)")
    n = F.col("_n").cast("long")
    return c.select(
        "_row",
        F.struct(n.alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"), F.col("_dup").alias("n_dup_lines"), repeated.alias("n_repeat_words")).alias("_m"),
        F.monotonically_increasing_id().alias("_at"),
    )


def limits(measured: DataFrame) -> DataFrame:
    """Per (language, source): lower and upper limit of each metric, from quantile sketches."""
    rows = measured.select(F.col("_row.lang").cast("string").alias("_lang"), F.col("_row.source").cast("string").alias("_source"), "_m.*")
    sketches = [F.percentile_approx(F.expr(e), [0.25, 0.5, 0.75], ACCURACY).alias(k) for k, (e, _, _) in METRICS.items()]
    out = rows.groupBy("_lang", "_source").agg(*sketches)
    bounds = []
    for k, (_, least, both) in METRICS.items():
        spread = REACH * F.greatest(F.col(k)[2] - F.col(k)[0], F.lit(least))
        bounds.append((F.col(k)[1] + spread).alias(f"{k}_most"))
        if both:
            bounds.append((F.col(k)[1] - spread).alias(f"{k}_least"))
    return out.select("_lang", "_source", *bounds)


def judge(docs: DataFrame) -> DataFrame:
    """``_row`` (a row of ``docs``), its measures, ``base_failed`` and ``kept``.

    Null texts have no words and fail. Null languages and sources are groups of
    their own. Repeated rows are judged alike. No rows give no rows.
    """
    measured = measure(docs)
    bound = materialise(limits(measured), "limits")  # small: broadcast where its size allows
    # `_at` is not deterministic: filters on a verdict need it, so the optimizer can't move
    # them below the measures, where it would repeat their expressions many times over.
    base = ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))) & (F.col("_at") >= 0)
    rows = measured.select("_row", "_m.*", "_at").withColumn("base_failed", base)
    met = rows.join(bound, F.col("_row.lang").cast("string").eqNullSafe(F.col("_lang")) & F.col("_row.source").cast("string").eqNullSafe(F.col("_source")))
    inside: Column = F.lit(True)
    for k, (e, _, both) in METRICS.items():
        inside &= F.expr(e) <= F.col(f"{k}_most")
        if both:
            inside &= F.expr(e) >= F.col(f"{k}_least")
    return met.withColumn("kept", ~F.col("base_failed") & inside)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, source, ...)``: measures and verdict."""
    return judge(docs).select(F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def passing(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with all their columns."""
    return judge(docs).where("kept").select("_row.*")


_W = f"list_filter(string_split_regex(coalesce(text, ''), '[{SPACE}]+'), lambda x: x <> '')"
_LINES = f"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]'))"


def _oracle() -> str:
    quart = ", ".join(f"list_sort(list({e.replace(' / ', '::double / ')}))[ceil({q} * count(*))::bigint] {k}_{n}" for k, (e, _, _) in METRICS.items() for q, n in ((0.25, "a"), (0.5, "b"), (0.75, "c")))
    checks = []
    for k, (e, least, both) in METRICS.items():
        e, spread = e.replace(" / ", "::double / "), f"{REACH} * greatest({k}_c - {k}_a, {least}::double)"
        checks.append(f"{e} <= {k}_b + {spread}")
        if both:
            checks.append(f"{e} >= {k}_b - {spread}")
    return f"""
WITH w AS (SELECT doc_id, lang, source, {_W} ws, {_LINES} ls, coalesce(text, '') t FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) c FROM g) WHERE c > 1),
v AS (SELECT doc_id, sum(least(5, i - coalesce(p, -9)))::bigint n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(v.n, 0)::bigint n_repeat_words
  FROM w LEFT JOIN v ON w.doc_id = v.doc_id),
q AS (SELECT lang, source, {quart} FROM m GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {" AND ".join(checks)} kept
FROM m JOIN q ON m.lang IS NOT DISTINCT FROM q.lang AND m.source IS NOT DISTINCT FROM q.source"""


ORACLE = _oracle()
