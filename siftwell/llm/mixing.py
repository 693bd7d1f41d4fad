"""Mixing sources to target weights by hierarchical budgets.

A tree of domain, language and source has documents at its leaves. A token budget
enters at the root and is dealt to children by weight; a child never gets more than
its leaves can give in the allowed epochs, and what it can't take goes to its
siblings first. Only what a whole family can't take reaches its ancestors, because
every node is dealt its family's capacity at most. All amounts are integers.

A leaf's documents form one stream: all of them in a seeded order, epoch by epoch.
It gives the prefix of that stream that holds its budget. Whole epochs need no
order. The last one is cut in hash buckets; only the bucket in which the cut falls
is sorted, so a leaf with a third of all rows is sorted nowhere as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import SPACE, materialise

LEVELS = ("domain", "lang", "source")
NONE = "(null)"
#: Hexadecimal digits of a row's place that name its bucket: 4096 buckets a leaf.
BUCKET_DIGITS = 3


def token_count(column: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def source_domain(source: str, domains: tuple[str, ...]) -> Column:
    """The domain of a source: by the number that ends its name, else the first one."""
    number = F.coalesce(F.regexp_extract(F.col(source).cast("string"), "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, domains)), F.pmod(number, F.lit(len(domains))) + 1)


def weight(path: list[Column], weights: dict[tuple[str, ...], int]) -> Column:
    """Weight of the node at ``path``; 1 where none is given."""
    out = F.lit(1)
    for names, w in sorted(weights.items()):
        if len(names) == len(path):
            fits = F.lit(True)
            for column, name in zip(path, names, strict=True):
                fits &= column == name
            out = F.when(fits, w).otherwise(out)
    return out.cast("long")


def deal(children: DataFrame, parent: list[str]) -> DataFrame:
    """Budgets of ``children(<parent>, name, weight, capacity, above)`` by water-filling.

    ``above`` is the parent's budget. Children fill up in the order of capacity over
    weight; the rest share what is left by weight, odd tokens going to the largest
    remainders (ties: by name). Weight zero gets nothing.
    """
    exact = "decimal(38,0)"
    w, c, b = (F.col(x).cast(exact) for x in ("weight", "capacity", "above"))
    live = F.col("weight") > 0
    family = Window.partitionBy(*parent)
    order = family.orderBy(F.when(live, F.col("capacity") / F.col("weight")).asc_nulls_last(), "name")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = children.withColumn("_w", F.when(live, w).otherwise(F.lit(0).cast(exact))).withColumn("_c", F.when(live, c).otherwise(F.lit(0).cast(exact)))
    rows = rows.withColumn("_left", b - F.coalesce(F.sum("_c").over(prior), F.lit(0).cast(exact)))
    rows = rows.withColumn("_weights", F.sum("_w").over(family) - F.coalesce(F.sum("_w").over(prior), F.lit(0).cast(exact)))
    # full: its capacity is within its share of what those before it leave
    rows = rows.withColumn("_full", live & (F.expr("cast(_c * _weights as decimal(38,0))") <= F.expr("cast(_left * _w as decimal(38,0))")))
    shut = F.sum(F.when(F.col("_full"), F.col("_c")).otherwise(F.lit(0).cast(exact))).over(family)
    open_ = F.sum(F.when(~F.col("_full"), F.col("_w")).otherwise(F.lit(0).cast(exact))).over(family)
    rows = rows.withColumn("_rest", b - shut).withColumn("_open", open_)
    rows = rows.withColumn("_product", F.expr("if(_full or _w = 0, cast(0 as decimal(38,0)), cast(_rest * _w as decimal(38,0)))"))
    rows = rows.withColumn("_share", F.expr("if(_full or _w = 0, 0L, _product div _open)")).withColumn("_remainder", F.expr("if(_full or _w = 0, cast(-1 as decimal(38,0)), cast(_product % _open as decimal(38,0)))"))
    odd = F.expr("if(_open > 0, _rest, cast(0 as decimal(38,0)))") - F.sum("_share").over(family)
    rank = F.row_number().over(family.orderBy(F.desc("_remainder"), "name"))
    rows = rows.withColumn("_odd", odd).withColumn("_rank", rank)
    budget = F.expr("cast(if(_full, _c, _share + if(_w > 0 and _rank <= _odd, 1, 0)) as long)")
    return rows.withColumn("budget", budget).select(*children.columns, "budget")


def budgets(leaves: DataFrame, weights: dict[tuple[str, ...], int], share: float, tokens: int | None, epochs: int) -> DataFrame:
    """``(domain, lang, source, tokens, budget)`` of leaves ``(domain, lang, source, tokens)``.

    The whole budget is ``tokens``, or ``share`` of all tokens; never more than the
    leaves can give in ``epochs`` epochs. The tree has as many rows as there are
    leaves, not documents.
    """
    capacity = leaves.withColumn("capacity", F.col("tokens") * F.lit(epochs))
    # A node's weight is 0 if any of its leaves' own could not be reached: capacity counts usable leaves only.
    usable = F.lit(True)
    for k in range(1, 4):
        usable &= weight([F.col(x) for x in LEVELS[:k]], weights) > 0
    capacity = capacity.withColumn("capacity", F.when(usable, F.col("capacity")).otherwise(0))
    wanted = F.lit(tokens).cast("long") if tokens is not None else F.floor(F.sum("tokens") * F.lit(share)).cast("long")
    root = capacity.agg(F.least(wanted, F.sum("capacity")).alias("above"))
    above, parent = root, []
    for k, level in enumerate(LEVELS):
        own = capacity.groupBy(*LEVELS[: k + 1]).agg(F.sum("capacity").cast("long").alias("capacity"))
        own = own.withColumn("weight", weight([F.col(x) for x in LEVELS[: k + 1]], weights)).withColumn("name", F.col(level))
        own = own.join(above, parent) if parent else own.withColumn("_one", F.lit(1)).join(above.withColumn("_one", F.lit(1)), "_one").drop("_one")
        parent = list(LEVELS[: k + 1])
        above = deal(own, parent[:-1]).select(*parent, F.col("budget").alias("above"))
    return leaves.join(above.withColumnRenamed("above", "budget"), list(LEVELS))


def mixture(docs: DataFrame, domain: Column, weights: dict[tuple[str, ...], int], share: float = 1.0, tokens: int | None = None, epochs: int = 4, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, each as often as it takes it.

    Adds ``mix_domain``, ``mix_epoch`` (from 0), ``n_tokens`` and ``take_tokens`` (less
    than all only where a leaf's budget ends in the row) - columns of ``docs`` with
    these names are replaced. Null languages and sources are leaves of their own;
    rows without tokens are taken with the epoch they stand in, if the budget is not
    used up before them; repeated rows are separate rows; ties in the seeded order
    follow doc_id, then text. No rows give no rows.
    """
    own = [c for c in docs.columns if c not in ("mix_domain", "mix_epoch", "n_tokens", "take_tokens")]
    row = F.struct(*[F.col(f"`{c}`") for c in own])
    leaf = [F.coalesce(domain, F.lit(NONE)), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)), F.coalesce(F.col("source").cast("string"), F.lit(NONE))]
    rows = docs.select(row.alias("_row"), *[c.alias(f"_{n}") for c, n in zip(leaf, LEVELS, strict=True)], token_count().alias("_tokens"))
    names = {f"_{n}": n for n in LEVELS}
    leaves = rows.groupBy(*names).agg(F.sum("_tokens").alias("tokens")).withColumnsRenamed(names)
    dealt = materialise(budgets(materialise(leaves, "leaves"), weights, share, tokens, epochs), "budgets")
    full = F.when(F.col("tokens") > 0, F.expr("cast(budget div tokens as int)")).otherwise(0)
    plan = dealt.select(*[F.col(n).alias(f"_{n}") for n in LEVELS], full.alias("_full"), (F.col("budget") - full * F.col("tokens")).alias("_open"))
    met = rows.join(plan, list(names))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_full").cast("string"), F.lit(":"), F.coalesce(F.col("_row.doc_id").cast("string"), F.lit(""))).cast("binary"))
    met = met.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    sums = met.where("_open > 0").groupBy(*names, "_bucket").agg(F.sum("_tokens").alias("_sum"), F.first("_open").alias("_open"))
    upto = Window.partitionBy(*names).orderBy("_bucket")
    cut = sums.withColumn("_before", F.sum("_sum").over(upto) - F.col("_sum")).where("_before < _open and _before + _sum >= _open").select(*names, F.col("_bucket").alias("_cut"), "_before")
    met = met.join(materialise(cut, "cuts"), list(names), "left")
    within = Window.partitionBy(*names).orderBy("_order", F.xxhash64("_row.text"))
    keep = ["_row", "_domain", "_tokens", "_full"]
    edge = met.where("_bucket = _cut").withColumn("_start", F.col("_before") + F.sum("_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_tokens"))
    edge = edge.select(*keep, F.greatest(F.least(F.col("_tokens"), F.col("_open") - F.col("_start")), F.lit(0)).alias("_take"), (F.col("_start") < F.col("_open")).alias("_in"))
    rest = met.where("_cut is null or _bucket <> _cut").select(*keep, F.col("_tokens").alias("_take"), F.coalesce(F.col("_bucket") < F.col("_cut"), F.lit(False)).alias("_in"))
    both = rest.unionByName(edge)
    epoch = F.explode(F.expr("sequence(0, _full + if(_in, 1, 0))"))
    out = both.withColumn("mix_epoch", epoch).where("mix_epoch < _full or (_in and mix_epoch = _full)")
    take = F.when(F.col("mix_epoch") < F.col("_full"), F.col("_tokens")).otherwise(F.col("_take"))
    return out.select("_row.*", F.col("_domain").alias("mix_domain"), "mix_epoch", F.col("_tokens").alias("n_tokens"), take.alias("take_tokens"))


def prefix(mixed: DataFrame) -> DataFrame:
    """A mixture with texts (and their ``n_chars``) cut to the tokens taken of them.

    A cut text ends with its last taken word; white space before it stays as it is.
    """
    partial = F.col("take_tokens") < F.col("n_tokens")
    # each piece ends with a word; white space goes with the word behind it
    pieces = F.split("text", f"(?<=[^{SPACE}])(?=[{SPACE}])")
    out = mixed.withColumn("text", F.when(partial, F.array_join(F.slice(pieces, F.lit(1), F.col("take_tokens").cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in mixed.columns:
        out = out.withColumn("n_chars", F.when(partial, F.length("text").cast(mixed.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def oracle(domains: tuple[str, ...], weights: dict[tuple[str, ...], int], share: float, epochs: int, seed: int) -> str:
    """The mixture of ``documents`` as DuckDB SQL (doc_id unique)."""

    def of(k: int) -> str:
        cases = " ".join(f"WHEN ({', '.join(LEVELS[:k])}) = ({', '.join(repr(x) for x in names)}) THEN {w}" if k > 1 else f"WHEN domain = {names[0]!r} THEN {w}" for names, w in sorted(weights.items(), reverse=True) if len(names) == k)
        return f"(CASE {cases} ELSE 1 END)" if cases else "1"

    steps = ["b0 AS (SELECT least(floor(sum(tokens) * %s::double)::bigint, sum(capacity))::hugeint above FROM cap)" % share]
    for k in range(1, 4):
        keys, up = ", ".join(LEVELS[:k]), ", ".join(LEVELS[: k - 1])
        part = f"PARTITION BY {up}" if up else ""
        steps.append(f"""
n{k} AS (SELECT {keys}, sum(capacity)::hugeint c, {of(k)}::hugeint w, {LEVELS[k - 1]} nm FROM cap GROUP BY {keys}),
o{k} AS (SELECT n.*, above FROM n{k} n {f"JOIN b{k - 1} USING ({up})" if up else "CROSS JOIN b0"}),
p{k} AS (SELECT *, above - coalesce(sum(c) OVER u, 0) lft, sum(w) OVER ({part}) - coalesce(sum(w) OVER u, 0) ws FROM o{k}
  WINDOW u AS ({part} ORDER BY c::double / w::double, nm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{k} AS (SELECT *, c * ws <= lft * w AS fl FROM p{k}),
r{k} AS (SELECT *, above - sum(CASE WHEN fl THEN c ELSE 0 END) OVER ({part}) rst, sum(CASE WHEN fl THEN 0 ELSE w END) OVER ({part}) opn FROM f{k}),
s{k} AS (SELECT *, CASE WHEN fl THEN 0 ELSE (rst * w) // opn END sh, CASE WHEN fl THEN -1 ELSE (rst * w) % opn END rm FROM r{k}),
t{k} AS (SELECT *, CASE WHEN opn > 0 THEN rst ELSE 0 END - sum(sh) OVER ({part}) od, row_number() OVER ({part} ORDER BY rm DESC, nm) rk FROM s{k}),
b{k} AS (SELECT {keys}, CASE WHEN fl THEN c ELSE sh + CASE WHEN rk <= od THEN 1 ELSE 0 END END above FROM t{k})""")
    doms = "[" + ", ".join(map(repr, domains)) + "]"
    words = f"len(list_filter(string_split_regex(coalesce(text, ''), '[{SPACE}]+'), lambda x: x <> ''))::bigint"
    return f"""
WITH d AS (SELECT doc_id, lang l0, source s0, {doms}[coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS int), 0) % {len(domains)} + 1] AS domain,
  coalesce(lang, '{NONE}') lang, coalesce(source, '{NONE}') source, {words} n FROM documents),
lf AS (SELECT domain, lang, source, sum(n)::bigint tokens FROM d GROUP BY ALL),
cap AS (SELECT *, CASE WHEN {of(1)} > 0 AND {of(2)} > 0 AND {of(3)} > 0 THEN tokens * {epochs} ELSE 0 END capacity FROM lf),
{", ".join(steps)},
pl AS (SELECT lf.*, CASE WHEN tokens > 0 THEN (above // tokens)::int ELSE 0 END fll, above FROM lf JOIN b3 USING (domain, lang, source)),
st AS (SELECT d.*, fll, above - fll * tokens opn, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || fll || ':' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) start
  FROM d JOIN pl USING (domain, lang, source)),
ex AS (SELECT *, unnest(range(0, fll + CASE WHEN start < opn THEN 1 ELSE 0 END)) e FROM st)
SELECT doc_id, domain mix_domain, l0 lang, s0 source, e::int mix_epoch, n n_tokens, (CASE WHEN e < fll THEN n ELSE least(n, opn - start) END)::bigint take_tokens FROM ex"""
