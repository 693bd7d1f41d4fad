"""Checks of matched values as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.spans import EDGE, after, before
from siftwell.plans import fixed


def digits(value: Column) -> Column:
    """The decimal digits of a value as an array of integers."""
    return F.transform(F.filter(F.split(value, ""), lambda c: c.rlike("[0-9]")), lambda c: c.cast("int"))


def weighted(d: Column, weights: tuple[int, ...]) -> Column:
    pairs = F.zip_with(F.slice(d, 1, len(weights)), F.array(*map(F.lit, weights)), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def card(line: Column, s: Column) -> Column:
    """Luhn's check, and more than two different digits."""
    plain = F.regexp_replace(s["value"], "[^0-9]", "")
    return (F.size(F.array_distinct(F.split(plain, ""))) > 2) & F.call_function("luhn_check", plain)


def resident_number(line: Column, s: Column) -> Column:
    """A real birth date, and a check digit, a label or a separator with a citizen's century digit."""
    d, v = digits(s["value"]), s["value"]
    plain = F.regexp_replace(v, "[^0-9]", "")
    g = F.get(d, F.lit(6))
    century = F.when(g.isin(1, 2, 5, 6), "19").when(g.isin(3, 4, 7, 8), "20").otherwise("18")
    born = F.try_to_date(F.concat(century, F.substring(plain, 1, 6)), "yyyyMMdd").isNotNull()
    sound = (11 - weighted(d, fixed.RESIDENT_WEIGHTS) % 11) % 10 == F.get(d, F.lit(12))
    told = before(line, s, 20).rlike(f"(?iu){fixed.RESIDENT_CUES}")
    return born & (sound | told | (v.rlike("[^0-9]") & g.isin(1, 2, 3, 4)))


def business_number(line: Column, s: Column) -> Column:
    d = digits(s["value"])
    total = weighted(d, fixed.BUSINESS_WEIGHTS) + F.floor(F.get(d, F.lit(8)) * 5 / 10)
    return ((10 - total % 10) % 10 == F.get(d, F.lit(9))) | before(line, s, 20).rlike(f"(?iu){fixed.BUSINESS_CUES}")


def email(line: Column, s: Column) -> Column:
    """No repository or machine address and none of a documentation domain."""
    v = s["value"]
    local, domain = F.lower(F.substring_index(v, "@", 1)), F.lower(F.substring_index(v, "@", -1))
    machine = local.isin(*fixed.EMAIL_LOCALS) | (after(line, s) == ":") | domain.rlike("^[0-9.]+$")
    label = F.split(domain, "[.]")[0].isin(*fixed.EMAIL_LABELS)
    suffix = reduce(or_, (domain.endswith(x) for x in fixed.EMAIL_SUFFIXES))
    return ~(machine | label | suffix | domain.rlike("^[\\w.]*[.](gif|jpe?g|png|svg|webp)$"))


def username(line: Column, s: Column) -> Column:
    low = F.lower(s["value"])
    return ~(low.isin(*fixed.GENERIC_USERS) | low.rlike("^[$%<{\\[]") | low.contains("*"))


def tenant(line: Column, s: Column) -> Column:
    v = F.trim(s["value"])
    return (v != "") & ~F.lower(v).isin(*fixed.GENERIC_TENANTS) & ~v.rlike("^[<$%]")


def private_ip(line: Column, s: Column) -> Column:
    """An internal address with plain octets that is no common router default."""
    v = s["value"]
    o = F.transform(F.split(v, "[.]"), lambda x: x.cast("int"))
    inside = (o[0] == 10) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & (o[1] == 168)) | ((o[0] == 100) & o[1].between(64, 127))
    plain = F.forall(o, lambda x: x <= 255) & ~v.rlike("(^|[.])0[0-9]")
    return plain & inside & ~v.isin(*fixed.EXAMPLE_IPS)


# --- names -----------------------------------------------------------------

_PARTICLES = f"(?:{fixed.PARTICLES})*"


def titled_name(line: Column, s: Column) -> Column:
    """A surname first, and neither a role nor a word that is no name."""
    whole = F.regexp_replace(F.replace(F.substring(line, s["from"] + 1, s["to"] - s["from"]), F.lit(" "), F.lit("")), _PARTICLES + "$", "")
    starts = whole.rlike("^(?:" + "|".join(r for r in fixed.ROLE_WORDS if len(r) > 2) + ")")
    return s["value"].rlike(f"^[{fixed.SURNAMES}]") & ~whole.isin(*fixed.ROLE_WORDS) & ~starts & ~s["value"].isin(*fixed.NOT_NAMES)


def leading_names(value: Column) -> Column:
    """The items in front of the first that is no name."""
    name = F.array_contains
    good = lambda x: x.rlike(f"^[{fixed.SURNAMES}][가-힣]{{1,3}}$") & ~name(F.array(*map(F.lit, [*fixed.NOT_NAMES, *fixed.ROLE_WORDS])), x)
    parts = F.transform(F.split(F.regexp_replace(value, "([가-힣]+)", f"{EDGE}$1{EDGE}"), EDGE), lambda x, i: F.struct(x.alias("t"), (i % 2 == 1).alias("w")))
    zero = F.struct(F.lit("").alias("kept"), F.lit("").alias("gap"), F.lit(True).alias("go"))

    def step(a: Column, e: Column) -> Column:
        took = F.struct(F.concat(a["kept"], a["gap"], e["t"]).alias("kept"), F.lit("").alias("gap"), F.lit(True).alias("go"))
        stop = F.struct(a["kept"].alias("kept"), F.lit("").alias("gap"), F.lit(False).alias("go"))
        gap = F.struct(a["kept"].alias("kept"), F.concat(a["gap"], e["t"]).alias("gap"), a["go"].alias("go"))
        return F.when(~a["go"], stop).when(~e["w"], gap).when(good(e["t"]), took).otherwise(stop)

    return F.aggregate(parts, zero, step, lambda a: a["kept"])


# --- placeholders ----------------------------------------------------------

def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.split(text, "")
    n = F.length(text)
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, x: s - share(x) * F.log2(share(x)))


def _filler(word: Column) -> Column:
    w = F.lower(word)
    return w.isin(*fixed.FILLER_WORDS) | w.rlike("^[0-9]{1,4}$") | w.rlike("^(.)\\1*$")


def _opaque(value: Column) -> Column:
    """Has a run of 20 or more that is too random for documentation."""
    runs = F.regexp_extract_all(value, F.lit("([-A-Za-z0-9_+/=]{20,})"), 1)
    return F.exists(runs, lambda r: (F.length(F.regexp_replace(r, "[^0-9]", "")) >= 2) & (entropy(r) >= 3.5) & ~_filler(r))


def placeholder(value: Column, context: Column) -> Column:
    """Whether a credential-shaped value is documentation filler: every word of it is."""
    v = F.regexp_replace(F.trim(value), "^[\"'`]+|[\"'`]+$", "")
    low = F.lower(context)
    marked = F.lit(False)
    for mark in fixed.CODE_MARKERS:
        marked |= low.contains(mark)
    body = F.regexp_replace(v, fixed.VENDOR_PREFIX, "")
    words = F.filter(F.split(body, "[-_./\\s:]+"), lambda w: w != "")
    return (
        (v == "")
        | v.contains("EXAMPLE")
        | (marked & ~_opaque(v))
        | v.rlike("^[A-Z]+(?:_[A-Z]+)+$")
        | (v.rlike("(?i)^(?:enter|insert|my|paste|put|your)[-_]") & ~v.rlike("[0-9]{3}"))
        | (body == "")
        | F.forall(words, _filler)
        | ((F.length(body) >= 12) & (F.size(F.array_distinct(F.split(body, ""))) <= 3))
    )


def assigned(line: Column, s: Column) -> Column:
    """An assigned value that is no call and not made of letters or digits alone."""
    v = s["value"]
    return (after(line, s) != "(") & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike("^[A-Za-z_][\\w.]*[(\\[]")
