"""Column expressions for the fields of the text format: parsing, which gives null for malformed text, and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ATTRIBUTE_TYPES, READ_IDENTITIES

_INTEGER = r"^\+?[0-9]+$"


def tokens(line: Column) -> Column:
    """The words of a line; white space separates."""
    return F.split(F.trim(F.regexp_replace(line, r"(?U)\s+", " ")), " ")


def unsigned(x: Column) -> Column:
    return F.when(x.rlike(_INTEGER), x.try_cast("bigint"))


def interval(x: Column) -> Column:
    """``a-b`` as (start, end); null unless it is exactly two integers."""
    p = F.split(x, "-")
    out = F.struct(unsigned(F.get(p, F.lit(0))).alias("start"), unsigned(F.get(p, F.lit(1))).alias("end"))
    return F.when((F.size(p) == 2) & out["start"].isNotNull() & out["end"].isNotNull(), out)


def exons(x: Column) -> Column:
    """Comma-separated intervals; null if any is malformed."""
    out = F.transform(F.split(x, ","), interval)
    return F.when(~F.exists(out, lambda e: e.isNull()), out)


def reads(x: Column) -> Column:
    """Comma-separated ``id:identity``; null if any doesn't have exactly one colon or names another identity."""
    def one(r):
        p = F.split(r, ":")
        return F.when((F.size(p) == 2) & F.get(p, F.lit(1)).isin(*READ_IDENTITIES), F.struct(F.get(p, F.lit(0)).alias("id"), F.get(p, F.lit(1)).alias("identity")))

    out = F.transform(F.split(x, ","), one)
    return F.when(~F.exists(out, lambda r: r.isNull()), out)


def structural_variant(x: Column) -> Column:
    """``ref1,ref2,bp1,bp2,type``; null unless it has five parts and unsigned breakpoints."""
    p = F.split(x, ",")
    at = lambda i: F.get(p, F.lit(i))
    a, b = unsigned(at(2)), unsigned(at(3))
    return F.when((F.size(p) == 5) & a.isNotNull() & b.isNotNull(), F.struct(
        at(0).alias("reference_name1"), at(1).alias("reference_name2"), a.alias("breakpoint1"), b.alias("breakpoint2"), at(4).alias("sv_type")))


def strand(x: Column) -> Column:
    return F.when(x.isin("+", "-"), x)


def oriented(x: Column) -> Column:
    """An element with its orientation, null without a trailing sign."""
    sign = F.substring(x, -1, 1)
    has = sign.isin("+", "-")
    return F.struct(F.when(has, F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x).alias("id"),
                    F.when(has, sign).alias("orientation"))


def attribute(x: Column) -> Column:
    """``tag:type:value`` as (tag, type, value). The type is the first letter of its part; the value may hold colons."""
    p = F.split(x, ":", 3)
    kind = F.substring(F.get(p, F.lit(1)), 1, 1)
    known = kind.isin(*ATTRIBUTE_TYPES)
    return F.when((F.size(p) == 3) & known, F.struct(F.get(p, F.lit(0)).alias("tag"), kind.alias("type"), F.get(p, F.lit(2)).alias("value")))


def is_attribute(x: Column) -> Column:
    """Whether :func:`attribute` has a value, by one pattern."""
    return x.rlike(f"^[^:]*:[{''.join(ATTRIBUTE_TYPES)}][^:]*:")


def attribute_map(items: Column) -> Column:
    """An array of (tag, type, value) as a map; the last of equal tags wins."""
    tags = F.array_distinct(F.transform(items, lambda a: a["tag"]))
    last = lambda t: F.element_at(F.filter(items, lambda a: a["tag"] == t), -1)
    return F.map_from_entries(F.transform(tags, lambda t: F.struct(t, F.struct(last(t)["type"].alias("type"), last(t)["value"].alias("value")))))


# --- display -------------------------------------------------------------------------------------------------------


def exons_text(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"))), ",")


def read_texts(x: Column) -> Column:
    return F.transform(x, lambda r: F.concat(r["id"], F.lit(":"), r["identity"]))


def sv_text(x: Column) -> Column:
    return F.concat_ws(",", x["reference_name1"], x["reference_name2"], x["breakpoint1"].cast("string"), x["breakpoint2"].cast("string"), x["sv_type"])


def sorted_attributes(attributes: Column) -> Column:
    """The entries of an attribute map by tag: (key, value: (type, value))."""
    return F.array_sort(F.map_entries(attributes))


def attribute_texts(attributes: Column) -> Column:
    return F.transform(sorted_attributes(attributes), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"]))


def element_text(e: Column) -> Column:
    return F.concat(e["id"], F.coalesce(e["orientation"], F.lit("")))


# --- typed access --------------------------------------------------------------------------------------------------


def as_int(attributes: Column, tag: str) -> Column:
    """The value of an ``i`` attribute; null for another type or a malformed number."""
    a = attributes[tag]
    return F.when(a["type"] == "i", a["value"].try_cast("bigint"))


def as_float(attributes: Column, tag: str) -> Column:
    """The value of an ``f`` attribute in single precision."""
    a = attributes[tag]
    return F.when(a["type"] == "f", a["value"].try_cast("float"))


def as_string(attributes: Column, tag: str) -> Column:
    a = attributes[tag]
    return F.when(a["type"] == "Z", a["value"])


def as_json(attributes: Column, tag: str) -> Column:
    """A ``J`` attribute as a variant; null where it isn't valid JSON."""
    a = attributes[tag]
    return F.when(a["type"] == "J", F.try_parse_json(a["value"]))


def typed(attributes: Column, tag: str, strict: bool = False) -> Column:
    """(int, float, text, bytes) of an attribute, one of them set by its type. ``strict`` raises on a malformed number."""
    a = attributes[tag]
    whole, real = as_int(attributes, tag), as_float(attributes, tag)
    if strict:
        bad = lambda what: F.raise_error(F.concat(F.lit(f"attribute {tag} is no {what}: "), a["value"]))
        whole = F.when(a["type"] == "i", F.coalesce(whole, bad("integer").cast("bigint")))
        real = F.when(a["type"] == "f", F.coalesce(real, bad("number").cast("float")))
    return F.struct(whole.alias("int"), real.alias("float"), F.when(a["type"].isin("Z", "J", "H"), a["value"]).alias("text"),
                    F.when(a["type"] == "B", F.encode(a["value"], "UTF-8")).alias("bytes"))
