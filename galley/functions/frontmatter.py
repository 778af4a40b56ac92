"""Front matter blocks, extras and the invisible watermark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NO_STRINGS = "array<string>"


def toml_string(text: Column) -> Column:
    """TOML basic string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, escaped in (('"', '\\"'), ("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def toml_array(items: Column) -> Column:
    items = F.coalesce(items, F.array().cast(_NO_STRINGS))
    return F.concat(F.lit("["), F.array_join(F.transform(items, toml_string), ", "), F.lit("]"))


def toml_key(key: Column) -> Column:
    return F.when(key.rlike("^[A-Za-z0-9_-]+$"), key).otherwise(toml_string(key))


def normalise_extra(value: Column) -> Column:
    """Text of an extra: trimmed, brackets stripped, JSON-escaped unless it is a whole number."""
    bare = F.btrim(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit("(（）)"))
    escaped = F.regexp_replace(F.to_json(F.array(bare)), r'^\["|"\]$', "")
    return F.when(bare.rlike(r"^\d+$"), F.regexp_replace(bare, r"^0+(?=\d)", "")).otherwise(escaped)


def extra_is_number(value: Column) -> Column:
    return F.btrim(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit("(（）)")).rlike(r"^\d+$")


def extra_int(value: Column) -> Column:
    """Integer form of an extra, NULL when it is text or outside BIGINT."""
    return F.when(extra_is_number(value), normalise_extra(value).try_cast("bigint"))


def normalise_extras(extras: Column) -> Column:
    """Extras map with its values in written form."""
    return F.transform_values(extras, lambda _, v: normalise_extra(v))


def _toml_extra(value: Column) -> Column:
    return F.when(extra_is_number(value), normalise_extra(value)).otherwise(toml_string(normalise_extra(value)))


def front_matter_lines(fields: dict[str, Column], extras: Column) -> Column:
    """Array of (key, TOML value) in output order.

    An extra whose key is a base field replaces that field's value in place; the others follow the
    base fields; the draft mark comes last and is never replaced.
    """
    empty = F.array().cast("array<struct<key:string,value:string>>")
    extra = F.transform(
        F.coalesce(F.map_entries(extras), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.struct(e["key"].alias("key"), _toml_extra(e["value"]).alias("value")),
    )
    base = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()])
    merged = F.transform(
        base,
        lambda b: F.coalesce(F.try_element_at(F.filter(extra, lambda e: e["key"] == b["key"]), F.lit(1)), b),
    )
    names = list(fields)
    tail = F.transform(
        F.filter(extra, lambda e: ~e["key"].isin(names)),
        lambda e: F.struct(
            e["key"].alias("key"), F.when(e["key"] == "draft", F.lit("false")).otherwise(e["value"]).alias("value")
        ),
    )
    draft = F.when(F.exists(extra, lambda e: e["key"] == "draft"), empty).otherwise(
        F.array(F.struct(F.lit("draft").alias("key"), F.lit("false").alias("value")))
    )
    return F.concat(merged, tail, draft)


def as_toml(lines: Column) -> Column:
    rows = F.transform(lines, lambda e: F.concat(toml_key(e["key"]), F.lit(" = "), e["value"]))
    return F.concat(F.lit("+++\n"), F.array_join(rows, "\n"), F.lit("\n+++"))


def as_yaml(lines: Column) -> Column:
    """YAML form of the same lines: lists as items, everything else unquoted."""

    def entry(e: Column) -> Column:
        key, value = toml_key(e["key"]), e["value"]
        items = F.filter(
            F.transform(
                F.split(F.substring(value, F.lit(2), F.length(value) - 2), ","),
                lambda i: F.btrim(F.btrim(i), F.lit("'\"")),
            ),
            lambda i: i != "",
        )
        as_list = F.array_join(
            F.concat(
                F.array(F.concat(key, F.lit(":"))), F.transform(items, lambda i: F.concat(F.lit("  - "), i))
            ),
            "\n",
        )
        return F.when(value.startswith("[") & value.endswith("]"), as_list).otherwise(
            F.concat(key, F.lit(": "), F.btrim(value, F.lit('"')))
        )

    return F.concat(F.lit("---\n"), F.array_join(F.transform(lines, entry), "\n"), F.lit("\n---"))


def watermark(text: Column) -> Column:
    """Code points of the text, at least three digits each, joined by zero-width spaces."""
    codes = F.transform(
        F.filter(F.split(text, ""), lambda c: c != ""),
        lambda c: F.when(F.ascii(c) < 100, F.lpad(F.ascii(c).cast("string"), 3, "0")).otherwise(
            F.ascii(c).cast("string")
        ),
    )
    return F.array_join(codes, "\u200b")
