"""Decoding, repair and checks of JSON answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a backslash that starts no JSON escape.
STRAY_ESCAPE = r'\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})'


def whole_json(v: Column) -> Column:
    """v if it is exactly one JSON value with nothing behind it, else null."""
    one = F.concat(F.lit("["), v, F.lit("]"))
    return F.when(F.json_array_length(one) == 1, v)


def bound(value: Column, f) -> Column:
    """f(value), with value evaluated once for a row however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _level(v: Column) -> Column:
    """struct(found, inner): v as an object, and what v holds if it is a JSON string."""
    strict = lambda x: F.coalesce(whole_json(x), whole_json(repair_escapes(x)))
    parts = lambda s: F.struct(F.when(F.startswith(s, F.lit("{")), s).alias("found"), F.when(F.startswith(s, F.lit('"')), F.get_json_object(s, "$")).alias("inner"))
    return bound(F.trim(v), lambda x: bound(strict(x), parts))


def decode_json_object(value: Column, max_depth: int = 3) -> Column:
    """JSON text of an object, out of up to max_depth nested string encodings; null if it is none. At
    each level stray escapes are dropped if the text does not decode with them."""
    deeper = lambda r: F.coalesce(r["found"], decode_json_object(r["inner"], max_depth - 1))
    return bound(_level(value), deeper if max_depth > 1 else lambda r: r["found"])


def repair_escapes(value: Column) -> Column:
    """value without the backslashes that start no escape."""
    return F.regexp_replace(value, STRAY_ESCAPE, "")


def fix_braces(value: Column) -> Column:
    """value with an opening and a closing brace, and as many of one as of the other."""
    opened = lambda v: F.when(F.startswith(v, F.lit("{")), v).otherwise(F.concat(F.lit("{"), v))
    closed = lambda v: F.when(F.endswith(v, F.lit("}")), v).otherwise(F.concat(v, F.lit("}")))
    gap = lambda v: F.regexp_count(v, F.lit(r"\{")) - F.regexp_count(v, F.lit(r"\}"))
    even = lambda v: bound(gap(v), lambda g: F.when(g > 0, F.concat(v, F.repeat(F.lit("}"), g))).when(g < 0, F.concat(F.repeat(F.lit("{"), -g), v)).otherwise(v))
    return bound(F.trim(value), lambda a: bound(opened(a), lambda b: bound(closed(b), even)))


def parse_answer(value: Column) -> Column:
    """The object of an answer: decoded, else decoded with its braces fixed."""
    return F.coalesce(decode_json_object(value), decode_json_object(fix_braces(value)))


def is_valid_json(value: Column) -> Column:
    """Whether an answer decodes to an object."""
    return decode_json_object(value).isNotNull()


def first_json_value(value: Column) -> Column:
    """The first JSON value where text trails it."""
    return F.get_json_object(value, "$")


def unique_last(m: Column) -> Column:
    """Map entries with the last value of a repeated key, at the key's first place."""
    entries = F.map_entries(m)
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))


def parse_bool(value: Column, strict: bool = False) -> Column:
    """true, 1, yes and false, 0, no in any case. Other text is false, or fails the job if strict."""
    v = F.lower(F.trim(value.cast("string")))
    other = F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(v, F.lit("null")))).cast("boolean") if strict else F.lit(False)
    return F.when(v.isin("true", "1", "1.0", "yes"), True).when(v.isin("false", "0", "0.0", "no"), False).otherwise(other)


def render_prompt(template: str, title: Column, paragraph: Column) -> Column:
    """The template with {title}, then {paragraph} (in the title too) filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("{title}"), title), F.lit("{paragraph}"), paragraph)


def answer_text(prediction: Column) -> Column:
    """A prediction (struct, map or array) as JSON text; null stays null."""
    return F.to_json(prediction)
