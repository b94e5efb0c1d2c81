"""Cells that hold a list, a map or a single value as text, in JSON or as Python writes it.

A cell is cut into tokens; strings and names are rewritten one by one, and a fold over the tokens parts
tuples from brackets that only group. What comes out is JSON, which Spark's own functions read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxncurate.functions.jsonfix import bound, unique_last, whole_json

_SINGLE, _DOUBLE = r"'(?:[^'\\\n]|\\.)*+'", r'"(?:[^"\\\n]|\\.)*+"'
_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_TOKEN = rf"{_SINGLE}|{_DOUBLE}|{_NUMBER}|[A-Za-z_]+|[\[\](){{}},:]|\s+"
#: Names of a literal and what they are in JSON.
NAMES = {"None": "null", "True": "true", "False": "false", "null": "null", "true": "true", "false": "false"}
#: Fixed value: the text of a missing item among others.
NONE = "None"
#: Fixed value: why a cell is not read.
NOT_LITERAL = "not a list, map or value"


def _string(token: Column) -> Column:
    """A quoted token as a JSON string: its own escapes kept where JSON has them, else undone."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    # Pairs of backslashes stand aside, so that a backslash before a quote is an escape.
    aside = F.replace(inner, F.lit("\\\\"), F.lit("\x00"))
    aside = F.replace(F.replace(aside, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))
    aside = F.regexp_replace(aside, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    aside = F.regexp_replace(aside, r'\\(?![bfnrt/]|u[0-9a-fA-F]{4})', "\x00")
    out = F.replace(F.replace(aside, F.lit('"'), F.lit('\\"')), F.lit("\t"), F.lit("\\t"))
    return F.concat(F.lit('"'), F.replace(out, F.lit("\x00"), F.lit("\\\\")), F.lit('"'))


def _token(t: Column) -> Column:
    """A token in JSON; null if JSON has none."""
    first = F.substring(t, 1, 1)
    name = F
    for own, json in NAMES.items():
        name = name.when(t == own, F.lit(json))
    number = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"^(-?)\.", "$10."), r"\.(?!\d)", ".0")
    return (
        F.when(first.isin("'", '"'), _string(t)).when(F.rlike(first, F.lit(r"[0-9+\-.]")), number).when(F.rlike(first, F.lit(r"[A-Za-z_]")), name.otherwise(F.lit(None).cast("string")))
        .otherwise(t))


def _fold(s: Column, t: Column) -> Column:
    """out: tokens so far; open: where brackets were opened, whether it is a round one, and whether a comma
    stood in it; last: the token before."""
    top = F.try_element_at(s["open"], F.lit(-1))
    rest = F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))
    opens, closes, comma = t.isin("[", "{", "("), t.isin("]", "}", ")"), t == ","
    pushed = F.concat(s["open"], F.array(F.struct(F.size(s["out"]).alias("at"), (t == "(").alias("round"), F.lit(False).alias("comma"))))
    marked = F.concat(rest, F.array(F.struct(top["at"].alias("at"), top["round"].alias("round"), F.lit(True).alias("comma"))))
    # A round bracket with a comma, or with nothing, is a list; else it only groups.
    lists = top["comma"] | (s["last"] == "(")
    bare = F.when(closes & (s["last"] == ","), F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0)))).otherwise(s["out"])
    opened = F.transform(bare, lambda x, i: F.when(i == top["at"], F.when(lists, F.lit("[")).otherwise(F.lit(""))).otherwise(x))
    closed = F.when(top["round"], F.concat(opened, F.array(F.when(lists, F.lit("]")).otherwise(F.lit(""))))).otherwise(F.concat(bare, F.array(t)))
    return F.struct(
        F.when(closes & top.isNotNull(), closed).otherwise(F.concat(s["out"], F.array(t))).alias("out"),
        F.when(opens, pushed).when(closes, rest).when(comma & top.isNotNull(), marked).otherwise(s["open"]).alias("open"), t.alias("last"))


def literal_json(cell: Column) -> Column:
    """A cell as JSON text; null if it is neither JSON nor a literal of lists, tuples, maps, strings, numbers
    and the names in NAMES. A comma may end a list; a lone value in round brackets is that value."""
    # Tokens stand as they are unless a round bracket or a comma before a closing one calls for the fold.
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<struct<at:int,round:boolean,comma:boolean>>").alias("open"), F.lit("").alias("last"))
    fold = lambda json: F.array_join(F.aggregate(json, start, _fold, lambda s: s["out"]), "")
    plain = lambda json: ~F.array_contains(json, "(") & ~F.exists(F.zip_with(json, F.slice(json, F.lit(2), F.size(json)), lambda a, b: (a == ",") & b.isin("]", "}", ")")), lambda x: F.coalesce(x, F.lit(False)))
    folded = lambda json: whole_json(F.when(plain(json), F.array_join(json, "")).otherwise(fold(json)))
    said = lambda tokens: F.filter(tokens, lambda t: ~F.rlike(t, F.lit(r"^\s")))
    known = lambda json: F.when((F.size(json) > 0) & F.forall(json, lambda t: t.isNotNull()), folded(json))
    read = lambda v: bound(F.regexp_extract_all(v, F.lit(f"({_TOKEN})"), F.lit(1)), lambda tokens: F.when(F.array_join(tokens, "") == v, bound(F.transform(said(tokens), _token), known)))
    return bound(F.trim(cell), lambda v: F.coalesce(read(v), whole_json(v)))


def read_list(cell: Column) -> Column:
    """struct(items, error): literal_list and list_error of a cell, which is read once."""
    none = F.array().cast("array<string>")
    opens = F.rlike(F.trim(cell), F.lit(r"^[\[(]"))
    return F.when(is_blank(cell), F.struct(none.alias("items"), F.lit(None).cast("string").alias("error"))).otherwise(bound(literal_json(cell), lambda json: F.struct(
        F.coalesce(_items(cell, json), none).alias("items"), F.when(opens & json.isNull(), F.lit(NOT_LITERAL)).alias("error"))))


def read_map(cell: Column) -> Column:
    """struct(entries, error): literal_map and map_error of a cell, which is read once."""
    return bound(literal_map(cell), lambda m: F.struct(m.alias("entries"), F.when(m.isNull(), F.lit(NOT_LITERAL)).alias("error")))


def is_blank(cell: Column) -> Column:
    """Whether a cell holds nothing."""
    return F.coalesce(F.trim(cell), F.lit("")) == ""


def _items(cell: Column, json: Column) -> Column:
    """Items of a list, or of a single value; null items stay. Text that is no literal is one item."""
    listed = F.from_json(json, "array<string>")
    single = F.get(F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(json.isNull(), F.array(cell)).when(F.startswith(json, F.lit("[")), listed).otherwise(F.array(single))


def literal_list(cell: Column) -> Column:
    """A cell as an array of texts, null where an item is None; the empty array where it is blank. A single
    value, or text that is no literal, is an array of one."""
    none = F.array().cast("array<string>")
    return F.when(is_blank(cell), none).otherwise(bound(literal_json(cell), lambda json: F.coalesce(_items(cell, json), none)))


def literal_map(cell: Column) -> Column:
    """A cell as a map of texts, null where a value is None; of a repeated key the last value. The empty map
    where it is blank, null where it is no map."""
    none = F.create_map().cast("map<string,string>")
    read = lambda json: F.when(F.startswith(json, F.lit("{")), F.map_from_entries(unique_last(F.from_json(json, "map<string,string>"))))
    return F.when(is_blank(cell), none).otherwise(bound(literal_json(cell), read))


def list_error(cell: Column) -> Column:
    """Why a cell cannot be a list: it opens one but is no literal; null if it can."""
    return F.when(F.rlike(F.trim(cell), F.lit(r"^[\[(]")) & literal_json(cell).isNull(), F.lit(NOT_LITERAL))


def map_error(cell: Column) -> Column:
    """Why a cell cannot be a map; null if it can."""
    return F.when(literal_map(cell).isNull() & ~is_blank(cell), F.lit(NOT_LITERAL))


def component_list(cell: Column) -> Column:
    """Trimmed texts of a cell's items without empty ones; a missing item reads None."""
    return F.filter(F.transform(literal_list(cell), lambda x: F.trim(F.coalesce(x, F.lit(NONE)))), lambda x: x != "")
