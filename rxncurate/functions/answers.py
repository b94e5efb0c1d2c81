"""The sections that a model's answer must have, read strictly: nothing is repaired here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxncurate.functions.jsonfix import bound, whole_json
from rxncurate.functions.literals import literal_json

#: Names of the sections (trimmed, in small letters).
COMPONENTS, PRODUCTS, STEPS = ("reactants, solvents, catalysts", "reactants"), ("product", "products"), ("reaction steps",)
#: What marks a reaction step and what unmarks it (small letters), and the arrow of a step.
REACTION, WORK_UP, ARROW = "reaction", "work-up", "->"


def _object(top: Column, keys: Column, names: tuple[str, ...]) -> Column:
    """JSON text of the first section with one of the names; null unless it is an object itself. A path over
    all items keeps the quotes of a string, so an object inside a string is told apart."""
    key = F.get(F.filter(keys, lambda k: F.lower(F.trim(k)).isin(*names)), F.lit(0))
    quoted = lambda k: F.concat(F.lit('"'), k, F.lit('"'))
    trimmed = lambda k: F.concat(F.lit("["), F.replace(top, quoted(k), quoted(F.trim(k))), F.lit("]"))  # noqa: E731 (a path can't begin with a space)
    found = lambda k: F.call_function("get_json_object", trimmed(k), F.concat(F.lit("$[*]['"), F.trim(k), F.lit("']")))
    return bound(bound(key, found), lambda v: F.when(F.startswith(v, F.lit("{")), v))


def structured_output(value: Column) -> Column:
    """struct(ok, steps): whether an answer is an object (JSON, or a literal) with its three sections as objects
    and reaction steps that all have an arrow; and how many reaction steps it has, if the sections are there.
    An object inside a string, or one that needs repair, is none."""

    def check(top: Column) -> Column:
        keys = F.map_keys(F.from_json(top, "map<string,string>"))
        section = lambda names: _object(top, keys, names)
        both = section(COMPONENTS).isNotNull() & section(PRODUCTS).isNotNull()
        entries = F.map_entries(F.from_json(F.when(both, section(STEPS)), "map<string,string>"))
        kind = lambda e: F.contains(F.lower(e["key"]), F.lit(REACTION)) & ~F.contains(F.lower(e["key"]), F.lit(WORK_UP))
        steps = F.coalesce(F.filter(entries, kind), F.array().cast("array<struct<key:string,value:string>>"))
        arrows = lambda k: F.forall(k, lambda e: F.coalesce(F.contains(e["value"], F.lit(ARROW)), F.lit(False)))
        return bound(steps, lambda k: F.struct(((F.size(k) > 0) & arrows(k)).alias("ok"), F.size(k).alias("steps")))

    none = F.struct(F.lit(False).alias("ok"), F.lit(0).alias("steps"))
    strict = lambda v: F.coalesce(F.when(F.startswith(v, F.lit("{")), whole_json(v)), literal_json(v))
    return bound(bound(F.trim(value), strict), lambda top: F.when(F.coalesce(F.startswith(top, F.lit("{")), F.lit(False)), check(top)).otherwise(none))
