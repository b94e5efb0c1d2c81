"""The audit of accepted reactions, from their strings: labelled components, and the mapped reaction.

A reaction's parts, atoms and bonds fit its row, so all figures are expressions on that row. Only the keys
of its components come from elsewhere: from the dimension of structures, by one join and one dealing by ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxncurate.functions.jsonfix import bound
from rxncurate.functions.reactions import BAD_SECTIONS, components, remove_maps
from rxncurate.functions.structure import atom_symbols, looks_valid, read
from rxncurate.operators.audit import LARGE_CENTRE
from rxncurate.operators.once import once_each
from rxncurate.operators.structures import mapped_key, structure_table, with_key_map

#: What is told of a mapped reaction, in order.
BAD_FORMAT, BAD_STRUCTURE = "invalid mapped reaction format", "invalid or empty mapped structure"
DETAILS = (
    ("NOT product_mapping_complete", "incomplete product atom mapping"), ("duplicate_atom_maps > 0", "duplicate atom-map numbers"), ("atom_element_mismatch > 0", "mapped atom changes element"),
    ("reagent_contributes_to_product > 0", "a labeled reagent contributes product atoms"), ("noncontributing_reactant > 0", "a labeled reactant contributes no product atoms"),
    ("role_assignment_unmatched_components > 0", "mapped components could not be matched to labeled roles"), ("no_detectable_transformation", "no mapped bond/charge change"),
    ("large_reaction_center", "unusually large reaction center"))
#: Figures of a mapped reaction: numbers, and the flags among them.
COUNTS = (
    "duplicate_atom_maps", "atom_element_mismatch", "reagent_contributes_to_product", "noncontributing_reactant", "role_assignment_unmatched_components", "formed_bonds", "broken_bonds",
    "bond_order_changes", "leaving_group_bonds", "atom_charge_changes")
FLAGS = ("product_mapping_complete", "no_detectable_transformation", "large_reaction_center")
ROLES = ("reactants", "reagents", "products")


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _count(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda v: v == x))


def shared(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(_count(a, x), _count(b, x)))


def split_labels(reaction: Column) -> Column:
    """struct(ok, reactants, reagents, products) of an accepted reaction: trimmed components without empty ones;
    not ok, and empty, unless there are two or three sections."""
    parts = lambda s: F.filter(F.transform(F.split(s, r"\."), lambda c: F.trim(c)), lambda c: c != "")

    def roles(s: Column) -> Column:
        ok, n = F.size(s).isin(2, 3), F.size(s)
        side = lambda i, some: F.when(some, parts(F.get(s, i))).otherwise(_none("string"))
        return F.struct(ok.alias("ok"), side(F.lit(0), ok).alias("reactants"), side(F.lit(1), n == 3).alias("reagents"), side(n - 1, ok).alias("products"))

    return bound(F.split(F.trim(reaction), ">", -1), roles)


def deficit_text(inputs: Column, products: Column) -> Column:
    """JSON text of the heavy atoms, by element, that products have more of than inputs."""

    def compare(x: Column) -> Column:
        lacking = F.transform(F.array_sort(F.array_distinct(x["p"])), lambda e: F.struct(e.alias("e"), (_count(x["p"], e) - _count(x["i"], e)).alias("n")))
        texts = F.transform(F.filter(lacking, lambda d: d["n"] > 0), lambda d: F.concat(F.lit('"'), d["e"], F.lit('": '), d["n"].cast("string")))
        return F.concat(F.lit("{"), F.array_join(texts, ", "), F.lit("}"))

    return bound(F.struct(atom_symbols(inputs).alias("i"), atom_symbols(products).alias("p")), compare)


def _sides(mapped: Column) -> Column:
    """struct(format_ok, left, right): components of a mapped reaction, all sections but the last on the left."""

    def sides(s: Column) -> Column:
        ok = F.size(s).isin(2, 3)
        left = F.flatten(F.transform(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(1))), components))
        return F.struct(ok.alias("format_ok"), F.when(ok, left).otherwise(_none("string")).alias("left"), F.when(ok, components(F.element_at(s, -1))).otherwise(_none("string")).alias("right"))

    return bound(F.split(F.coalesce(mapped, F.lit("")), ">", -1), sides)


def _heavy(atoms: Column) -> Column:
    return F.filter(atoms, lambda a: ~a["element"].isin("H", "*"))


def _maps(atoms: Column) -> Column:
    return F.transform(F.filter(_heavy(atoms), lambda a: a["map"] > 0), lambda a: a["map"])


def _all(parts: Column, field: str) -> Column:
    return F.flatten(F.transform(parts, lambda s: s[field]))


def _atom_figures(x: Column) -> dict[str, Column]:
    """Of x (left_atoms, right_atoms, left_maps, right_maps)."""
    of = lambda atoms, m: F.try_element_at(F.filter(atoms, lambda a: a["map"] == m), F.lit(-1))
    every = lambda atoms: F.array_distinct(F.filter(F.transform(atoms, lambda a: a["map"]), lambda m: m > 0))
    both = F.transform(F.array_intersect(every(x["left_atoms"]), every(x["right_atoms"])), lambda m: F.struct(of(x["left_atoms"], m).alias("l"), of(x["right_atoms"], m).alias("r")))
    repeats = lambda maps: F.size(F.array_distinct(maps)) < F.size(maps)
    complete = (F.size(F.array_distinct(x["right_maps"])) == F.size(_heavy(x["right_atoms"]))) & ~repeats(x["right_maps"]) & (F.size(F.array_except(x["right_maps"], x["left_maps"])) == 0)
    return {
        "product_mapping_complete": complete, "duplicate_atom_maps": (repeats(x["left_maps"]) | repeats(x["right_maps"])).cast("int"),
        "atom_element_mismatch": F.exists(both, lambda p: p["l"]["element"] != p["r"]["element"]).cast("int"),
        "atom_charge_changes": F.size(F.filter(both, lambda p: p["l"]["charge"] != p["r"]["charge"]))}


def _bond_figures(x: Column) -> dict[str, Column]:
    """Of x (left_bonds, right_bonds, right_maps)."""
    inside = lambda m: F.array_contains(x["right_maps"], m)
    ends = lambda b: F.struct(F.least(b["map_a"], b["map_b"]).alias("x"), F.greatest(b["map_a"], b["map_b"]).alias("y"))
    mapped = lambda bonds: F.transform(F.filter(bonds, lambda b: (b["map_a"] > 0) & (b["map_b"] > 0)), lambda b: F.struct(ends(b).alias("k"), b["bond_order"].alias("o")))
    kept = F.filter(x["left_bonds"], lambda b: inside(b["map_a"]) & inside(b["map_b"]))
    leaving = F.size(F.filter(x["left_bonds"], lambda b: inside(b["map_a"]) != inside(b["map_b"])))

    def compare(y: Column) -> Column:
        keys = lambda bonds: F.array_distinct(F.transform(bonds, lambda b: b["k"]))
        order = lambda bonds, k: F.element_at(F.filter(bonds, lambda b: b["k"] == k), -1)["o"]
        left, right = keys(y["l"]), keys(y["r"])
        changed = F.filter(F.array_intersect(left, right), lambda k: order(y["l"], k) != order(y["r"], k))
        return F.struct(F.size(F.array_except(right, left)).alias("formed"), F.size(F.array_except(left, right)).alias("lost"), F.size(changed).alias("changed"), y["leaving"].alias("leaving"))

    found = bound(F.struct(mapped(kept).alias("l"), mapped(x["right_bonds"]).alias("r"), leaving.alias("leaving")), compare)
    return {"_bonds": found}


def assigned_roles(left: Column, reactants: Column, reagents: Column) -> Column:
    """The role that uses up each key of left: labelled reactants of the key first, then reagents, else unknown."""
    rank = lambda k, i: _count(F.slice(left, F.lit(1), i + 1), k)
    role = lambda k, i: F.when(rank(k, i) <= _count(reactants, k), "reactant").when(rank(k, i) <= _count(reactants, k) + _count(reagents, k), "reagent").otherwise("unknown")
    return F.transform(left, role)


def audit_reactions(candidates: DataFrame, ids: Sequence[str] = ("idx", "slot"), dimension: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """candidates (ids, reaction_smiles: an accepted reaction, mapped_reaction: what a mapper made of it; other
    columns stay) with, of the labels: counts of each role, invalid_smiles_count and invalid_smiles (in order),
    element_deficit (JSON) and its flag (none where a part cannot be read), overlaps of the roles' structures
    and whether reactants and products are the same, and label_error where there are not two or three
    sections; of the mapping: completeness of the products' maps, maps that repeat on either side, changed
    elements and charges, roles contradicted by maps, mapped components and labels that do not align, bonds
    formed, broken, changed in order and left with a group, no or a large centre, and mapping_detail.

    Maps of hydrogens count for elements and charges alone. Structures are told by keys with charges and
    without stereo. A mapped reaction of other sections, or with a part that cannot be read, has figures of
    zero and says so in mapping_detail. dimension: see with_key_map. texts: a table of the components of both reactions (text),
    cheaper to read than candidates; components that are few are read once each (see once_each)."""
    out = candidates.withColumn("_l", split_labels(F.col("reaction_smiles"))).withColumn("_m", _sides(F.col("mapped_reaction")))
    out = out.withColumns({r: F.col(f"_l.{r}") for r in ROLES} | {"_plain": F.transform("_m.left", remove_maps)})
    if texts is None:
        texts = out.select(F.explode(F.concat(*ROLES, "_m.left", "_m.right")).alias("text"))
    elif dimension is None:
        dimension = structure_table(texts.select(F.explode(F.array(F.trim("text"), remove_maps(F.col("text")))).alias("text")))
    parts = once_each(texts, read)
    out = with_key_map(out, ids, (*ROLES, "_plain"), dimension, strict=True, whole=True)
    key = lambda c: F.coalesce(mapped_key(c), F.lit(""))
    out = out.withColumns({f"_{r}": F.transform(r, key) for r in ROLES} | {"_left": F.transform("_plain", key)})
    bad = F.filter(F.concat(*ROLES), lambda c: mapped_key(c).isNull())
    out = out.withColumn("_bad", bad).withColumns({f"{r[:-1]}_count": F.size(r) for r in ROLES} | {
        "invalid_smiles_count": F.when(F.col("_l.ok"), F.size("_bad")).otherwise(1), "invalid_smiles": F.array_join("_bad", " | "),
        "element_deficit": F.when(F.size("_bad") == 0, deficit_text(F.concat("reactants", "reagents"), F.col("products"))).otherwise("{}"),
        "identical_reactant_product": F.col("_l.ok") & (F.array_sort("_reactants") == F.array_sort("_products")), "role_overlap_count": shared(F.col("_reactants"), F.col("_reagents")),
        "product_reactant_overlap_count": shared(F.col("_products"), F.col("_reactants")), "product_reagent_overlap_count": shared(F.col("_products"), F.col("_reagents")),
        "label_error": F.when(~F.col("_l.ok"), BAD_SECTIONS)})
    out = out.withColumn("element_deficit_flag", F.col("element_deficit") != "{}")

    out = out.withColumns({"_sl": F.transform("_m.left", parts), "_sr": F.transform("_m.right", parts)})
    readable = (F.size("_sl") > 0) & (F.size("_sr") > 0) & F.forall("_sl", lambda s: s["valid"]) & F.forall("_sr", lambda s: s["valid"])
    own = F.struct(
        _all(F.col("_sl"), "atoms").alias("left_atoms"), _all(F.col("_sr"), "atoms").alias("right_atoms"), _all(F.col("_sl"), "bonds").alias("left_bonds"), _all(F.col("_sr"), "bonds").alias("right_bonds"),
        _maps(_all(F.col("_sl"), "atoms")).alias("left_maps"), _maps(_all(F.col("_sr"), "atoms")).alias("right_maps"))
    out = out.withColumns({"_ok": readable, "_x": own, "_roles": assigned_roles(F.col("_left"), F.col("_reactants"), F.col("_reagents"))})
    gives = F.transform("_sl", lambda s: F.coalesce(F.arrays_overlap(_maps(s["atoms"]), F.col("_x.right_maps")), F.lit(False)))
    out = out.withColumns(_atom_figures(F.col("_x")) | _bond_figures(F.col("_x")) | {"_used": F.arrays_zip(F.col("_roles").alias("role"), gives.alias("gives"))})
    used = lambda role, given: F.size(F.filter("_used", lambda u: (u["role"] == role) & (u["gives"] == given)))
    unknown = F.size(F.filter("_roles", lambda r: r == "unknown"))
    out = out.withColumns({
        "reagent_contributes_to_product": used("reagent", True), "noncontributing_reactant": used("reactant", False),
        "role_assignment_unmatched_components": unknown + F.size("reactants") + F.size("reagents") - (F.size("_roles") - unknown),
        "leaving_group_bonds": F.col("_bonds.leaving"), "bond_order_changes": F.col("_bonds.changed"), "formed_bonds": F.col("_bonds.formed"), "broken_bonds": F.col("_bonds.lost") + F.col("_bonds.leaving")})
    size = F.col("bond_order_changes") + F.col("formed_bonds") + F.col("broken_bonds") + F.col("atom_charge_changes")
    out = out.withColumns({"no_detectable_transformation": size == 0, "large_reaction_center": size > LARGE_CENTRE})
    out = out.withColumns({c: F.when(F.col("_ok"), F.col(c)).otherwise(0) for c in COUNTS} | {c: F.col("_ok") & F.col(c) for c in FLAGS})
    told = F.array_join(F.filter(F.array(*[F.when(F.expr(rule), F.lit(text)) for rule, text in DETAILS]), lambda t: t.isNotNull()), "; ")
    detail = F.when(~F.col("_m.format_ok"), BAD_FORMAT).when(~F.col("_ok"), BAD_STRUCTURE).otherwise(told)
    extra = [f"_{r}" for r in ROLES] + ["_l", "_m", "_plain", "_left", "_bad", "_sl", "_sr", "_ok", "_x", "_roles", "_used", "_bonds", "structure_keys"]
    return out.withColumn("mapping_detail", detail).drop(*extra)
