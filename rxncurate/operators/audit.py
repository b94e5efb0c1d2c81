"""Audit of ground-truth labels: elements, maps, roles and risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxncurate.functions.structure import looks_valid, read_structures

#: Fixed value: more changed bonds than this are a large centre.
LARGE_CENTRE = 8
#: Reasons of the label audit with their conditions, critical ones first.
CRITICAL_REASONS = (
    ("invalid SMILES", "invalid_smiles_count > 0"),
    ("product contains an element absent from all inputs", "element_deficit_flag"),
    ("atom mapping failed", "coalesce(mapping_error, '') <> '' OR coalesce(mapped_reaction, '') = ''"),
    ("product atom mapping incomplete", "NOT product_mapping_complete"),
    ("duplicate atom-map numbers", "duplicate_atom_maps > 0"),
    ("atom-map element mismatch", "atom_element_mismatch > 0"),
)
REVIEW_REASONS = (
    ("reagent contributes product atoms", "CAST(reagent_contributes_to_product AS INT) > 0"),
    ("reactant contributes no product atoms", "CAST(noncontributing_reactant AS INT) > 0"),
    ("mapped and labeled components do not align", "role_assignment_unmatched_components > 0"),
    ("no mapped covalent/charge change", "no_detectable_transformation"),
    ("unusually large reaction center", "large_reaction_center"),
    ("LocalMapper marked mapping unconfident", "NOT mapping_confident"),
    ("no mapping template", "coalesce(mapping_template, '') = ''"),
    ("same structure labeled as reactant and reagent", "role_overlap_count > 0"),
    ("a product is also present on the input side", "product_reactant_overlap_count > 0 OR product_reagent_overlap_count > 0"),
    ("possible flattened multistep sequence", "multistep_model_count >= 2 AND product_count > 1"),
    ("validated ground truth has no model support", "relaxed_model_support_count = 0"),
    ("reactant and product structure sets are identical", "identical_reactant_product"),
)


def element_counts(components: DataFrame) -> DataFrame:
    """(rxn_id, side, element, n): heavy atoms of (rxn_id, side, smiles)."""
    symbol = F.regexp_extract("a", r"^\[?\d*([A-Z][a-z]?|se|as|te|[bcnops])", 1)
    atoms = F.explode(F.regexp_extract_all("smiles", F.lit(r"(\[[^\]]*\]|Cl|Br|[BCNOPSFIbcnops])"), F.lit(1))).alias("a")
    found = components.select("rxn_id", "side", atoms).select("rxn_id", "side", F.initcap(symbol).alias("element"))
    return found.where("element <> 'H' AND element <> ''").groupBy("rxn_id", "side", "element").agg(F.count(F.lit(1)).alias("n"))


def invalid_components(components: DataFrame, valid=looks_valid) -> DataFrame:
    """(rxn_id, invalid_smiles_count, invalid_smiles) of (rxn_id, pos, smiles): the unreadable ones in
    order of position, for every reaction."""
    bad = F.when(~valid(F.col("smiles")), F.struct("pos", "smiles"))
    listed = components.groupBy("rxn_id").agg(F.array_sort(F.collect_list(bad)).alias("b"))
    return listed.select("rxn_id", F.size("b").alias("invalid_smiles_count"), F.array_join(F.transform("b", lambda x: x["smiles"]), " | ").alias("invalid_smiles"))


def element_deficit(counts: DataFrame) -> DataFrame:
    """(rxn_id, element, deficit): atoms of the product side that the input side lacks; only lacking ones."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0))
    both = counts.groupBy("rxn_id", "element").agg(side("product").alias("p"), side("input").alias("i"))
    return both.select("rxn_id", "element", F.greatest(F.col("p") - F.col("i"), F.lit(0)).alias("deficit")).where("deficit > 0")


def role_overlap(components: DataFrame) -> DataFrame:
    """(rxn_id, reactant_reagent, reactant_product, reagent_product, same_sides): shared components of
    the roles as multisets, and whether reactants and products are equal, of (rxn_id, role, comp)."""
    n = lambda r: F.sum(F.when(F.col("role") == r, 1).otherwise(0))
    c = components.groupBy("rxn_id", "comp").agg(n("reactants").alias("a"), n("reagents").alias("b"), n("products").alias("p"))
    return c.groupBy("rxn_id").agg(F.sum(F.least("a", "b")).alias("reactant_reagent"), F.sum(F.least("a", "p")).alias("reactant_product"), F.sum(F.least("b", "p")).alias("reagent_product"), F.min((F.col("a") == F.col("p")).cast("int")).alias("same_sides"))


def assign_left_roles(left: DataFrame, labels: DataFrame) -> DataFrame:
    """left (rxn_id, pos, comp) with the role that consumes it: labelled reactants of the key first, then
    reagents, else unknown. labels: (rxn_id, role, comp)."""
    n = lambda r: F.sum(F.when(F.col("role") == r, 1).otherwise(0))
    have = labels.groupBy("rxn_id", "comp").agg(n("reactants").alias("a"), n("reagents").alias("b"))
    rank = F.row_number().over(Window.partitionBy("rxn_id", "comp").orderBy("pos"))
    joined = left.withColumn("r", rank).join(have, ["rxn_id", "comp"], "left").fillna(0, ["a", "b"])
    role = F.when(F.col("r") <= F.col("a"), "reactants").when(F.col("r") <= F.col("a") + F.col("b"), "reagents").otherwise("unknown")
    return joined.select("rxn_id", "pos", "comp", role.alias("role"))


def unmatched_labels(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """(rxn_id, unmatched): labelled reactants and reagents that no left component used up, and left components
    of unknown role. One aggregation of both."""
    want = labels.where(F.col("role") != "products").select("rxn_id", F.lit(1).alias("n"))
    used = assigned.select("rxn_id", F.when(F.col("role") == "unknown", 1).otherwise(-1).alias("n"))
    return want.unionByName(used).groupBy("rxn_id").agg(F.sum("n").alias("unmatched"))


def map_audit(atoms: DataFrame) -> DataFrame:
    """For each rxn_id of (rxn_id, side, map, element), map 0 meaning none: unmapped product atoms, maps that
    repeat on either side, product maps that the left lacks (all of heavy atoms), and maps whose element
    differs. Atoms are dealt by reaction once; maps are folded on that dealing, then reactions."""
    heavy = F.col("element") != "H"
    n = lambda side: F.count_if((F.col("side") == side) & heavy)
    element = lambda side: F.min(F.when(F.col("side") == side, F.col("element")))
    per_map = atoms.repartition("rxn_id").groupBy("rxn_id", "map").agg(n("product").alias("p"), n("input").alias("i"), element("product").alias("pe"), element("input").alias("ie"))
    mapped = F.col("map") > 0
    out = per_map.groupBy("rxn_id").agg(
        F.sum("p").alias("_atoms"), F.sum(F.when(~mapped, F.col("p")).otherwise(0)).alias("unmapped"), F.count_if(mapped & ((F.col("p") > 1) | (F.col("i") > 1))).alias("duplicate_maps"),
        F.count_if(mapped & (F.col("p") > 0) & (F.col("i") == 0)).alias("missing_left"), F.count_if(mapped & (F.col("pe") != F.col("ie"))).alias("element_mismatch"))
    return out.where("_atoms > 0").drop("_atoms")


def bond_changes(bonds: DataFrame) -> DataFrame:
    """Formed, broken and order-changed bonds of (rxn_id, side, a, b, bond_order) between mapped atoms, and
    the centre's size class. Both sides meet by a union on the bond."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("bond_order")))
    both = bonds.groupBy("rxn_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(side("input").alias("i"), side("product").alias("p"))
    out = both.groupBy("rxn_id").agg(F.count_if(F.col("i").isNull()).alias("formed"), F.count_if(F.col("p").isNull()).alias("broken"), F.count_if(F.col("i") != F.col("p")).alias("changed"))
    size = F.col("formed") + F.col("broken") + F.col("changed")
    return out.withColumn("centre", size).withColumn("centre_class", F.when(size == 0, "none").when(size > LARGE_CENTRE, "large").otherwise("normal"))


def reaction_centre(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """For each rxn_id of atoms (rxn_id, side, map, charge) and bonds (rxn_id, side, map_a, map_b,
    bond_order), side being input or product and map 0 none: formed, broken and order-changed bonds
    between atoms of the product, bonds of the input that a leaving group had (counted as broken too),
    charge changes, their sum, and whether there is none or more than LARGE_CENTRE."""
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    per_atom = atoms.where("map > 0").groupBy("rxn_id", "map").agg(of("input", "charge").alias("i"), of("product", "charge").alias("p"))
    in_product = per_atom.where("p IS NOT NULL").select("rxn_id", "map")
    ends = [in_product.withColumnRenamed("map", f"map_{e}").withColumn(f"_{e}", F.lit(True)) for e in "ab"]
    seen = bonds.join(ends[0], ["rxn_id", "map_a"], "left").join(ends[1], ["rxn_id", "map_b"], "left")
    a, b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    leaving = seen.where((F.col("side") == "input") & (a != b)).groupBy("rxn_id").agg(F.count(F.lit(1)).alias("leaving_group_bonds"))
    kept = seen.where((F.col("map_a") > 0) & (F.col("map_b") > 0) & ((F.col("side") == "product") | a & b))
    both = kept.groupBy("rxn_id", F.least("map_a", "map_b").alias("x"), F.greatest("map_a", "map_b").alias("y")).agg(of("input", "bond_order").alias("i"), of("product", "bond_order").alias("p"))
    changes = both.groupBy("rxn_id").agg(
        F.count_if(F.col("i").isNull()).alias("formed_bonds"), F.count_if(F.col("p").isNull()).alias("_broken"), F.count_if(F.col("i") != F.col("p")).alias("bond_order_changes"))
    charges = per_atom.groupBy("rxn_id").agg(F.count_if(F.col("i") != F.col("p")).alias("atom_charge_changes"))
    every = atoms.select("rxn_id").distinct()
    out = every.join(changes, "rxn_id", "left").join(charges, "rxn_id", "left").join(leaving, "rxn_id", "left").fillna(0)
    out = out.withColumn("broken_bonds", F.col("_broken") + F.col("leaving_group_bonds")).drop("_broken")
    size = F.col("formed_bonds") + F.col("broken_bonds") + F.col("bond_order_changes") + F.col("atom_charge_changes")
    return out.withColumn("centre_size", size).withColumn("no_detectable_transformation", size == 0).withColumn("large_reaction_center", size > LARGE_CENTRE)


def structure_parts(components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms, bonds) as reaction_centre and map_audit take them, of components (rxn_id, side, smiles),
    each distinct one read once."""
    read = components.join(read_structures(components, "smiles"), "smiles")
    atoms = read.select("rxn_id", "side", F.explode("atoms").alias("a")).select("rxn_id", "side", "a.map", "a.charge", "a.element")
    bonds = read.select("rxn_id", "side", F.explode("bonds").alias("b")).select("rxn_id", "side", "b.map_a", "b.map_b", "b.bond_order")
    return atoms, bonds


def role_contradictions(assigned: DataFrame) -> DataFrame:
    """Reagents that share product maps and reactants that share none, of (rxn_id, role, shares)."""
    return assigned.groupBy("rxn_id").agg(F.count_if((F.col("role") == "reagents") & F.col("shares")).alias("reagents_contributing"), F.count_if((F.col("role") == "reactants") & ~F.col("shares")).alias("reactants_idle"))


def risk_levels(df: DataFrame, critical: Sequence[tuple[str, str]] = CRITICAL_REASONS, review: Sequence[tuple[str, str]] = REVIEW_REASONS) -> DataFrame:
    """df with risk_level (critical, manual_review or pass) and risk_reasons, those whose condition holds."""
    held = lambda rules: F.filter(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    out = df.withColumn("_c", held(critical)).withColumn("_r", held(review))
    level = F.when(F.size("_c") > 0, "critical").when(F.size("_r") > 0, "manual_review").otherwise("pass")
    return out.withColumn("risk_level", level).withColumn("risk_reasons", F.array_join(F.concat("_c", "_r"), "; ")).drop("_c", "_r")


#: Order of risk levels.
RISK_ORDER = ("critical", "manual_review", "pass")


def risk_order(risks: DataFrame) -> DataFrame:
    """Critical ones first, then less support, idx, slot; a global sort, for the sink alone."""
    level = F.array_position(F.array(*[F.lit(x) for x in RISK_ORDER]), F.col("risk_level"))
    return risks.orderBy(level, "relaxed_model_support_count", "idx", "slot")


def audit_summary(risks: DataFrame) -> DataFrame:
    """By level, and over all (level null): rows, rows with any reason, with complete mapping, with a confident
    one, without a detectable change, with a role that maps contradict (a reagent that gives product atoms or a
    reactant that gives none), and without any model's support."""
    contradicted = F.expr("CAST(reagent_contributes_to_product AS INT) > 0 OR CAST(noncontributing_reactant AS INT) > 0")
    return risks.rollup("risk_level").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("risk_reasons") != "").alias("with_reasons"), F.count_if("product_mapping_complete").alias("mapping_complete"),
        F.count_if("mapping_confident").alias("mapping_confident"), F.count_if("no_detectable_transformation").alias("no_detectable_transformation"), F.count_if(contradicted).alias("role_mismatch"), F.count_if(F.col("relaxed_model_support_count") == 0).alias("without_support"))
