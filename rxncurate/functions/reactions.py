"""Reaction strings, atom maps and roles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxncurate.functions.jsonfix import bound
from rxncurate.functions.structure import looks_valid


def _none() -> Column:
    return F.array().cast("array<string>")


def sections(reaction: Column) -> Column:
    """Texts between the > signs."""
    return F.split(F.trim(reaction), ">", -1)


def components(section: Column) -> Column:
    """Non-empty parts between dots."""
    return F.filter(F.split(section, r"\."), lambda x: x != "")


def split_reaction(reaction: Column, strict: bool = False) -> Column:
    """struct(reactants, reagents, products). Two sections have no reagents; other numbers than two or
    three give empty roles, or fail the job if strict."""
    s = sections(reaction)
    n = F.size(s)
    bad = F.raise_error(F.lit("a reaction has two or three sections")).cast("array<string>") if strict else _none()
    role = lambda i: F.when(n.isin(2, 3), components(F.get(s, i))).otherwise(bad)
    return F.struct(role(F.lit(0)).alias("reactants"), F.when(n == 3, components(F.get(s, F.lit(1)))).otherwise(_none()).alias("reagents"), role(n - 1).alias("products"))


def reaction_text(reactants: Column, reagents: Column, products: Column) -> Column:
    """Reaction string of role lists."""
    return F.concat_ws(">", *[F.array_join(c, ".") for c in (reactants, reagents, products)])


def substitute_codes(skeleton: Column, smiles: Column) -> Column:
    """Codes of a skeleton replaced by their structures; unknown codes stay."""
    one = lambda s: F.array_join(F.transform(F.split(s, r"\."), lambda c: F.coalesce(F.element_at(smiles, c), c)), ".")
    return F.array_join(F.transform(F.split(skeleton, ">", -1), one), ">")


#: Why a reaction has no mapper input.
EMPTY_REACTION = "Reaction SMILES is empty."
UNRESOLVED_REACTION = "Reaction contains an unresolved (NoSmi) compound."
ONE_SECTION = "Reaction must contain at least one '>' separator between reactants and products."
EMPTY_SIDE = "Reaction must contain both reactants and products."
#: Fixed value: why a reaction cannot be split into roles.
BAD_SECTIONS = "Reaction SMILES must contain two or three sections."


def mapper_input(reaction: Column) -> tuple[Column, Column]:
    """(value, error): the form left>>products that a mapper takes, all sections but the last on the
    left; or why there is none. A reaction that is itself an error text gives that text."""
    r = F.trim(reaction)
    s = F.split(r, ">", -1)
    left = F.array_join(F.filter(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda x: x != ""), ".")
    right = F.element_at(s, -1)
    error = (
        F.when(r.isNull() | (r == ""), EMPTY_REACTION).when(F.contains(r, F.lit("(NoSmi)")), UNRESOLVED_REACTION).when(F.contains(r, F.lit("Error:")), r)
        .when(F.size(s) < 2, ONE_SECTION).when((left == "") | (right == ""), EMPTY_SIDE)
    )
    return F.when(error.isNull(), F.concat(left, F.lit(">>"), right)), error


def atom_maps(component: Column) -> Column:
    """Distinct positive atom-map numbers of a component."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(component, F.lit(r":(\d+)\]"), F.lit(1)), lambda x: x.cast("int")), lambda n: n > 0))


def strip_metadata(reaction: Column) -> Column:
    """The reaction before the first white space."""
    return F.element_at(F.split(F.trim(reaction), r"\s+"), 1)


def remove_maps(component: Column) -> Column:
    """A component without its atom-map numbers."""
    return F.regexp_replace(component, r":\d+\]", "]")


def all_maps(components_: Column) -> Column:
    """Distinct atom-map numbers of several components."""
    return F.array_distinct(F.flatten(F.transform(components_, atom_maps)))


def _shares(c: Column, maps: Column) -> Column:
    return F.coalesce(F.arrays_overlap(atom_maps(c), maps), F.lit(False))


def roles_of_source(reaction: Column, valid=looks_valid) -> Column:
    """Roles by maps shared with the products, of left and middle components alike; products stay as they are;
    null unless there are three sections. Maps of what cannot be read do not count: such a component is a
    reagent, and such a product shares nothing."""

    def roles(s: Column) -> Column:
        products = components(F.get(s, F.lit(2)))
        candidates = F.concat(components(F.get(s, F.lit(0))), components(F.get(s, F.lit(1))))
        # One look at all parts: those that carry maps and can be read.
        mapped = lambda parts: F.transform(parts, lambda c: F.struct(c.alias("c"), F.when(F.contains(c, F.lit(":")), valid(c)).otherwise(False).alias("ok")))
        told = F.transform(F.array(candidates, products), mapped)
        texts = lambda parts: F.transform(parts, lambda y: y["c"])
        gives = lambda y, m: y["ok"] & _shares(y["c"], m)
        split = lambda x: F.struct(
            texts(F.filter(x["c"], lambda y: gives(y, x["m"]))).alias("reactants"), texts(F.filter(x["c"], lambda y: ~gives(y, x["m"]))).alias("reagents"), products.alias("products"))
        return bound(bound(told, lambda t: F.struct(F.get(t, F.lit(0)).alias("c"), all_maps(texts(F.filter(F.get(t, F.lit(1)), lambda y: y["ok"]))).alias("m"))), split)

    return bound(sections(strip_metadata(reaction)), lambda s: F.when(F.size(s) == 3, roles(s)))


def mapped_roles(reaction: Column, valid=looks_valid) -> Column:
    """struct(reactants, reagents, products, complete) of one mapped reaction, maps kept: left components by shared
    maps, the middle left out, unreadable ones dropped. complete: both sides, readable throughout, with maps in
    the products."""

    def roles(x: Column) -> Column:
        both = (F.size(x["left"]) > 0) & (F.size(x["right"]) > 0)
        kept = F.transform(F.array(x["left"], x["right"]), lambda parts: F.filter(parts, valid))
        return bound(bound(kept, lambda k: F.struct(F.get(k, F.lit(0)).alias("left"), F.get(k, F.lit(1)).alias("right"), all_maps(F.get(k, F.lit(1))).alias("m"))), lambda y: F.struct(
            F.when(both, F.filter(y["left"], lambda c: _shares(c, y["m"]))).otherwise(_none()).alias("reactants"),
            F.when(both, F.filter(y["left"], lambda c: ~_shares(c, y["m"]))).otherwise(_none()).alias("reagents"),
            F.when(both, y["right"]).otherwise(_none()).alias("products"),
            (both & (F.size(y["left"]) == F.size(x["left"])) & (F.size(y["right"]) == F.size(x["right"])) & (F.size(y["m"]) > 0)).alias("complete")))

    parts = lambda s: F.when(F.size(s).isin(2, 3), F.struct(components(F.get(s, F.lit(0))).alias("left"), components(F.element_at(s, -1)).alias("right"))).otherwise(F.struct(_none().alias("left"), _none().alias("right")))
    return bound(bound(F.split(reaction, ">", -1), parts), roles)


def mapped_components(mapped: Column, valid=looks_valid, roles=None) -> Column:
    """struct(reactants, reagents, products, mapped_reactants, mapped_reagents, mapped_products, complete)
    of an array of mapped reactions: all reactions' mapped_roles together, without and with maps. complete: there
    are reactions, each of them complete. roles: an expression of a reaction that gives its mapped_roles, if not
    mapped_roles itself."""

    def together(x: Column) -> Column:
        every = lambda role: F.flatten(F.transform(x, lambda y: y[role]))
        plain = lambda role: F.transform(every(role), remove_maps).alias(role)
        kinds = ("reactants", "reagents", "products")
        return F.struct(*[plain(k) for k in kinds], *[every(k).alias(f"mapped_{k}") for k in kinds], ((F.size(x) > 0) & F.forall(x, lambda y: y["complete"])).alias("complete"))

    return bound(F.transform(F.coalesce(mapped, _none()), roles or (lambda r: mapped_roles(r, valid))), together)


def roles_of_mapped(reaction: Column) -> Column:
    """Roles, with their maps, of one mapped reaction, as mapped_components gives them."""
    kinds = ("reactants", "reagents", "products")
    return bound(mapped_components(F.array(reaction)), lambda x: F.struct(*[x[f"mapped_{k}"].alias(k) for k in kinds], x["complete"].alias("complete")))


def unmapped_atoms(component: Column) -> Column:
    """Whether a component has an atom, other than hydrogen, without a map number."""
    rest = F.regexp_replace(component, r"\[[^\]]*:[1-9]\d*\]|\[\d*H\d*(?:[+-]\d*)?(?::\d+)?\]", "")
    return F.rlike(rest, F.lit("[A-Za-z*]"))


def step_roles(reaction: Column, valid=looks_valid) -> Column:
    """Roles of a mapped step: struct(ok, reactants, reagents, products, maps_missing, readable, n_left,
    known_products: the readable ones). Left
    components by shared maps, unreadable ones dropped; the middle section is reagents throughout;
    products stay as they are. ok: two or three sections. maps_missing: a product atom has no map, or
    products have none, or one that no readable left component has. readable: all left components and
    products are."""

    def parts(s: Column) -> Column:
        trimmed = lambda section: F.filter(F.transform(F.split(section, r"\."), lambda c: F.trim(c)), lambda c: c != "")
        ok, n = F.size(s).isin(2, 3), F.size(s)
        middle = F.when(n == 3, trimmed(F.get(s, F.lit(1)))).otherwise(_none())
        side = lambda i: F.when(ok, trimmed(F.get(s, i))).otherwise(_none())
        return F.struct(ok.alias("ok"), side(F.lit(0)).alias("left"), F.when(ok, middle).otherwise(_none()).alias("middle"), side(n - 1).alias("right"))

    def maps(x: Column) -> Column:
        left = F.transform(F.filter(x["left"], valid), lambda c: F.struct(c.alias("c"), atom_maps(c).alias("m")))
        return F.struct(x["ok"].alias("ok"), left.alias("left"), x["middle"].alias("middle"), x["right"].alias("right"), F.filter(x["right"], valid).alias("known"), F.size(x["left"]).alias("n_left"))

    def shared(x: Column) -> Column:
        lost = F.size(x["known"]) < F.size(x["right"])
        return F.struct(
            x["ok"].alias("ok"), x["left"].alias("left"), x["middle"].alias("middle"), x["right"].alias("right"), x["known"].alias("known"), x["n_left"].alias("n_left"), all_maps(x["known"]).alias("m"),
            F.flatten(F.transform(x["left"], lambda c: c["m"])).alias("lm"), (lost | F.exists(x["known"], unmapped_atoms)).alias("unmapped"), (~lost & (F.size(x["left"]) == x["n_left"])).alias("readable"))

    def roles(y: Column) -> Column:
        missing = (F.size(y["right"]) > 0) & (y["unmapped"] | (F.size(y["m"]) == 0) | (F.size(F.array_except(y["m"], y["lm"])) > 0))
        meets = lambda c: F.coalesce(F.arrays_overlap(c["m"], y["m"]), F.lit(False))
        texts = lambda cs: F.transform(cs, lambda c: c["c"])
        return F.struct(
            y["ok"].alias("ok"), texts(F.filter(y["left"], meets)).alias("reactants"), F.concat(y["middle"], texts(F.filter(y["left"], lambda c: ~meets(c)))).alias("reagents"),
            y["right"].alias("products"), missing.alias("maps_missing"), y["readable"].alias("readable"), y["n_left"].alias("n_left"), y["known"].alias("known_products"))

    return bound(bound(bound(bound(sections(reaction), parts), maps), shared), roles)


def roles_of_step(reaction: Column) -> Column:
    """Roles by shared maps on the left, the middle section being reagents throughout."""
    return bound(step_roles(reaction), lambda x: F.struct(*[x[k].alias(k) for k in ("reactants", "reagents", "products")]))


def maps_complete(reaction: Column) -> Column:
    """Whether a step has products and all their atoms' maps occur on the left."""
    return bound(step_roles(reaction), lambda x: x["ok"] & (F.size(x["products"]) > 0) & ~x["maps_missing"])


def first_by_key(values: Column, keys: Column) -> Column:
    """values without those whose key came before; order kept."""
    return F.filter(F.transform(values, lambda v, i: F.when(F.array_position(keys, F.get(keys, i)) == i + 1, v)), lambda v: v.isNotNull())


#: Words (small letters) that mark a reaction as unresolved.
UNRESOLVED_MARKS = ("nosmi", "not found", "not_found")


def valid_skeleton(text: Column) -> Column:
    """Two or more sections with a first and a last one that are not blank; codes are not looked at."""
    s = F.split(F.trim(text), ">", -1)
    return F.coalesce((F.size(s) >= 2) & (F.trim(F.get(s, F.lit(0))) != "") & (F.trim(F.element_at(s, -1)) != ""), F.lit(False))


def valid_reaction(text: Column, mapped: bool = False) -> Column:
    """Text on both sides of the last > and no mark of something unresolved. A mapped reaction is parted
    at the last >>, and has atom maps on both sides."""
    v, mark = F.trim(text), ">>" if mapped else ">"
    right = F.substring_index(v, mark, -1)
    left = F.substring(v, F.lit(1), F.length(v) - F.length(right) - len(mark))
    ok = F.contains(v, F.lit(mark)) & (F.trim(left) != "") & (F.trim(right) != "") & ~F.rlike(F.lower(v), F.lit("|".join(UNRESOLVED_MARKS)))
    if mapped:
        ok = ok & F.rlike(left, F.lit(r":\d+\]")) & F.rlike(right, F.lit(r":\d+\]"))
    return F.coalesce(ok, F.lit(False))


def remove_codes(skeleton: Column, codes: Column) -> Column:
    """A skeleton without the given codes; sections stay."""
    one = lambda s: F.array_join(F.filter(F.split(s, r"\."), lambda c: ~F.array_contains(codes, c)), ".")
    return F.array_join(F.transform(F.split(skeleton, ">", -1), one), ">")


def restore_codes(skeleton: Column, approved: Column) -> Column:
    """A skeleton with approved codes that it lacks added to its first section, in order."""
    s = F.split(skeleton, ">", -1)
    missing = F.array_sort(F.array_except(approved, F.flatten(F.transform(s, components))))
    first = F.array_join(F.concat(components(F.get(s, F.lit(0))), missing), ".")
    return F.array_join(F.concat(F.array(first), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))), ">")


def label_unresolved(skeleton: Column, smiles: Column, products: Column | None = None) -> Column:
    """A skeleton whose unresolved codes are shown as X(NoSmi). An empty last section shows the
    unresolved ones among the products' codes, in order."""
    unresolved = lambda c: F.coalesce(F.contains(F.lower(F.element_at(smiles, c)), F.lit("nosmi")), F.lit(False))
    mark = lambda c: F.concat(c, F.lit("(NoSmi)"))
    shown = lambda c: F.when(unresolved(c), mark(c)).otherwise(c)
    one = lambda s: F.array_join(F.transform(components(s), shown), ".")
    parts = F.split(skeleton, ">", -1)
    if products is None:
        return F.array_join(F.transform(parts, one), ">")
    lost = F.array_join(F.transform(F.array_sort(F.filter(F.coalesce(products, _none()), unresolved)), mark), ".")
    last = lambda s, i: F.when((s == "") & (i == F.size(parts) - 1), lost).otherwise(one(s))
    return F.array_join(F.transform(parts, last), ">")


def skeleton_codes(skeletons: Column) -> Column:
    """Distinct codes of an array of skeletons, as far as a bracket."""
    codes = F.flatten(F.transform(skeletons, lambda s: F.split(s, r"[>.]", -1)))
    return F.array_distinct(F.filter(F.transform(codes, lambda c: F.trim(F.substring_index(c, "(", 1))), lambda c: c != ""))


def reaction_signature(reactions: Column, key) -> Column:
    """Reactions of two or three sections with their components as sorted keys, in order, as one text; null if there
    are none, one lacks a side or has other sections, or a component has no key. key: an expression of a
    component, such as its structure's key, that leaves maps out."""

    def normal(r: Column) -> Column:
        parts = lambda s: F.transform(s, lambda x: F.array_sort(F.transform(components(x), lambda c: key(c))))
        fit = lambda p: F.when((F.size(p) > 1) & (F.size(F.get(p, F.lit(0))) > 0) & (F.size(F.element_at(p, -1)) > 0) & F.forall(p, lambda x: F.forall(x, lambda k: k.isNotNull())), F.transform(p, lambda x: F.array_join(x, ".")))
        three = lambda p: F.concat_ws(">", F.get(p, F.lit(0)), F.when(F.size(p) == 3, F.get(p, F.lit(1))).otherwise(""), F.element_at(p, -1))
        return bound(sections(r), lambda s: F.when(F.size(s).isin(2, 3), bound(bound(parts(s), fit), lambda p: F.when(p.isNotNull(), three(p)))))

    whole = lambda x: F.when((F.size(x) > 0) & F.forall(x, lambda r: r.isNotNull()), F.array_join(F.array_sort(x), " || "))
    return bound(F.transform(reactions, normal), whole)


def source_parts(reaction: Column, valid=looks_valid) -> Column:
    """struct(reactants, reagents, products) of the source's own mapped reaction without its maps: null unless there
    are three sections, all components can be read and products have maps."""

    def roles(s: Column) -> Column:
        parts = F.transform(s, components)

        def of(x: Column) -> Column:
            products = F.get(x, F.lit(2))
            left = F.concat(F.get(x, F.lit(0)), F.get(x, F.lit(1)))
            ok = lambda m: (F.size(products) > 0) & (F.size(m) > 0) & F.forall(F.flatten(x), valid)
            plain = lambda cs: F.transform(cs, remove_maps)
            return bound(all_maps(products), lambda m: F.when(ok(m), F.struct(
                plain(F.filter(left, lambda c: _shares(c, m))).alias("reactants"), plain(F.filter(left, lambda c: ~_shares(c, m))).alias("reagents"), plain(products).alias("products"))))

        return bound(parts, of)

    return bound(sections(strip_metadata(reaction)), lambda s: F.when(F.size(s) == 3, roles(s)))
