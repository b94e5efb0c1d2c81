"""Structures of components, read and keyed by column expressions.

A component's text is cut into tokens; a fold over them (open branches, open rings, the atom before)
tells whether it is a structure and what its bonds are. The key of a structure comes from refining its
atoms' labels by their neighbours', so the order of writing does not matter: maps, stereo marks, charges and
hydrogens do not count. A molecule's atoms and bonds fit one row, so all of it is work on that row without
a shuffle; over many rows it is done once for each distinct text (operators/structures.py).

Not done: aromaticity of alternating bonds, valences, and stereo in the strict key. A caller who has a
chemistry library gives its own function.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxncurate.functions.jsonfix import bound

#: The symbols of the elements.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr"
).split()
#: Atoms that may be aromatic, as they are written in small letters.
AROMATIC = ("b", "c", "n", "o", "p", "s", "se", "as", "te")
#: Orders of the bonds as they are written.
ORDERS = {"-": 1.0, "/": 1.0, "\\": 1.0, "=": 2.0, "#": 3.0, "$": 4.0, ":": 1.5, "~": 1.0}
_BRACKET = (
    rf"\[\d*(?:{'|'.join(ELEMENTS)}|{'|'.join(AROMATIC)}|\*)(?:@{{1,2}}(?:(?:TH|AL|SP|TB|OH)\d+)?)?"
    r"(?:H\d*)?(?:[+-]\d+|\++|-+)?(?::\d+)?\]")
_ATOM = rf"(?:{_BRACKET}|Br|Cl|[BCNOPSFIbcnops*])"
_BOND = r"[-=#$:/\\~]"
#: The symbol of an atom's token.
_SYMBOL = r"^\[?\d*([A-Z][a-z]?|[a-z]{1,2}|\*)"
TOKEN = rf"{_ATOM}|[().]|{_BOND}|%\d\d|\d"
#: A text without branches and rings, short enough for one pattern.
_CHAIN, _SHORT = rf"^{_ATOM}(?:{_BOND}?{_ATOM})*$", 200

_ATOM_KIND, _OPEN, _CLOSE, _DOT, _RING, _BOND_KIND = range(6)


def _tokens(text: Column) -> Column:
    """array of struct(kind, text, name: a ring's number, ord: a bond's order); null if text holds more
    than tokens."""

    def token(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        kind = (
            F.when(first == "(", _OPEN).when(first == ")", _CLOSE).when(first == ".", _DOT).when(F.rlike(first, F.lit(r"[%\d]")), _RING)
            .when(first.isin(*ORDERS), _BOND_KIND).otherwise(_ATOM_KIND))
        order = F
        for sign, value in ORDERS.items():
            order = order.when(t == sign, F.lit(value))
        # Casts see digits only, as those that fail are slow.
        name = F.when(F.rlike(first, F.lit(r"[%\d]")), F.replace(t, F.lit("%"), F.lit("")).cast("int"))
        return F.struct(kind.alias("kind"), t.alias("text"), name.alias("name"), order.otherwise(F.lit(None).cast("double")).alias("ord"))

    whole = lambda tokens: F.when(F.array_join(tokens, "") == text, F.transform(tokens, token))
    return bound(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), whole)


def _push(stack: Column, x: Column) -> Column:
    return F.concat(stack, F.array(x))


def _read_token(s: Column, t: Column) -> Column:
    """The state after a token: ok, n (atoms), last (the atom that the next one is bound to, or -1), ord
    (a bond that waits for its end), stack (atoms of open branches), rings (open ones), bonds, kind."""
    atom, opens, closes, dot, ring, bond = (t["kind"] == k for k in (_ATOM_KIND, _OPEN, _CLOSE, _DOT, _RING, _BOND_KIND))
    none = F.lit(None).cast("double")

    def after(x: Column) -> Column:
        begun = x["open"]
        free = s["ord"].isNull()
        twice = F.exists(s["bonds"], lambda b: (F.least(b["a"], b["b"]) == F.least(begun["at"], s["last"])) & (F.greatest(b["a"], b["b"]) == F.greatest(begun["at"], s["last"])))
        ok = (
            F.when(opens, (s["last"] >= 0) & free).when(closes, (F.size(s["stack"]) > 0) & free & (s["kind"] != _OPEN)).when(dot, free & (s["last"] >= 0))
            .when(ring, (s["last"] >= 0) & (begun.isNull() | ((begun["at"] != s["last"]) & ~twice))).when(bond, (s["last"] >= 0) & free).otherwise(True))
        made = (
            F.when(atom & (s["last"] >= 0), F.struct(s["last"].alias("a"), s["n"].alias("b"), s["ord"].alias("ord")))
            .when(ring & begun.isNotNull(), F.struct(begun["at"].alias("a"), s["last"].alias("b"), F.coalesce(s["ord"], begun["ord"]).alias("ord"))))
        rings = F.when(~ring, s["rings"]).when(begun.isNull(), _push(s["rings"], F.struct(t["name"].alias("name"), s["last"].alias("at"), s["ord"].alias("ord")))).otherwise(
            F.filter(s["rings"], lambda r: r["name"] != t["name"]))
        return F.struct(
            (s["ok"] & F.coalesce(ok, F.lit(False))).alias("ok"), F.when(atom, s["n"] + 1).otherwise(s["n"]).alias("n"),
            F.when(atom, s["n"]).when(closes, F.coalesce(F.try_element_at(s["stack"], F.lit(-1)), F.lit(-1))).when(dot, F.lit(-1)).otherwise(s["last"]).alias("last"),
            F.when(bond, t["ord"]).when(atom | ring, none).otherwise(s["ord"]).alias("ord"),
            F.when(opens, _push(s["stack"], s["last"])).when(closes, F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"]).alias("stack"),
            rings.alias("rings"), F.when(made.isNotNull(), _push(s["bonds"], made)).otherwise(s["bonds"]).alias("bonds"), t["kind"].alias("kind"))

    return bound(F.struct(F.get(F.filter(s["rings"], lambda r: ring & (r["name"] == t["name"])), F.lit(0)).alias("open")), after)


def _start() -> Column:
    return F.struct(
        F.lit(True).alias("ok"), F.lit(0).alias("n"), F.lit(-1).alias("last"), F.lit(None).cast("double").alias("ord"), F.array().cast("array<int>").alias("stack"),
        F.array().cast("array<struct<name:int,at:int,ord:double>>").alias("rings"), F.array().cast("array<struct<a:int,b:int,ord:double>>").alias("bonds"), F.lit(-1).alias("kind"))


def _whole(end: Column) -> Column:
    """Whether a text may end in this state."""
    return end["ok"] & (end["n"] > 0) & (end["last"] >= 0) & end["ord"].isNull() & (F.size(end["stack"]) == 0) & (F.size(end["rings"]) == 0)


def looks_valid(component: Column) -> Column:
    """Whether a text is a structure: known atoms, brackets and branches that close, rings of two ends, bonds
    between atoms. Null is none. Texts without branches and rings are read by one pattern."""
    folded = bound(_tokens(component), lambda tokens: F.when(tokens.isNull(), False).otherwise(bound(F.aggregate(tokens, _start(), _read_token), _whole)))
    return F.when(component.isNull() | (component == ""), False).when((F.length(component) <= _SHORT) & F.rlike(component, F.lit(_CHAIN)), True).otherwise(folded)


def _atoms(tokens: Column) -> Column:
    def atom(t: Column, i: Column) -> Column:
        text = t["text"]
        sign = F.regexp_extract(text, r"([+-]+)(\d*)(?::\d+)?\]$", 1)
        digits = F.regexp_extract(text, r"([+-]+)(\d*)(?::\d+)?\]$", 2)
        size = F.coalesce(F.when(digits != "", digits.try_cast("int")), F.length(sign))
        # The zero in front is for atoms without a map.
        number = F.coalesce(F.concat(F.lit("0"), F.regexp_extract(text, r":(\d+)\]$", 1)).try_cast("int"), F.lit(0))
        bracket = F.startswith(text, F.lit("["))
        return F.struct(
            i.alias("place"), F.initcap(F.regexp_extract(text, _SYMBOL, 1)).alias("element"), F.when(bracket, number).otherwise(0).alias("map"),
            F.when(~bracket, 0).when(F.startswith(sign, F.lit("-")), -size).otherwise(size).alias("charge"), F.rlike(text, F.lit(r"^\[?\d*[a-z]")).alias("aromatic"))

    return F.transform(F.filter(tokens, lambda t: t["kind"] == _ATOM_KIND), atom)


def _bonds(atoms: Column, bonds: Column) -> Column:
    at = lambda i: F.get(atoms, i)
    plain = lambda b: F.when(at(b["a"])["aromatic"] & at(b["b"])["aromatic"], 1.5).otherwise(1.0)
    return F.transform(bonds, lambda b: F.struct(
        b["a"].alias("a"), b["b"].alias("b"), at(b["a"])["map"].alias("map_a"), at(b["b"])["map"].alias("map_b"), F.coalesce(b["ord"], plain(b)).alias("bond_order")))


ATOMS = "array<struct<place:int,element:string,map:int,charge:int,aromatic:boolean>>"
BONDS = "array<struct<a:int,b:int,map_a:int,map_b:int,bond_order:double>>"


def read(component: Column) -> Column:
    """struct(valid, atoms, bonds) of a component: place, element, map (0: none), charge and aromaticity of each
    atom, ends (places and maps) and order of each bond. What is not a structure has neither."""
    none = F.struct(F.lit(False).alias("valid"), F.array().cast(ATOMS).alias("atoms"), F.array().cast(BONDS).alias("bonds"))

    def parts(x: Column) -> Column:
        found = bound(_atoms(x["tokens"]), lambda atoms: F.struct(F.lit(True).alias("valid"), atoms.cast(ATOMS).alias("atoms"), _bonds(atoms, x["end"]["bonds"]).cast(BONDS).alias("bonds")))
        return F.when(_whole(x["end"]), found).otherwise(none)

    folded = lambda tokens: F.when(tokens.isNull() | (F.size(tokens) == 0), none).otherwise(
        bound(F.struct(tokens.alias("tokens"), F.aggregate(tokens, _start(), _read_token).alias("end")), parts))
    return bound(_tokens(F.coalesce(component, F.lit(""))), folded)


def _refined(labels: Column, near: Column, rounds: Column) -> Column:
    """labels of atoms when their number of kinds grows no more, after so many rounds at most; in each a label takes
    in those of its neighbours (near: for each atom an array of struct(i, ord))."""
    once = lambda now: F.transform(near, lambda own, k: F.xxhash64(F.get(now, k), F.array_sort(F.transform(own, lambda x: F.xxhash64(x["ord"], F.get(now, x["i"]))))))
    state = lambda now, before: F.struct(now.alias("now"), before.alias("before"))

    def moved(s: Column, _: Column) -> Column:
        kinds = F.size(F.array_distinct(s["now"]))
        return F.when(kinds <= s["before"], s).otherwise(state(once(s["now"]), kinds))

    return F.aggregate(F.sequence(F.lit(1), rounds), state(labels, F.lit(0)), moved, lambda s: s["now"])


def _certificate(labels: Column, near: Column, n: Column) -> Column:
    """Text that equal connected graphs share. Where refinement leaves atoms with equal labels in a graph with
    rings, one atom after the other of a smallest such group is marked and refined again."""
    text = lambda x: F.concat(F.hex(F.xxhash64(F.array_sort(x))), F.hex(F.xxhash64(F.lit(1), F.array_sort(x))))
    alike = lambda x, v: F.size(F.filter(x, lambda w: w == v))

    def marked(first: Column) -> Column:
        groups = F.filter(F.transform(F.array_distinct(first), lambda v: F.struct(alike(first, v).alias("n"), v.alias("v"))), lambda g: g["n"] > 1)
        which = F.filter(F.transform(first, lambda v, k: F.when(v == F.array_min(groups)["v"], k)), lambda k: k.isNotNull())
        again = lambda root: text(_refined(F.transform(first, lambda v, k: F.when(k == root, F.xxhash64(v)).otherwise(v)), near, n))
        return F.when(F.size(groups) == 0, text(first)).otherwise(F.concat(text(first), F.array_join(F.array_sort(F.transform(which, again)), "")))

    rings = F.aggregate(near, F.lit(0), lambda a, own: a + F.size(own)) >= 2 * n
    return bound(_refined(labels, near, n), lambda first: F.when(rings, marked(first)).otherwise(text(first)))


def key_of(structure: Column, strict: bool = False) -> Column:
    """Key of what read gives, null if it is not valid: equal for the same atoms and bonds, however they are
    written. Connected parts are keyed one by one. Hydrogens that are written out, maps and stereo do
    not count, nor do charges unless strict."""
    heavy_of = lambda atoms: bound(F.filter(atoms, lambda a: a["element"] != "H"), lambda h: F.when(F.size(h) > 0, h).otherwise(atoms))

    def graph(x: Column) -> Column:
        place = lambda i: F.array_position(x["places"], i).cast("int") - 1
        inside = F.filter(F.transform(x["bonds"], lambda b: F.struct(place(b["a"]).alias("a"), place(b["b"]).alias("b"), b["bond_order"].alias("ord"))), lambda b: (b["a"] >= 0) & (b["b"] >= 0))
        return bound(inside, lambda bonds: F.transform(x["atoms"], lambda a, k: F.concat(
            F.transform(F.filter(bonds, lambda b: b["a"] == k), lambda b: F.struct(b["b"].alias("i"), b["ord"].alias("ord"))),
            F.transform(F.filter(bonds, lambda b: b["b"] == k), lambda b: F.struct(b["a"].alias("i"), b["ord"].alias("ord"))))))

    label = lambda a, own: F.xxhash64(a["element"], a["aromatic"], F.size(own), *([a["charge"]] if strict else []))

    def keyed(y: Column) -> Column:
        n = F.size(y["labels"])
        spread = lambda now: F.transform(y["near"], lambda own, k: F.least(F.get(now, k), F.coalesce(F.array_min(F.transform(own, lambda e: F.get(now, e["i"]))), F.get(now, k))))
        part = F.aggregate(F.sequence(F.lit(1), n), F.transform(y["near"], lambda _, k: k), lambda now, _: spread(now))

        def by_part(p: Column) -> Column:
            members = lambda r: F.filter(F.transform(p, lambda v, k: F.when(v == r, k)), lambda k: k.isNotNull())
            inner = lambda m: F.transform(m, lambda k: F.transform(F.get(y["near"], k), lambda e: F.struct((F.array_position(m, e["i"]).cast("int") - 1).alias("i"), e["ord"].alias("ord"))))
            one = lambda m: _certificate(F.transform(m, lambda k: F.get(y["labels"], k)), inner(m), F.size(m))
            return F.array_join(F.array_sort(F.transform(F.array_distinct(p), lambda r: bound(members(r), one))), ".")

        return bound(part, by_part)

    def labelled(x: Column) -> Column:
        return bound(graph(x), lambda near: bound(F.struct(near.alias("near"), F.transform(x["atoms"], lambda a, k: label(a, F.get(near, k))).alias("labels")), keyed))

    chosen = lambda s: bound(heavy_of(s["atoms"]), lambda atoms: bound(F.struct(
        atoms.alias("atoms"), F.transform(atoms, lambda a: a["place"]).alias("places"), s["bonds"].alias("bonds")), labelled))
    return F.when(structure["valid"], chosen(structure))


def structure_key(component: Column, strict: bool = False) -> Column:
    """Key of a component; null if it is not a structure."""
    return bound(read(component), lambda s: key_of(s, strict))


def atom_symbols(parts: Column) -> Column:
    """Elements of the heavy atoms of an array of readable components, an aromatic one's capitalised."""
    symbols = lambda c: F.transform(F.regexp_extract_all(c, F.lit(f"({_ATOM})"), F.lit(1)), lambda t: F.initcap(F.regexp_extract(t, _SYMBOL, 1)))
    return F.filter(F.flatten(F.transform(parts, symbols)), lambda x: ~x.isin("H", "*"))


def same_structures(a: Column, b: Column, key=structure_key) -> Column:
    """Whether two arrays of readable components are equal as multisets of their keys. Keys are made only where
    both have as many components and the same atoms, which few unlike ones have."""
    heavy = lambda parts: F.array_sort(atom_symbols(parts))
    # Both sides go through one expression: a key's is long, and planning takes as long as it has copies.
    keys = F.transform(F.array(a, b), lambda parts: F.array_sort(F.transform(parts, lambda c: key(c))))
    return F.when(F.size(a) != F.size(b), False).when(heavy(a) != heavy(b), False).otherwise(F.size(F.array_distinct(keys)) == 1)


def read_structures(df: DataFrame, component: str) -> DataFrame:
    """(component, valid, key, heavy_atoms, atoms, bonds) for each distinct component of df, null and
    unreadable ones invalid: read once, however often it occurs. Join back by the component."""
    out = df.select(component).distinct().withColumn("_s", read(F.col(component))).withColumn("_k", key_of(F.col("_s")))
    return out.select(component, "_s.valid", F.col("_k").alias("key"), F.size(F.filter("_s.atoms", lambda a: a["element"] != "H")).alias("heavy_atoms"), "_s.atoms", "_s.bonds")


def plain_text(component: Column) -> Column:
    """The text that stands for a structure in text_key, of a component known to be valid."""
    v = F.translate(component, "@/\\", "")
    v = F.regexp_replace(v, r"\[\d*([A-Za-z][a-z]?)(?:H\d*)?(?:[+-]+\d*)?(?::\d+)?\]", "[$1]")
    return F.regexp_replace(v, r"\[(Cl|Br|[BCNOPSFIbcnops])\]", "$1")


def text_key(component: Column) -> Column:
    """Textual key; null for texts that cannot be a structure."""
    return F.when(looks_valid(component), plain_text(component))


def with_structure_key(df: DataFrame, component: str, key: str = "structure_key", keyer: Callable[[str], str | None] | None = None) -> DataFrame:
    """df with a structure key, computed once for each distinct component and joined back. keyer, if
    given, maps a component to its key or None."""
    distinct = df.select(F.col(component).alias("_component")).distinct()
    if keyer is None:
        keys = distinct.withColumn(key, text_key(F.col("_component")))
    else:
        def run(parts: pd.Series) -> pd.Series:
            return parts.map(lambda c: None if c is None else keyer(c))

        keys = distinct.withColumn(key, F.pandas_udf(run, "string")(F.col("_component")))
    return df.join(keys, df[component].eqNullSafe(keys["_component"]), "left").drop("_component")


def map_reactions(df: DataFrame, mapper: Callable[[list[str]], list[str]], column: str = "mapper_rxn", batch_size: int = 32) -> DataFrame:
    """df with mapped_rxn and mapping_error from a user's mapper of batches; a batch that fails is tried
    again one reaction at a time, so that one bad reaction spoils no other."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*[f for f in df.schema if f.name not in ("mapped_rxn", "mapping_error")], StructField("mapped_rxn", StringType()), StructField("mapping_error", StringType())])

    def one(r: str) -> tuple[str | None, str | None]:
        try:
            return mapper([r])[0], None
        except Exception as e:  # noqa: BLE001
            return None, str(e)

    def run(batches):
        for b in batches:
            out: list[tuple[str | None, str | None]] = []
            values = [None if pd.isna(v) else v for v in b[column]]
            for k in range(0, len(values), batch_size):
                part = values[k:k + batch_size]
                real = [v for v in part if v is not None]
                try:
                    got = iter([(m, None) for m in mapper(real)] if real else [])
                except Exception:  # noqa: BLE001
                    got = iter([one(v) for v in real])
                out += [(None, None) if v is None else next(got) for v in part]
            yield b.assign(mapped_rxn=[m for m, _ in out], mapping_error=[e for _, e in out])

    return df.drop("mapped_rxn", "mapping_error").mapInPandas(run, schema)
