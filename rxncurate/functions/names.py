"""Compound names: cleaning, keys, qualifiers, ambiguity, unresolved marks."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rxncurate.functions.structure import looks_valid

#: Qualifiers that are cut out of a name, in this order of trial.
QUALIFIERS = [
    r"\d+\s+normal", r"\d+(\.\d+)?\s*N-", r"\d+(\.\d+)?\s*N", r"\d+(\.\d+)?\s*M", r"\d+%", r"\s*\(\s*\)", r"\([^()]*\)$", r"·", r"\([IVXLCDM]+\)",
    "anhydrous", "concentrated", "catalyst", "-catalyst", "saturated", "ice", "ice-", "dried", "aqueous", "solution", "normal", "solid", "complex", "resin", "adduct",
    "corresponding", "atmosphere", "gas", "solvent", "crystal", "crystals", "buffer", ".conc", "fuming", "glacial",
]
#: Names (lower case) that stand for no single structure.
AMBIGUOUS = [
    "4a molecular sieve", "4å molecular sieve", "ad-7 resin", "ad-mix-α", "activated charcoal", "ala-cholesterol", "alcohol", "alcoholic solution", "charcoal", "cell lysate",
    "celite", "diatomaceous earth", "filtering agent", "glucose dehydrogenase", "hexanes", "ketoreductase", "mineral oil", "organometallic catalyst", "oxone", "oxone®",
    "palladium hydroxide on carbon", "palladium on carbon", "palladium on charcoal", "paraformaldehyde", "petroleum ether", "petrolether", "polyphosphoric acid", "raney nickel",
    "saline", "sephadex lh-20", "sephadex lh20", "silica", "silica gel", "white solid", "xylenes", "z-ala-cholesterol", "zygosaccharomyces rouxii atcc 14462",
]
#: Patterns of such names.
AMBIGUOUS_PATTERNS = [
    r"(?i)^(?:compound|example|intermediate)(?:\s|$)", r"(?i)^(?:product|reagents?)\s+(?:from|for|of|analogous\s+to)(?:\s|$)",
    r"(?i)^(?:title compound|acid chloride|acetylating agent|alkylating agent)$", r"(?i)^(?:n-acetylating|n-methylating) agent$", r"(?i)^(?:ketone|silyl ether)\s+[A-Za-z0-9.-]+$",
    r"^[A-Za-z]?\d+(?:[-.]\d+)*$", r"(?i)\b(?:PAMAM|resin|copolymer|co-polymer|molecular sieve)\b", r"(?i)^benzhydrol\s+.*benzoate$", r"(?i)^sephadex\b",
    r"(?i)^(?:crude product|activated ester|mixed anhydride)\b", r"(?i)\b(?:filter aid|mixture|solution in|aqueous solution|on charcoal|on carbon)\b",
]
#: Names and the structures they are known by.
KNOWN_SMILES = {
    "ice": "O", "DCM": "C(Cl)Cl", "DMA": "CC(=O)N", "DMF": "CN(C)C=O", "THF": "C1CCOC1", "ether": "CCOCC", "absolute ethanol": "CCO", "dry acetone": "CC(=O)C", "dry ether": "CCOCC",
    "dry tetrahydrofuran": "C1CCOC1", "dry toluene": "Cc1ccccc1", "ultrapure water": "O", "sodium methylate": "C[O-].[Na+]", "lithiumaluminium hydride": "[Li+].[AlH4-]",
    "racemic phenylalanine": "NC(Cc1ccccc1)C(=O)O", "brine": "O.[Na+].[Cl-]", "DMSO": "CS(=O)C", "LiAlH4": "[Li+].[AlH4-]",
}
#: Other names (lower case) of one chemical identity.
ALIASES = {
    "1,1'-carbonylbis(imidazole)": "1,1'-carbonyldiimidazole", "n,n'-carbonyldiimidazole": "1,1'-carbonyldiimidazole",
    "bis-(triphenylphosphine)palladium(ii) dichloride": "bis(triphenylphosphine)palladium(II) dichloride", "bis(triphenylphosphine)palladium(ii) chloride": "bis(triphenylphosphine)palladium(II) dichloride",
    "diea": "DIPEA", "mo(co)6": "molybdenum hexacarbonyl", "palladium tetrakis(triphenylphosphine)": "tetrakis(triphenylphosphine)palladium(0)", "phosphorous pentachloride": "phosphorus pentachloride",
    "ruphos": "2-dicyclohexylphosphino-2',6'-diisopropoxybiphenyl", "tetrakis(triphenylphosphine)palladium": "tetrakis(triphenylphosphine)palladium(0)",
    "tri(dibenzylidenacetone)dipalladium(0)": "tris(dibenzylideneacetone)dipalladium(0)", "tri(dibenzylideneacetone)dipalladium(0)": "tris(dibenzylideneacetone)dipalladium(0)",
    "tris(dibenzylideneacetone)dipalladium": "tris(dibenzylideneacetone)dipalladium(0)",
}


def clean_name(name: Column) -> Column:
    """A name with plain primes and single spaces."""
    return F.trim(F.regexp_replace(F.replace(name, F.lit("′"), F.lit("'")), r"\s+", " "))


def fix_name(name: Column, qualifiers: Sequence[str] = QUALIFIERS) -> Column:
    """A name without qualifiers, wherever they stand."""
    return F.trim(F.regexp_replace(name, f"(?i)({'|'.join(qualifiers)})", ""))


def is_ambiguous(name: Column) -> Column:
    """Whether a name stands for no single structure."""
    v = clean_name(name)
    found = F.lower(v).isin(*AMBIGUOUS)
    for p in AMBIGUOUS_PATTERNS:
        found = found | F.rlike(v, F.lit(p))
    return found


def resolve_alias(name: Column) -> Column:
    """The name that a known other name stands for, or the cleaned name."""
    v = clean_name(name)
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(v)), v)


#: Greek letters of names, spelt.
GREEK = str.maketrans({"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta"})
_TAG, _ODD = re.compile(r"<[^>]*>"), re.compile(r"[^a-z0-9]+")


def name_key_of(name: str) -> str:
    """Key of a name: small letters and digits alone, once tags and entities are gone, Greek letters
    spelt and accents taken off."""
    plain = html.unescape(_TAG.sub("", name)).translate(GREEK)
    letters = unicodedata.normalize("NFKD", plain).encode("ascii", "ignore")
    return _ODD.sub("", letters.decode().casefold())


@F.pandas_udf(StringType())
def _name_keys(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else name_key_of(n))


def with_name_key(df: DataFrame, name: str, key: str = "name_key") -> DataFrame:
    """df with the key of a name column, computed once for each distinct name and joined back."""
    keys = df.select(name).distinct().withColumn(key, _name_keys(F.col(name))).withColumnRenamed(name, "_name")
    return df.join(keys, df[name].eqNullSafe(keys["_name"]), "left").drop("_name")


def unresolved_name(value: Column) -> Column:
    """The name inside [name (NoSmi)], spaces collapsed; null for other values."""
    inner = F.regexp_extract(F.trim(value), r"^\[(.*) \(NoSmi\)\]$", 1)
    return F.nullif(F.trim(F.regexp_replace(inner, r"\s+", " ")), F.lit(""))


def unresolved_codes(smiles: Column, skeleton_codes: Column) -> Column:
    """Codes of a skeleton whose entry is unresolved."""
    return F.array_intersect(F.map_keys(F.map_filter(smiles, lambda k, v: F.contains(F.lower(v), F.lit("nosmi")))), skeleton_codes)


def first_property(record: Column, names: Sequence[str], valid=looks_valid) -> Column:
    """The first property of a JSON record that is present and a valid structure."""
    values = [F.trim(F.get_json_object(record, f"$.{n}")) for n in names]
    return F.coalesce(*[F.when(valid(v), v) for v in values])
