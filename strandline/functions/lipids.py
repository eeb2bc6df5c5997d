"""Lipid shorthand as columns: a name becomes a struct of class, chains and linkage.

A name is read in two steps: its head (a sub-class or a named compound), then its
chains, each a carbon and double-bond count with optional linkage (O-, P-) and
hydroxyls. Everything is built-in regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sub-class, category, LIPID MAPS prefix, lyso.
SUBCLASSES = [
    ("PC", "GP", "LMGP01010000", False), ("LPC", "GP", "LMGP01050000", True), ("PE", "GP", "LMGP02010000", False), ("LPE", "GP", "LMGP02050000", True),
    ("PS", "GP", "LMGP03010000", False), ("LPS", "GP", "LMGP03050000", True), ("PG", "GP", "LMGP04010000", False), ("LPG", "GP", "LMGP04050000", True),
    ("PI", "GP", "LMGP06010000", False), ("LPI", "GP", "LMGP06050000", True), ("PIP", "GP", "LMGP06020000", False), ("PIP2", "GP", "LMGP06030000", False),
    ("PIP3", "GP", "LMGP06040000", False), ("PA", "GP", "LMGP10010000", False), ("LPA", "GP", "LMGP10050000", True), ("CL", "GP", "LMGP12010000", False),
    ("MG", "GL", "LMGL01010000", False), ("DG", "GL", "LMGL02010000", False), ("TG", "GL", "LMGL03010000", False),
    ("SPB", "SP", "LMSP01010000", False), ("dhSPB", "SP", "LMSP01020000", False), ("SPBP", "SP", "LMSP01050000", False), ("dhSPBP", "SP", "LMSP01050000", False),
    ("Cer", "SP", "LMSP02010000", False), ("dhCer", "SP", "LMSP02020000", False), ("Cer1P", "SP", "LMSP02050000", False), ("CerP", "SP", "LMSP02050000", False),
    ("1-DeoxyCer", "SP", "LMSP02080000", False), ("SM", "SP", "LMSP03010000", False), ("dhSM", "SP", "LMSP03010000", False),
    ("HexCer", "SP", "LMSP05010000", False), ("Hex2Cer", "SP", "LMSP05020000", False), ("SHexCer", "SP", "LMSP0501AB00", False),
    ("GM3", "SP", "LMSP0601AA00", False), ("GD1", "SP", "LMSP0601AC00", False), ("GD2", "SP", "LMSP0601AC00", False), ("GD3", "SP", "LMSP0601AC00", False),
    ("GT1", "SP", "LMSP0601AD00", False), ("GQ1", "SP", "LMSP0601AE00", False),
    ("Cholesterol", "ST", "LMST01010001", False), ("CE", "ST", "LMST01020000", False),
    ("CAR", "FA", "LMFA0707", False), ("FFA", "FA", "LMFA01", False), ("Acyl-CoA", "FA", "LMFA0707", False),
    ("Coenzyme Q", "PR", "LMPR02010001", False), ("Dolichol", "PR", "LMPR03020001", False),
]

#: Named compounds and their sub-class.
NAMED = {
    "Cholesterol": "Cholesterol", "Cholesterol sulfate": "Cholesterol", "Sphingosine": "SPB", "Sphinganine": "dhSPB",
    "Sphingosine-1-phosphate": "SPBP", "Sphinganine-1-phosphate": "dhSPBP", "Sphingosine 1-phosphate": "SPBP", "Sphinganine 1-phosphate": "dhSPBP",
}

_HEAD = r"^([A-Za-z0-9][A-Za-z0-9-]*?)\s+"
_CHAIN = r"(\d+):(\d+)"


def parse(c: Column | str) -> Column:
    """A struct: sub_class, category, lmid, level, carbons, double_bonds, hydroxyls, linkage, ambiguous, lyso, named, resolved."""
    name = F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), r"[\s*]*\*\s*$", "")
    named = F.create_map(*(F.lit(x) for kv in NAMED.items() for x in kv))
    known = F.try_element_at(named, name)
    # "PC P-34:0 or PC O-34:1": of one mass; the O- form counts
    twin = F.regexp_extract(name, _HEAD + r"P-\d+:\d+\s+or\s+\1\s+(O-\d+:\d+)$", 2)
    head = F.regexp_extract(name, _HEAD + r"(?:[OP]-)?\d+:\d+", 1)
    chains = F.when(twin != "", twin).otherwise(F.regexp_extract(name, _HEAD + r"((?:[OP]-)?\d+:\d+(?:;O\d*)*(?:;OH)?(?:/\d+:\d+(?:;O\d*)?)?)$", 2))
    own = F.coalesce(
        known,
        F.when(name.rlike(r"^Coenzyme\s+Q\d+$"), "Coenzyme Q").when(name.rlike(r"^Dolichol-\d+$"), "Dolichol").when(name.rlike(r"^.+-CoA$"), "Acyl-CoA").when(name.rlike(r"(?i)^.+\s+acid$"), "FFA"),
    )
    shaped = chains != ""
    sub = F.coalesce(F.when(~shaped, own), F.when(shaped, head))
    table = lambda i: F.create_map(*(F.lit(x) for r in SUBCLASSES for x in (r[0], r[i])))
    entry = lambda i: F.try_element_at(table(i), sub)
    pairs = lambda g: F.aggregate(F.transform(F.regexp_extract_all(chains, F.lit(_CHAIN), F.lit(g)), lambda s: s.cast("int")), F.lit(0), lambda a, b: a + b)
    oxygens = F.regexp_extract_all(chains, F.lit(r";O(H|\d*)"), F.lit(1))
    hydroxyls = F.aggregate(F.transform(oxygens, lambda s: F.coalesce(F.when(s.rlike(r"^\d+$"), s.cast("int")), F.lit(1))), F.lit(0), lambda a, b: a + b)
    level = F.when(own.isNotNull() & ~shaped, "molecular_species").when(shaped & chains.contains("/"), "molecular_species").when(shaped, "sum_composition").otherwise("subclass")
    return F.struct(
        F.coalesce(sub, F.lit("UNKNOWN")).alias("sub_class"),
        F.coalesce(entry(1), F.lit("UNKNOWN")).alias("category"),
        entry(2).alias("lmid"),
        level.alias("level"),
        F.when(shaped, pairs(1)).alias("carbons"),
        F.when(shaped, pairs(2)).alias("double_bonds"),
        F.when(shaped, hydroxyls).alias("hydroxyls"),
        F.when(chains.startswith("O-"), "ether").when(chains.startswith("P-"), "plasmalogen").otherwise("acyl").alias("linkage"),
        (twin != "").alias("ambiguous"),
        F.coalesce(entry(3), F.lit(False)).alias("lyso"),
        (own.isNotNull() & ~shaped).alias("named"),
        sub.isNotNull().alias("resolved"),
    )


def saturation(double_bonds: Column) -> Column:
    return F.when(double_bonds == 0, "SFA").when(double_bonds == 1, "MUFA").when(double_bonds > 1, "PUFA")


def chain_bin(carbons: Column) -> Column:
    return F.when(carbons < 14, "short").when(carbons <= 18, "medium").when(carbons <= 22, "long").when(carbons > 22, "very_long")
