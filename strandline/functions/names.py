"""Identifiers and names as columns: canonical forms, variants, candidates. All built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of identifiers.
CHEBI = r"(?i)^chebi[:\s_]?(\d+)"
INCHIKEY = r"^[A-Z]{14}-[A-Z]{10}-[A-Z]$"
PUBCHEM = r"(?i)^(?:pubchem[:\s_]?|cid[:\s_]?)(\d+)"
NAME_SPLIT = r"\s*(?:/|;|\s+or\s+|\s*\|\s*)\s*"
STEREO = r"(?i)^(?:(?:\(?[RSDL]\)?-|\(?[+-]\)?-|alpha-|beta-|gamma-|delta-|cis-|trans-|α-|β-|γ-|δ-)\s*)+"

#: Salt and acid endings, in order of trial.
SALTS = (("ate", "ic acid"), ("ate", "oic acid"), ("ic acid", "ate"), ("oic acid", "oate"), ("ite", "ous acid"), ("ous acid", "ite"))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _found(c: Column, pattern: str) -> Column:
    """The first group, or null."""
    return F.nullif(F.regexp_extract(F.trim(c), pattern, 1), F.lit(""))


def chebi(c: Column | str) -> Column:
    return F.concat(F.lit("CHEBI:"), _found(_c(c), CHEBI))


def hmdb(c: Column | str) -> Column:
    """HMDB and seven digits at least; null for what doesn't begin so."""
    u = F.upper(F.trim(_c(c)))
    rest = F.substring(u, 5, 1_000_000)
    return F.when(u.startswith("HMDB"), F.concat(F.lit("HMDB"), F.when(F.length(rest) < 7, F.lpad(rest, 7, "0")).otherwise(rest)))


def inchikey(c: Column | str) -> Column:
    return F.when(F.trim(_c(c)).rlike(INCHIKEY), F.trim(_c(c)))


def connectivity(c: Column | str) -> Column:
    """The first 14 letters of an InChIKey."""
    return F.substring(inchikey(c), 1, 14)


def pubchem(c: Column | str) -> Column:
    t = F.trim(_c(c))
    return F.coalesce(_found(t, PUBCHEM), F.when(t.rlike(r"^\d+$"), t))


def without_stereo(c: Column | str) -> Column:
    """Less all leading stereo and configuration prefixes."""
    return F.trim(F.regexp_replace(F.trim(_c(c)), STEREO, ""))


def salt_variants(c: Column | str) -> Column:
    """Array of the lower-cased name's salt and acid rewrites, itself left out."""
    s = F.lower(F.trim(_c(c)))
    forms = [F.when(s.endswith(old), F.concat(F.substring(s, F.lit(1), F.length(s) - len(old)), F.lit(new))) for old, new in SALTS]
    return F.array_distinct(F.filter(F.array(*forms), lambda v: v.isNotNull() & (F.trim(v) != "") & (v != s)))


def split_variants(c: Column | str) -> Column:
    """The whole name, then its parts between / ; | and or."""
    s = F.trim(_c(c))
    parts = F.filter(F.transform(F.split(s, "(?i)" + NAME_SPLIT), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(s != "", F.array_distinct(F.concat(F.array(s), parts))).otherwise(F.array().cast("array<string>"))


def candidates(c: Column | str) -> Column:
    """Names to try for a feature, in order: itself, without a mark or tissue suffix, without an id prefix (and that id), without parentheses."""
    s = F.trim(F.regexp_replace(_c(c), r"\*+$", ""))
    no_tissue = F.trim(F.regexp_replace(s, r"(?i)[_\s](plasma|serum|urine|csf|blood|tissue)$", ""))
    prefix = r"^(?:C\d{5}|HMDB\d+)[_\s:]"
    bare = F.trim(F.regexp_replace(no_tissue, prefix, ""))
    its_id = F.nullif(F.regexp_extract(no_tissue, r"^(C\d{5}|HMDB\d+)[_\s:]", 1), F.lit(""))
    plain = F.trim(F.regexp_replace(bare, r"\s*\([^)]*\)\s*$", ""))
    return F.array_distinct(F.filter(F.array(F.trim(_c(c)), s, no_tissue, bare, its_id, plain), lambda v: v.isNotNull() & (v != "")))


def compartment(c: Column | str) -> Column:
    """What follows the first @ of an id, or null."""
    return F.nullif(F.regexp_extract(_c(c), r"^[^@]*@(.*)$", 1), F.lit(""))


def without_compartment(c: Column | str) -> Column:
    return F.substring_index(_c(c), "@", 1)


def clean(c: Column | str) -> Column:
    """Trimmed; blank, nan, na, none and null become null."""
    t = F.trim(_c(c).cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "na", "none", "null"), t)


def number(c: Column | str) -> Column:
    """A finite number, or null."""
    n = _c(c).try_cast("double")
    return F.when(~F.isnan(n), n)
