"""Peptide chemistry as column expressions: digest, masses, fragment ladders, decoys, ProForma clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionweave.functions.binding import let

# Monoisotopic masses (Da).
RESIDUES = {"G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406, "N": 114.04293, "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931}
PROTON, WATER, CARBAMIDOMETHYL, NEUTRON = 1.00727646688, 18.01056, 57.02146, 1.00335
# Named modifications (Da).
NAMED_MODS = {"UNIMOD:4": 57.02146, "UNIMOD:35": 15.99491, "UNIMOD:1": 42.01057, "UNIMOD:21": 79.96633, "Carbamidomethyl": 57.02146, "Oxidation": 15.99491, "Acetyl": 42.01057, "Phospho": 79.96633}
AMINO_ACIDS = "".join(RESIDUES)
#: A residue with the modifications, and whatever else follows, up to the next residue.
RESIDUE_TOKEN = r"[A-Z](?:\[[^\]]*\])*[^A-Z\[]*"


def residue_masses(fixed_cys_mod: bool = True) -> dict[str, float]:
    return {r: m + CARBAMIDOMETHYL if r == "C" and fixed_cys_mod else m for r, m in RESIDUES.items()}


def _mapping(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def clean_protein(text: Column) -> Column:
    """ASCII letters in upper case, without those that name no amino acid."""
    letters = F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.regexp_replace(letters, f"[^{''.join(sorted(AMINO_ACIDS))}]", "")


def tokens(sequence: Column) -> Column:
    """Residues of a ProForma sequence, each with its modifications."""
    return F.regexp_extract_all(sequence, F.lit(RESIDUE_TOKEN), F.lit(0))


def token_mass(token: Column, fixed_cys_mod: bool = True) -> Column:
    """Mass of one residue token: residue, and every number or name in brackets."""
    mods = F.regexp_extract_all(token, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    delta = F.aggregate(mods, F.lit(0.0), lambda acc, m: acc + F.coalesce(F.try_element_at(_mapping(NAMED_MODS), m), m.try_cast("double"), F.lit(0.0)))
    bare = F.element_at(_mapping(residue_masses(False)), F.substring(token, 1, 1))
    fixed = F.when(token.startswith("C") & ~token.contains("["), F.lit(CARBAMIDOMETHYL if fixed_cys_mod else 0.0)).otherwise(0.0)
    return bare + fixed + delta


def token_masses(sequence: Column, fixed_cys_mod: bool = True, modified: bool = False) -> Column:
    """array<double> of residue masses. Plain sequences (no brackets) take the short way."""
    if modified:
        return F.transform(tokens(F.regexp_replace(sequence, r"^<.*>|/\d+$", "")), lambda t: token_mass(t, fixed_cys_mod))
    known = residue_masses(fixed_cys_mod)
    by_letter = F.array(*(F.lit(known.get(chr(65 + i))).cast("double") for i in range(26)))  # a map would be searched letter by letter
    return F.transform(F.split(sequence, ""), lambda c: F.get(by_letter, F.ascii(c) - 65))


def total(masses: Column) -> Column:
    return F.aggregate(masses, F.lit(0.0), lambda acc, m: acc + m)


def peptide_mz(masses: Column, charge: Column) -> Column:
    """(M + z p) / z of a peptide with these residue masses."""
    return (total(masses) + WATER + charge * F.lit(PROTON)) / charge


def digest(sequence: Column, enzyme: str, missed: int, lengths: tuple[int, int]) -> Column:
    """array<string> of peptides: pieces end after each match of the enzyme's site; up to `missed` sites stay uncut."""

    def joined(pieces, m):
        runs = F.transform(F.sequence(F.lit(1), F.size(pieces) - m), lambda i: F.array_join(F.slice(pieces, i, m + 1), ""))
        return F.when(F.size(pieces) > m, runs).otherwise(F.array().cast("array<string>"))

    cut = F.regexp_extract_all(sequence, F.lit(f"(?:(?!{enzyme}).)*{enzyme}|(?:(?!{enzyme}).)+$"), F.lit(0))
    made = let(cut, lambda pieces: F.concat(*(joined(pieces, m) for m in range(missed + 1))))
    return F.filter(made, lambda p: F.length(p).between(*lengths))


def _ion(series: str, charge: int):
    return lambda mass, at: F.struct(((mass + charge * PROTON) / charge).alias("mz"), F.lit(series).alias("ion_series"), (at + 1).cast("int").alias("ion_position"), F.lit(charge).alias("charge"))


def ladder(masses: Column, series: str, charges: tuple[int, ...]) -> Column:
    """array<struct<mz,ion_series,ion_position,charge>>: prefix (b) and suffix (y) ions 1..n-1 of each charge."""
    if odd := set(series) - set("by"):
        raise ValueError(f"ion series are b and y, not {', '.join(sorted(odd))}")

    def ions(held, ion):
        start = 0.0 if ion == "b" else WATER
        sums = F.aggregate(F.slice(held, 1, F.size(held) - 1), F.array(F.lit(start)), lambda acc, m: F.concat(acc, F.array(F.element_at(acc, -1) + m)))
        return let(sums, lambda s: F.concat(*(F.transform(F.slice(s, 2, F.size(s)), _ion(ion, z)) for z in charges)))

    return let(masses, lambda m: F.when(F.size(m) > 1, F.concat(*(ions(m if ion == "b" else F.reverse(m), ion) for ion in series))))


def reverse_interior(sequence: Column) -> Column:
    """First and last residue in place, those between reversed; modifications travel with their residue. Self-inverse."""

    def turned(t):
        n = F.size(t)
        return F.array_join(F.concat(F.slice(t, 1, 1), F.reverse(F.slice(t, 2, n - 2)), F.slice(t, n, 1)), "")

    return let(tokens(sequence), lambda t: F.when(F.size(t) < 3, sequence).otherwise(turned(t)))


def undo_permutation(sequence: Column, permutation: list[int]) -> Column:
    """The target of a decoy whose residue i came from the target's residue permutation[i]."""
    t = tokens(sequence)
    inverse = sorted(range(len(permutation)), key=permutation.__getitem__)
    return let(t, lambda held: F.array_join(F.transform(F.array(*(F.lit(i + 1) for i in inverse)), lambda i: F.element_at(held, i)), ""))


def strip_global_mods(sequence: Column) -> Column:
    return F.regexp_replace(sequence, "^<.*>", "")


def strip_mods(sequence: Column) -> Column:
    """Residues alone: no bracketed modification, no charge."""
    return F.regexp_replace(F.regexp_replace(sequence, r"\[.*?\]", ""), r"/\d+$", "")
