"""Residue, atom and bond encoders as column expressions over lookup arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .vectors import one_hot


def normalized_property(name: str) -> list[float]:
    """Property table over the 21 letters: min-max scaled, ``X`` = raw mid-range (kept as published)."""
    raw = fv.RESIDUE_PROPERTIES[name]
    low, high = min(raw), max(raw)
    return [(v - low) / (float(high) - float(low)) for v in raw] + [(high + low) / 2.0]


def residue_index(aa: Column) -> Column:
    """Place 1..21 of a letter in the residue alphabet; an unknown letter raises."""
    place = F.instr(F.lit(fv.RESIDUES), aa)
    message = F.concat(F.lit("unknown residue: "), aa)
    return F.when(place > 0, place).otherwise(F.raise_error(message).cast("int"))


def residue_group_flags(aa: Column) -> list[Column]:
    return [F.instr(F.lit(members), aa).between(1, 21).cast("int").alias(name)
            for name, members in fv.RESIDUE_GROUPS.items()]


def residue_property(aa: Column, name: str) -> Column:
    table = F.array(*[F.lit(float(v)) for v in normalized_property(name)])
    return F.element_at(table, residue_index(aa)).alias(name)


def residue_features(aa: Column) -> Column:
    """33 numbers per residue: 21 letter indicators, 5 group flags, 7 scaled properties."""
    letters = [(aa == letter).cast("double") for letter in fv.RESIDUES]
    groups = [c.cast("double") for c in residue_group_flags(aa)]
    properties = [residue_property(aa, name) for name in fv.RESIDUE_PROPERTIES]
    return F.array(*letters, *groups, *properties)


def letter_counts(seq: Column) -> dict[str, Column]:
    """How often a cleaned sequence holds each of the 21 letters, without a row per letter."""
    return {letter: F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit(""))) for letter in fv.RESIDUES}


def residue_totals(counts: dict[str, Column]) -> dict[str, Column]:
    """Sums of a cleaned sequence's group flags and scaled properties, by name, from its letter counts.

    Every count is in most of the sums, so ``counts`` had better be columns: an expression would be
    taken anew in each of them.
    """

    def total(values: list) -> Column:
        terms = [counts[letter] * F.lit(v) for letter, v in zip(fv.RESIDUES, values) if v]
        out = terms[0]
        for term in terms[1:]:
            out = out + term
        return out

    groups = {name: total([int(letter in members) for letter in fv.RESIDUES]) for name, members in fv.RESIDUE_GROUPS.items()}
    return groups | {name: total([float(v) for v in normalized_property(name)]) for name in fv.RESIDUE_PROPERTIES}


def atom_class_table(separate_halogens: bool = False) -> list[int]:
    """Class code by atomic number 0..118; 0 = none of the classes."""
    classes = [numbers for _, numbers in fv.ATOM_CLASSES]
    if separate_halogens:
        classes += [numbers for _, numbers in fv.HALOGENS]
    else:
        classes.append([n for _, numbers in fv.HALOGENS for n in numbers])
    classes.append([n for low, high in fv.METAL_RANGES for n in range(low, high + 1)])
    codes = [0] * 119
    for code, numbers in enumerate(classes, start=1):
        for n in numbers:
            codes[n] = code
    return codes


def atom_class(atomic_number: Column, separate_halogens: bool = False) -> Column:
    table = F.array(*[F.lit(c) for c in atom_class_table(separate_halogens)])
    return F.coalesce(F.get(table, atomic_number), F.lit(0))


def symbol_class(symbol: Column) -> Column:
    """Vocabulary place of an element symbol, unknown symbols take the last place."""
    vocab = F.array(*[F.lit(s) for s in fv.ATOM_SYMBOLS])
    place = F.array_position(vocab, symbol).cast("int")
    return F.when(place > 0, place - 1).otherwise(F.lit(len(fv.ATOM_SYMBOLS) - 1))


def atom_features(degree: Column, total_h: Column, implicit_valence: Column, hybridization: Column,
                  aromatic: Column, cip: Column, chiral_possible: Column) -> Column:
    """43 flags of one atom. A degree outside 0..10 raises, the other counts fall into the last slot."""
    counts = list(range(11))
    chirality = F.when(cip.isNull(), F.array(F.lit(0), F.lit(0))).otherwise(one_hot(cip, ["R", "S"], "last"))
    return F.concat(
        one_hot(degree, counts, "error"),
        one_hot(total_h, counts, "last"),
        one_hot(implicit_valence, counts, "last"),
        one_hot(hybridization, fv.HYBRIDIZATIONS_FULL, "last"),
        F.array(aromatic.cast("int")),
        chirality,
        F.array(chiral_possible.cast("int")),
    )


def base_atom_features(degree: Column, valence: Column, hybridization: Column, radicals: Column,
                       charge: Column, aromatic: Column, in_ring: Column) -> Column:
    """12 numbers of one atom; an unknown hybridization leaves its six slots at zero."""
    return F.concat(
        F.array(degree.cast("int"), valence.cast("int")),
        one_hot(hybridization, fv.HYBRIDIZATIONS_BASE, "zero"),
        F.array(radicals.cast("int"), charge.cast("int"), aromatic.cast("int"), in_ring.cast("int")),
    )


def bond_code(bond_type: Column) -> Column:
    out = None
    for name, code in fv.BOND_CODES.items():
        out = F.when(bond_type == name, code) if out is None else out.when(bond_type == name, code)
    message = F.concat(F.lit("unknown bond type: "), F.coalesce(bond_type, F.lit("null")))
    return out.otherwise(F.raise_error(message).cast("int"))
