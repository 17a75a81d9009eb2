"""String expressions: ids, keys, sequence cleaning, complex strings, hash draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def sha_key(text: Column) -> Column:
    """Content address of a string: lower-case SHA-256 hex."""
    return F.sha2(text, 256)


def hash_hex(key: Column, seed: int | str) -> Column:
    """Seeded md5 of a key, the sort key of every reproducible draw."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_uniform(key: Column, seed: int | str) -> Column:
    """Uniform number in [0, 1) from the first 52 bits of the seeded md5, exact in a double."""
    return F.conv(F.substring(hash_hex(key, seed), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def is_safe_id(raw: Column) -> Column:
    """True where :func:`safe_id` is usable as a path component."""
    safe = _replace_reserved(raw)
    return ~safe.contains("..") & (F.regexp_replace(safe, r"\.", "") != "")


def _replace_reserved(raw: Column) -> Column:
    return F.regexp_replace(raw, r'[/\\:*?"<>|]', "_")


def safe_id(raw: Column, strict: bool = True) -> Column:
    """File-system safe id. Unusable ids raise, or become NULL when not strict."""
    bad = F.raise_error(F.concat(F.lit("unsafe id: "), raw)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(raw.isNull(), F.lit(None)).when(is_safe_id(raw), _replace_reserved(raw)).otherwise(bad)


def pair_key(protein_id: Column, ligand: Column, strict: bool = True) -> Column:
    """Folder name of one pair: safe protein id and the ligand's content address."""
    return F.concat(safe_id(protein_id, strict), F.lit("__"), sha_key(ligand))


def clean_sequence(seq: Column, mode: str = "strict") -> Column:
    """Map residue letters to the alphabet.

    ``strict`` turns every letter outside the 20 standard ones into ``X``; ``basic``
    only maps ``U`` and ``B`` and raises on any other unknown letter.
    """
    if mode == "strict":
        return F.regexp_replace(seq, f"[^{fv.STANDARD_RESIDUES}]", "X")
    if mode != "basic":
        raise ValueError(f"unknown mode: {mode}")
    mapped = F.translate(seq, "UB", "XX")
    message = F.concat(F.lit("letter outside the residue alphabet in: "), seq)
    return F.when(mapped.rlike(f"[^{fv.RESIDUES}]"), F.raise_error(message).cast("string")).otherwise(mapped)


def residue_code(name: Column) -> Column:
    """Three-letter residue name to one letter, unknown names to ``X``."""
    table = F.create_map(*[F.lit(v) for pair in fv.RESIDUE_NAMES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit("X"))


def length_bin(length: Column) -> Column:
    out = None
    for upper, name, _ in fv.LENGTH_BINS:
        out = F.when(length <= upper, name) if out is None else out.when(length <= upper, name)
    return out.otherwise(fv.LONG_BIN[0])


def batch_size_for_length(length: Column) -> Column:
    out = None
    for upper, _, size in fv.LENGTH_BINS:
        out = F.when(length <= upper, size) if out is None else out.when(length <= upper, size)
    return out.otherwise(fv.LONG_BIN[1])


def clean_complex(raw: Column) -> Column:
    """Normalise a multi-chain string: chains of capital letters joined by single colons."""
    upper = F.upper(F.replace(raw, F.lit("/"), F.lit(":")))
    kept = F.regexp_replace(upper, "[^A-Z:]", "")
    squeezed = F.regexp_replace(kept, ":+", ":")
    return F.regexp_replace(squeezed, "^:|:$", "")


def complex_mode(cleaned: Column) -> Column:
    """``mono`` for one chain, ``homo`` for equal chains, ``hetero`` otherwise."""
    chains = F.split(cleaned, ":")
    return (
        F.when(F.size(chains) == 1, "mono")
        .when(F.size(F.array_distinct(chains)) == 1, "homo")
        .otherwise("hetero")
    )


def complex_length(cleaned: Column) -> Column:
    return F.length(F.regexp_replace(cleaned, ":", ""))


def job_name(raw: Column) -> Column:
    """Word characters only, at most 50 of them."""
    return F.substring(F.regexp_replace(raw, "[^A-Za-z0-9_]", ""), 1, 50)


def job_id(cleaned: Column) -> Column:
    return F.concat(F.lit("job_"), F.substring(F.sha1(cleaned), 1, 5))
