"""SQL access: scalar functions as temporary SQL functions, tables as views.

The functions are SQL expressions, so the optimizer inlines them and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fixed_values as fv

_BINS = " ".join(f"WHEN n <= {upper} THEN '{name}'" for upper, name, _ in fv.LENGTH_BINS)

# An id that is no usable path component ends the query, as the column function does.
_RESERVED = r"""regexp_replace({raw}, '[/\\\\:*?"<>|]', '_')"""
_SAFE = (f"CASE WHEN {_RESERVED} LIKE '%..%' OR replace({_RESERVED}, '.', '') = '' "
         f"THEN CAST(raise_error(concat('unsafe id: ', {{raw}})) AS STRING) ELSE {_RESERVED} END")

FUNCTIONS = {
    "safe_id": ("raw STRING", "STRING", _SAFE.format(raw="raw")),
    "pair_key": ("protein STRING, ligand STRING", "STRING", f"concat({_SAFE.format(raw='protein')}, '__', sha2(ligand, 256))"),
    "clean_sequence": ("seq STRING", "STRING", f"regexp_replace(seq, '[^{fv.STANDARD_RESIDUES}]', 'X')"),
    "length_bin": ("n BIGINT", "STRING", f"CASE {_BINS} ELSE '{fv.LONG_BIN[0]}' END"),
    "sigmoid": ("x DOUBLE", "DOUBLE", "1 / (1 + exp(-x))"),
    "dot_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
                    "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "edge_angle": ("a DOUBLE, b DOUBLE, c DOUBLE", "DOUBLE",
                   "acos(greatest(-1D, least(1D, (a * a + b * b - c * c) / (2 * a * b))))"),
    "display_score": ("x DOUBLE", "DOUBLE", "greatest(0.01D, least(0.99D, round(x, 2)))"),
}


def register_functions(spark: SparkSession) -> list[str]:
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)


def register_tables(**tables: DataFrame) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
