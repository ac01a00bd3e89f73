"""Projections, filters, casts and encodings (column expressions; no shuffles except P9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtwin.functions.binning import bin_midpoint, equal_width_bin
from tabtwin.operators.ordered import medians, modes
from tabtwin.spec import ColumnSpec

MISSING_CODE = "NA"


def apply_decisions(df: DataFrame, drop_columns: tuple[str, ...] = ("id",),
                    exclude: dict[str, list] | None = None) -> DataFrame:
    """Drop identifier columns and rows holding a listed rare level; missing values are kept."""
    out = df.drop(*[c for c in drop_columns if c in df.columns])
    for col, values in (exclude or {}).items():
        for v in values:
            out = out.filter(~F.col(col).eqNullSafe(F.lit(v)))
    return out


def apply_types(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    """Numeric -> double, discrete -> string label (the factor form generators work on)."""
    return df.select(*[
        (F.col(c).try_cast("double") if c in spec.numeric else
         F.col(c).cast("string") if c in spec.discrete else F.col(c)).alias(c) for c in df.columns])


def restore_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast columns back to the real table's types, by label (never by code); integers are
    rounded half-to-even first."""
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType)):
            # by way of double only where there is a fraction: doubles hold integers up to 2^53
            text = c.cast("string")
            c = F.coalesce(text.try_cast(f.dataType), F.bround(text.try_cast("double"), 0).try_cast(f.dataType))
        elif isinstance(f.dataType, T.BooleanType):
            c = F.lower(c.cast("string")).isin("true", "1")
            c = F.when(F.col(f.name).isNull(), F.lit(None)).otherwise(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c.cast("string").try_cast("double")
        else:
            c = c.cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def missing_indicator(col: str) -> F.Column:
    return F.col(col).isNull().cast("int").alias(f"{col}_missing")


def discretise(df: DataFrame, bounds: dict[str, tuple[float, float]], bins: int = 10,
               columns: list[str] | None = None) -> DataFrame:
    """Numeric -> 0-based equal-width bin code on public bounds; every column becomes a
    string with ``NA`` for missing or out of range."""
    cols = columns or df.columns
    out = []
    for c in cols:
        if c in bounds:
            lo, hi = bounds[c]
            v = equal_width_bin(F.col(c).cast("double"), lo, hi, bins).cast("string")
        else:
            v = F.col(c).cast("string")
        out.append(F.coalesce(v, F.lit(MISSING_CODE)).alias(c))
    return df.select(*out)


def undiscretise(df: DataFrame, bounds: dict[str, tuple[float, float]], bins: int = 10) -> DataFrame:
    """Bin code -> interval midpoint; ``NA`` / empty / non-numeric codes -> null."""
    out = []
    for c in df.columns:
        if c in bounds:
            lo, hi = bounds[c]
            out.append(bin_midpoint(F.col(c), lo, hi, bins).alias(c))
        else:
            out.append(F.when(F.col(c).isin(MISSING_CODE, ""), F.lit(None)).otherwise(F.col(c)).alias(c))
    return df.select(*out)


def reference_fills(real: DataFrame, spec: ColumnSpec) -> dict:
    """Median (numeric) or smallest most-frequent value (discrete) of each column of ``real``
    that has no missing values. One aggregation for null counts, one each for modes and medians."""
    cols = spec.all_columns
    aggs = [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in cols]
    stats = real.agg(*aggs).first()
    complete = [c for c in cols if stats[f"{c}__nulls"] == 0]
    disc = [c for c in complete if c in spec.discrete]
    fills = {r["column_name"]: r["mode"] for r in modes(real, disc).collect()} if disc else {}      # a row per column
    num = [c for c in complete if c in spec.numeric]
    if num:
        for r in medians(real, num).collect():  # one row per numeric column
            fills[r["column_name"]] = r["median"]
    return fills


def impute_from_reference(synth: DataFrame, real: DataFrame, spec: ColumnSpec) -> DataFrame:
    """Fill nulls of columns that are complete in ``real``; columns with missing values keep nulls."""
    fills = reference_fills(real, spec)
    return synth.select(*[
        (F.coalesce(F.col(c), F.lit(fills[c]).cast(synth.schema[c].dataType)) if c in fills else F.col(c)).alias(c)
        for c in synth.columns])


def restore_order(synth: DataFrame, real: DataFrame) -> DataFrame:
    """The columns of ``real`` in its order and types. A column that only ``synth`` has goes; one that it lacks raises."""
    missing = [c for c in real.columns if c not in synth.columns]
    if missing:
        raise ValueError(f"columns to put in order are missing: {missing}")
    return synth.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in real.schema.fields])


def upper_triangle(columns: list[str]) -> list[tuple[str, str]]:
    """Pairs (a, b) with a before b: the masked upper triangle of an association matrix."""
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
