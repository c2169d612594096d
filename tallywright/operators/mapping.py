"""Column maps: which raw columns and constants make up the standard columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.codes import account_key

#: Rule kinds as they stand in the map files (fixed values).
MAP = "MAP"
KEYIN = "KEYIN"


@dataclass(frozen=True)
class MapRule:
    """``MAP``: column ``asis`` becomes ``tobe``. ``KEYIN``: ``asis`` is the constant."""

    method: str
    asis: str
    tobe: str


def column(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def rules_from(
    df: DataFrame, method: str = "method", asis: str = "asis", tobe: str = "tobe"
) -> list[MapRule]:
    """Rules from a map table; rows of any other kind than MAP and KEYIN are ignored.

    Repeated rules count once. Two rules of one kind that give a standard column different
    sources are refused. What reaches the driver is one row per kind and standard column,
    however many rows the table has.
    """
    picked = df.select(
        *(column(c).cast("string").alias(n) for c, n in ((method, "m"), (asis, "a"), (tobe, "t"))),
        F.monotonically_increasing_id().alias("place"),
    )
    source = F.struct("a")
    rules = (
        picked.filter(F.col("m").isin(MAP, KEYIN))
        .groupBy("m", "t")
        .agg(F.min(source).alias("low"), F.max(source).alias("high"), F.min("place").alias("place"))
        .orderBy("place")
        .collect()
    )
    conflicts = sorted(str(r.t) for r in rules if r.low.a != r.high.a)
    if conflicts:
        raise ValueError(f"the map gives these columns more than one source: {conflicts}")
    return [MapRule(r.m, r.low.a, r.t) for r in rules]


def flags_from(df: DataFrame, on: str = "O") -> set[str]:
    """Names of the flags that are switched on; the table has name and check columns."""
    name, check = (column(c).cast("string") for c in df.columns[:2])
    return {r[0] for r in df.filter(check == on).select(name).distinct().collect()}


def apply_map(df: DataFrame, rules: Iterable[MapRule]) -> DataFrame:
    """Only the mapped and keyed-in columns, in one projection.

    A rule for a name that is already set replaces it; constants come after columns.
    """
    rules = list(rules)
    mapped = [r for r in rules if r.method == MAP]
    present = set(df.columns)
    missing = sorted({str(r.asis) for r in mapped} - present)
    if missing:
        raise ValueError(f"columns named in the map are not in the data: {missing}")
    target: dict[str, Column] = {r.tobe: column(str(r.asis)) for r in mapped}
    target.update({r.tobe: F.lit(r.asis) for r in rules if r.method == KEYIN})
    return df.select(*(expr.alias(name) for name, expr in target.items()))


def with_constants(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    """Add constant columns."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by exact name; a name that is not there is an error."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"columns to rename are not in the data: {missing}")
    return df.withColumnsRenamed(dict(names))


def trim_headers(df: DataFrame) -> DataFrame:
    """Strip blanks around every column name."""
    return df.toDF(*(name.strip() for name in df.columns))


def keep_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the listed columns; the selection reaches the scan."""
    return df.select(*(column(name) for name in names))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def with_account_key(df: DataFrame) -> DataFrame:
    return df.withColumn("account_key", account_key(F.col("account_code"), F.col("account_name")))
