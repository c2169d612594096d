"""Write, audit, publish: joined lines become visible only when they prove that nothing changed.

Line items are joined with their document headers and written to a staging folder beside the
target. The same job observes the lines before the join and the rows after it (count and
control total), so the audit costs no further pass over the data. Only when both agree is the
staging folder renamed to the target; otherwise it is removed, and the error names the header
keys whose rows differ, which is what multiplies lines in a left join.

Observed metrics may count a task twice when Spark runs a stage again after a lost executor.
So a disagreement is not trusted by itself: the written table and the source are counted once
more, and only a disagreement that this confirms refuses the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallywright.operators.checks import repeated_keys
from tallywright.operators.joins import attach_headers
from tallywright.operators.mapping import column

#: Keys named at most in the message of a refused table.
NAMED_KEYS = 20


class AuditFailed(ValueError):
    """The joined table does not keep the rows or the control total of its lines."""


@dataclass(frozen=True)
class Audit:
    rows_in: int
    rows_out: int
    total_in: Decimal | None
    total_out: Decimal | None
    path: str
    #: True if the observations disagreed and the tables were counted once more.
    recounted: bool = False


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _figures(df: DataFrame, amount: Column) -> tuple[Column, Column]:
    return F.count(F.lit(1)).alias("rows"), F.sum(amount).alias("total")


def publish_with_headers(
    lines: DataFrame,
    headers: DataFrame,
    target: str,
    keys: Sequence[str] = ("journal_no",),
    columns: Sequence[str] | None = None,
    amount: str | Column | None = None,
    replace: bool = False,
) -> Audit:
    """Join ``lines`` with ``headers`` (as :func:`attach_headers`), write, audit, publish to ``target``.

    ``amount`` (a column of the lines, or an expression over them) gives the control total; if
    none is named only rows are compared. An existing ``target`` is an error unless ``replace``,
    in which case the old table is moved aside and removed only after the new one is in place.
    """
    spark = lines.sparkSession
    value = F.lit(0) if amount is None else (column(amount) if isinstance(amount, str) else amount)
    fs, final = _fs(spark, target)
    if fs.exists(final) and not replace:
        raise FileExistsError(f"{target} exists; pass replace=True to publish over it")

    before, after = Observation("lines_before_join"), Observation("rows_after_join")
    observed = lines.observe(before, *_figures(lines, value))
    joined = attach_headers(observed, headers, keys, columns)
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    joined.observe(after, *_figures(joined, value)).write.parquet(staging)
    seen_in, seen_out = before.get, after.get
    audit = Audit(seen_in["rows"], seen_out["rows"], seen_in["total"], seen_out["total"], target)

    if (audit.rows_in, audit.total_in) != (audit.rows_out, audit.total_out):
        stored = spark.read.parquet(staging)
        again_in = lines.agg(*_figures(lines, value)).first()
        again_out = stored.agg(*_figures(stored, value)).first()
        audit = Audit(again_in["rows"], again_out["rows"], again_in["total"], again_out["total"], target, True)
        if (audit.rows_in, audit.total_in) != (audit.rows_out, audit.total_out):
            fs.delete(_fs(spark, staging)[1], True)
            raise AuditFailed(_refusal(audit, headers, keys, columns))

    if fs.exists(final):
        aside = _fs(spark, f"{target.rstrip('/')}.replaced-{uuid.uuid4().hex}")[1]
        fs.rename(final, aside)
        fs.rename(_fs(spark, staging)[1], final)
        fs.delete(aside, True)
    elif not fs.rename(_fs(spark, staging)[1], final):
        raise OSError(f"could not publish {staging} as {target}")
    return audit


def _refusal(audit: Audit, headers: DataFrame, keys: Sequence[str], columns: Sequence[str] | None) -> str:
    keys = list(keys)
    wanted = keys + [c for c in (columns if columns is not None else headers.columns) if c not in keys]
    distinct = headers.select(*(column(c) for c in wanted)).dropDuplicates()
    named = [tuple(r[k] for k in keys) for r in repeated_keys(distinct, keys).take(NAMED_KEYS)]
    return (
        f"not published: {audit.rows_in} lines went in and {audit.rows_out} rows came out, "
        f"control total {audit.total_in} against {audit.total_out}; "
        f"header keys with differing rows (at most {NAMED_KEYS}): {named}"
    )
