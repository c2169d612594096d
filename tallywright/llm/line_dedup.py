"""Lines that recur in many documents, kept only in the document with the largest id.

Everything here is DataFrame code that runs inside the JVM: no Python worker, no pandas, no RDD.

The method: every line gets a key (white space ``[\\x20\\x09-\\x0D]`` stripped at both ends,
A-Z lower-cased) and the key's 128-bit MD5 digest, which stands for it in every shuffle, so no
line's text is moved. Which documents hold a key is settled by two aggregations that combine on
the map side, first per (digest, document), then per digest,
so a line found in a third of all documents costs one partial row per task, never one task.
The digests of all lines are written once to the shared folder, and both steps read them.
Lines of dropped keys are then marked by a join that is salted over ``SPLITS`` parts, so a hot
key spreads over as many tasks. Marks come back per document, sorted by position, as a
compressed keep bitmap: the list of dropped runs ``(first, count)``. Texts are not carried
through any of it; :func:`kept_texts` applies the bitmaps to their documents.

Defined results for odd input:

* null or empty text: one empty line, never dropped (its key is shorter than ``SHORTEST``);
* rows with a null ``doc_id`` take no part: they hold no key and lose no line;
* repeated rows of one ``doc_id`` are one document for the count of holders; when that id is the
  largest holder, every such row keeps the line. Rows are told apart by (``doc_id``, 64-bit
  hash of the text), so equal repeated rows get equal results;
* keys are compared by their 128-bit digest, of the whole line however long: two different keys
  would have to collide in MD5; ties cannot arise, since the keeper is one id; an empty table
  gives an empty result;
* other columns, whatever their names, pass through :func:`kept_texts` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import stored

# Fixed values of the contract: the white space stripped from keys, and the case mapping.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A key shorter than this (in code points) is never dropped.
SHORTEST = 20
#: A key found in fewer documents than this is never dropped.
LEAST_DOCUMENTS = 3
#: Parts that the join of lines to dropped keys is salted over.
SPLITS = 16

RUNS = "array<struct<first:bigint,count:bigint>>"


def key_of(line: Column) -> Column:
    """The key of a line: stripped of white space at both ends, A-Z lower-cased.

    A line of ASCII alone (as many bytes as code points) takes Spark's ``lower``, which is the
    same there and much faster; other lines take ``translate``, which leaves all but A-Z alone.
    """
    return _lowered(F.trim(line, F.lit(WHITE)))


def _lowered(trimmed: Column) -> Column:
    ascii_only = F.octet_length(trimmed) == F.length(trimmed)
    return F.when(ascii_only, F.lower(trimmed)).otherwise(F.translate(trimmed, UPPER, LOWER))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identity(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines_of(documents: DataFrame) -> DataFrame:
    """(``_d``, ``_t``, ``_p``, ``_k``) of every line that could be dropped.

    Document, hash of its text, position from 0 and digest of the key; only lines with a key of
    ``SHORTEST`` code points or more, in documents with an id.
    """
    lines = documents.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_d"),
        _identity(F.col("text")).alias("_t"),
        F.posexplode(_split(F.col("text"))).alias("_p", "_l"),
    )
    # Trimming keeps the length of the key, so short lines are left before lower-casing.
    trimmed = lines.select("_d", "_t", F.col("_p").cast("long").alias("_p"), F.trim("_l", F.lit(WHITE)).alias("_k"))
    long_keys = trimmed.where(F.length("_k") >= SHORTEST)
    return long_keys.withColumn("_k", F.unhex(F.md5(_lowered(F.col("_k")))))


def dropped_keys(lines: DataFrame) -> DataFrame:
    """(``_k``, ``_keep``) of every key digest held by enough documents; ``_keep``: largest id."""
    holders = lines.select("_k", "_d").distinct()
    counted = holders.groupBy("_k").agg(F.count("*").alias("_n"), F.max("_d").alias("_keep"))
    return counted.where(F.col("_n") >= LEAST_DOCUMENTS).select("_k", "_keep")


def keep_bitmaps(documents: DataFrame) -> DataFrame:
    """Per distinct (``doc_id``, text) that loses lines: ``doc_id``, ``_t``, ``n_dropped``, ``dropped``.

    ``dropped`` lists the maximal runs of dropped lines as ``(first, count)``, positions from 0,
    in order. Documents that keep every line have no row here.
    """
    # Lines are split and digested once; both the count of holders and the marks read them.
    lines = stored(lines_of(documents.select("doc_id", "text")), "line-keys")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1)))
    keys = dropped_keys(lines).withColumn("_s", salts)
    marked = (
        lines.withColumn("_s", F.pmod(F.xxhash64("_d", "_t", "_p"), F.lit(SPLITS)))
        .join(keys, ["_k", "_s"])
        .where(F.col("_d") != F.col("_keep"))
        .select("_d", "_t", "_p")
        .distinct()
    )
    # Gaps and islands: along one document, position less order is constant within a run.
    order = Window.partitionBy("_d", "_t").orderBy("_p")
    runs = (
        marked.withColumn("_run", F.col("_p") - F.row_number().over(order))
        .groupBy("_d", "_t", "_run")
        .agg(F.min("_p").alias("first"), F.count("*").alias("count"))
        .groupBy("_d", "_t")
        .agg(F.array_sort(F.collect_list(F.struct("first", "count"))).alias("dropped"), F.sum("count").alias("n_dropped"))
    )
    return runs.select(F.col("_d").alias("doc_id"), "_t", F.col("n_dropped").cast("long"), "dropped")


def kept_texts(documents: DataFrame) -> DataFrame:
    """``documents`` with ``n_lines``, ``n_dropped``, ``dropped`` and ``kept`` (the remaining text).

    Every row of ``documents`` comes back once, with all its columns; ``kept`` joins the lines
    that stay by ``\\n``. Added names replace input columns of the same names.
    """
    bitmaps = keep_bitmaps(documents).select(
        F.col("doc_id").alias("_bd"), F.col("_t").alias("_bt"), F.col("n_dropped").alias("_bn"), F.col("dropped").alias("_br")
    )
    clash = {"n_lines", "n_dropped", "dropped", "kept", "_td", "_tt", "_bd", "_bt", "_bn", "_br"}
    rows = documents.select(
        *(F.col(f"`{c}`") for c in documents.columns if c not in clash),
        F.col("doc_id").alias("_td"),
        _identity(F.col("text")).alias("_tt"),
    )
    joined = rows.join(bitmaps, (F.col("_td") == F.col("_bd")) & (F.col("_tt") == F.col("_bt")), "left")
    lines = _split(F.col("text"))
    dropped = F.coalesce(F.col("_br"), F.expr(f"cast(array() as {RUNS})"))
    positions = F.flatten(F.transform(dropped, lambda r: F.sequence(r["first"], r["first"] + r["count"] - 1)))
    kept_at = F.array_except(F.sequence(F.lit(0).cast("long"), (F.size(lines) - 1).cast("long")), positions)
    kept = F.concat_ws("\n", F.transform(kept_at, lambda i: F.element_at(lines, (i + 1).cast("int"))))
    return joined.select(
        *(F.col(f"`{c}`") for c in documents.columns if c not in clash),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.col("_bn"), F.lit(0)).cast("long").alias("n_dropped"),
        dropped.alias("dropped"),
        kept.alias("kept"),
    )


def digest(kept: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped``, ``kept_sha256`` (lowercase hex of the kept text)."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
