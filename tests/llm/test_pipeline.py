"""The pipeline stage by stage against brute force, and the registered queries of the folder."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as entries  # noqa: E402
import corpus_pipeline  # noqa: E402
from tallywright.llm.queries import QUERIES, SQL  # noqa: E402
from test_operators import brute_classes, check_pieces, without_repeats  # noqa: E402
from verify import compare, database  # noqa: E402

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(entries.queries()[name](spark, DATA), database(DATA), name) == ""


def test_all_operators_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) <= set(entries.queries()) and "pipeline" in entries.queries()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def texts(df):
    return sorted(tuple(r) for r in df.select("doc_id", "text").collect())


def test_stages(stages):
    given, good, first, unrepeated, clean, packed = stages
    for df in (good, first, unrepeated, clean):
        assert df.columns == given.columns
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall())
    kept = {i for i, _ in texts(good)}
    low = [i for i, q in labels.items() if q == 0]
    high = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in low) < 0.1 * len(low) and sum(i in kept for i in high) > 0.98 * len(high)
    assert set(texts(good)) <= set(texts(given))

    # One document of each class, the lowest id.
    want = {c for _, c in brute_classes(texts(good))}
    assert {i for i, _ in texts(first)} == want

    removed = {r[0]: r for r in without_repeats(texts(first))}
    changed = {i for i, r in removed.items() if r[2]}
    before, after = dict(texts(first)), dict(texts(unrepeated))
    for i, text in before.items():
        if i not in changed:
            assert after[i] == text
        elif i in after:
            assert len(after[i].encode()) <= removed[i][1] - removed[i][2]
    assert {r.doc_id for r in unrepeated.collect() if r.n_chars != len(r.text) and r.doc_id in changed} == set()

    from tallywright.llm import decontamination

    items = clean.sparkSession.read.parquet(f"{DATA}/benchmark.parquet")
    bad = {r.doc_id for r in decontamination.contained(unrepeated, items).collect()}
    assert {i for i, _ in texts(clean)} == set(after) - bad

    from tallywright.llm import packing
    from tallywright.llm.queries import vocabulary

    check_pieces(packing.pack(clean, vocabulary("word_bpe_49k.json")).collect(), texts(clean))
    assert packed.count() > 0


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[-1].count()
