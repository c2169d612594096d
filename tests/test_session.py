from __future__ import annotations

import pytest

from tallywright import session


def test_stored_tables_are_read_back(spark):
    df = spark.range(5).selectExpr("id", "CAST(id AS decimal(18,2)) AS amount")
    stored = session.write_through(df)
    assert stored.dtypes == df.dtypes and sorted(stored.collect()) == sorted(df.collect())
    assert "tallywright" in stored.inputFiles()[0]
    assert session.shared_path(spark) != session.shared_path(spark)


def test_without_a_shared_folder_the_plan_stays(spark, monkeypatch):
    monkeypatch.setattr(session, "shared_path", lambda _: None)
    df = spark.range(5)
    assert session.write_through(df) is df


def test_together_keeps_order_and_raises(spark):
    first, second = session.together(lambda: spark.range(1), lambda: spark.range(2))
    assert (first.count(), second.count()) == (1, 2)

    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError):
        session.together(lambda: spark.range(1), fails)


def test_configuration(spark):
    session.configure(spark)
    assert all(spark.conf.get(k) == v for k, v in session.SESSION_CONF.items())
