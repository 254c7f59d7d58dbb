"""Every registered query of the frame operators against its SQL."""

import oracle
import pytest
from conftest import SF

from quarryframe.plans import queries as plans


@pytest.mark.parametrize("name", plans.SQL)
def test_query(spark, duck, name):
    assert oracle.differences(plans.QUERIES[name](spark, SF), duck, plans.SQL[name]) == ""


def test_whole_joins_keep_every_row(spark):
    customers, orders = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("customer", "orders"))
    found = {how: plans.QUERIES[f"join_{how}"](spark, SF).cache() for how in ("left", "right", "outer")}
    assert {how: found[how].select("c_name").dropna().distinct().count() for how in ("left", "outer")} == dict.fromkeys(("left", "outer"), customers)
    assert {how: found[how].select("o_orderkey").dropna().distinct().count() for how in ("right", "outer")} == dict.fromkeys(("right", "outer"), orders)
    assert found["outer"].where("o_orderkey IS NULL").count() and found["outer"].where("c_name IS NULL").count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
