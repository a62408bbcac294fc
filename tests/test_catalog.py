"""Every query of the library itself against its SQL, on the smallest tables."""

import pytest

from quillframe.plans import catalog
from tests.conftest import DATA, same_as_sql


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE])
def test_query_equals_sql(spark, name):
    same_as_sql(spark, catalog.QUERIES[name](spark, DATA), catalog.ORACLE[name])


def test_composite_keys_cover_the_whole_table(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    got = catalog.QUERIES["keyed_composite"](spark, DATA)
    assert got.count() == lines.select("l_orderkey", "l_linenumber").distinct().count() > 48


def test_approximate_top_values_hold_the_heaviest(spark):
    top = [r["value"] for r in catalog.QUERIES["top_values_approx"](spark, DATA).collect()]
    exact = spark.read.parquet(f"{DATA}/events.parquet").groupBy("user_id").count().orderBy("count", ascending=False).first()
    assert str(exact["user_id"]) in top


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["l_returnflag", "n", "quantity"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_training_operators():
    import subprocess
    import sys

    code = """
import importlib, pkgutil, sys
import quillframe
names = ["quillframe." + m.name for m in pkgutil.iter_modules(quillframe.__path__) if m.name != "llm"]
for name in names:
    names += [f"{name}.{m.name}" for m in pkgutil.iter_modules(getattr(importlib.import_module(name), "__path__", []))]
assert "quillframe.plans.catalog" in sys.modules
assert not [m for m in sys.modules if m.startswith("quillframe.llm")]
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
