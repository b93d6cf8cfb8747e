"""Every registered query against its DuckDB twin at sf0.01 (the correctness gate)."""
import pytest

from envlab.checks.compare import compare, type_mismatches
from envlab.checks.oracle import SQL
from envlab.plans.registry import QUERIES

from .conftest import SF001

NAMES = sorted(n for n in QUERIES if n in SQL)


def test_every_query_has_a_twin_or_is_listed():
    assert set(QUERIES) - set(SQL) == {"fit_pooled", "fit_env_heads", "fit_heads_turns"}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql_twin(spark, duck001, name):
    # exact: same rows, same values (floats are rounded the same way in both engines), same types
    df = QUERIES[name](spark, SF001)
    ok, msg = compare(df, duck001, SQL[name])
    assert ok, msg
    assert not type_mismatches(df, duck001, SQL[name])


def test_entry_smoke(spark):
    import importlib.util
    import os

    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.columns == ["profession", "train_count", "val_count"]
    assert df.count() >= 0
    assert set(mod.oracle_sql()) <= set(mod.queries())
