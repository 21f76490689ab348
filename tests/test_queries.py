"""Every registered query against its oracle at the smallest scale."""

from pathlib import Path

import compare
import pytest

from quiltomics import registry

FOLDER = "/root/testdata/sf0.001"
registry.load()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def oracle():
    return compare.oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    problem, _rows, _seconds = compare.check(
        spark, oracle, FOLDER, name, registry.QUERIES[name], registry.ORACLES.get(name)
    )
    assert problem is None


def test_every_rule_is_registered():
    from quiltomics.operators.rules import RULES

    assert {f"rule_{code}" for code in RULES} <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark).collect()
    assert {r["side"] for r in rows} == {"train", "test"}
    assert set(contract.oracle_sql()) <= set(contract.queries())
