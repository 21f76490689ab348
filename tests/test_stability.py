"""Stability of rankings when a repeat ranks all challenges alike."""

import compare
import duckdb
import pytest

from quiltomics import registry

registry.load()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three nations; repeats 1 and 2 differ between them, repeat 3 is the same for all."""
    path = tmp_path_factory.mktemp("scores")
    with duckdb.connect() as c:
        c.execute(f"COPY (SELECT i AS n_nationkey, 0 AS n_regionkey FROM range(3) r(i)) TO '{path}/nation.parquet'")
        c.execute(f"COPY (SELECT i AS c_custkey, i::INT AS c_nationkey FROM range(3) r(i)) TO '{path}/customer.parquet'")
        c.execute(
            f"""COPY (SELECT n AS o_custkey, r || '-P' AS o_orderpriority,
              CASE WHEN r < 3 AND i <= n OR r = 3 AND i < 2 THEN 200000.0 ELSE 1.0 END AS o_totalprice
              FROM range(3) a(n), range(1, 4) b(r), range(4) c(i)) TO '{path}/orders.parquet'"""
        )
    return str(path)


def _check(spark, folder, name):
    connection = duckdb.connect()
    for table in ("nation", "customer", "orders"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return compare.check(spark, connection, folder, name, registry.QUERIES[name], registry.ORACLES[name])[:2]


def test_pairs_without_a_correlation_are_kept(spark, folder):
    assert _check(spark, folder, "pairwise_spearman") == (None, 3)


def test_pairs_without_a_correlation_count(spark, folder):
    assert _check(spark, folder, "ranking_stability") == (None, 1)
