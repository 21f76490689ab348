"""The bindings in oracle SQL, as common table expressions."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "cat": (
        (),
        """
  SELECT 'ds_' || p_partkey AS dataset_id, p_partkey AS k, '1.2' AS schema_version,
    CASE WHEN p_partkey % 4 <= 1 THEN 'full' WHEN p_partkey % 4 = 2 THEN 'train' ELSE 'test' END
      AS dataset_type,
    p_name AS title, p_type || ' ' || p_name AS description, ['SRC_' || p_type] AS source,
    [p_brand] AS organism, string_split(p_name, ' ') AS tissue,
    ['cell', 'spot', 'tile'][p_size % 3 + 1] AS spatial_unit,
    CASE WHEN p_size % 5 = 0 THEN 'furlong' ELSE 'micrometer' END AS coordinate_unit,
    CASE WHEN p_size % 4 = 0 THEN 'partially_shared' ELSE 'same_unit' END AS pairing_type,
    CASE WHEN p_partkey % 4 >= 2 THEN 'split_' || (p_partkey // 4) END AS split_id,
    CASE WHEN p_partkey % 4 >= 2 THEN
      ['same_slice', 'cross_slice_same_subject', 'cross_subject'][(p_partkey // 4) % 3 + 1] END
      AS challenge_type,
    CASE WHEN p_partkey % 4 >= 2 THEN
      ['ds_' || (p_partkey // 4 * 4), 'ds_' || (p_partkey // 4 * 4 + 1)] END AS sources,
    CASE WHEN p_partkey % 4 >= 2 THEN
      ['ds_' || (p_partkey // 4 * 4) || '::s1', 'ds_' || (p_partkey // 4 * 4) || '::s2',
       'ds_' || (p_partkey // 4 * 4 + 1) || '::s1', 'ds_' || (p_partkey // 4 * 4 + 1) || '::s2']
      ELSE ['s1', 's2'] END AS sample_ids,
    [p_type] AS keywords, CAST(p_size * 10 AS BIGINT) AS n_obs, CAST(p_size AS BIGINT) AS file_size,
    sha256(CAST(p_partkey AS VARCHAR)) AS sha256, 1704067200 + p_partkey * 3600 AS imported_at,
    p_size
  FROM part""",
    ),
    "mods": (
        (),
        """
  SELECT 'ds_' || l_partkey AS dataset_id, l_returnflag AS name,
    list_sort(list(DISTINCT l_linestatus)) AS technology,
    CASE l_returnflag WHEN 'R' THEN 'unknown' WHEN 'N' THEN 'counts' ELSE 'raw' END AS value_type,
    count(DISTINCT l_orderkey) AS n_obs, count(DISTINCT l_suppkey) AS n_vars
  FROM lineitem GROUP BY l_partkey, l_returnflag""",
    ),
    "declared": (
        ("cat",),
        """
  SELECT dataset_id, split_id, u.pos AS source_ord, u.source_id FROM
    (SELECT dataset_id, split_id, unnest(sources) AS source_id,
       generate_subscripts(sources, 1) - 1 AS pos FROM cat WHERE dataset_type <> 'full') u""",
    ),
    "chal": (
        ("cat",),
        """
  SELECT split_id, max(dataset_id) FILTER (dataset_type = 'train') AS train_id,
    max(dataset_id) FILTER (dataset_type = 'test') AS test_id,
    coalesce(max(challenge_type) FILTER (dataset_type = 'train'),
             max(challenge_type) FILTER (dataset_type = 'test')) AS challenge_type
  FROM cat WHERE split_id IS NOT NULL GROUP BY split_id""",
    ),
    "obs": (
        (),
        """
  SELECT 'atlas' AS dataset_id, CAST(o_orderkey AS VARCHAR) AS obs_id, o_orderkey AS obs_ord,
    o_orderpriority AS sample_id, o_totalprice AS x,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y,
    o_orderstatus AS source_dataset_id, CAST(o_orderkey AS VARCHAR) AS source_obs_id,
    o_custkey AS subject
  FROM orders""",
    ),
    "lobs": (
        ("obs",),
        """
  SELECT obs.*, c_mktsegment AS cell_type FROM obs LEFT JOIN customer ON c_custkey = subject""",
    ),
    "regions": (
        (),
        """
  SELECT * FROM (VALUES ('1-URGENT', 0, 250000, 0, 1200), ('1-URGENT', 200000, 300000, 600, 1800),
    ('5-LOW', 100000, 400000, 365, 730)) r(sample_id, x_min, x_max, y_min, y_max)""",
    ),
    "sides": (
        ("obs", "regions"),
        """
  SELECT obs.*, CASE WHEN EXISTS (SELECT 1 FROM regions r WHERE r.sample_id = obs.sample_id
      AND obs.x BETWEEN r.x_min AND r.x_max AND obs.y BETWEEN r.y_min AND r.y_max)
    THEN 'test' ELSE 'train' END AS side
  FROM obs""",
    ),
    "x": (
        (),
        """
  SELECT 'rna' AS modality, CAST(l_orderkey AS VARCHAR) AS obs_id, 'g' || l_partkey AS feature_id,
    l_partkey AS feature_ord, l_orderkey AS obs_ord, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value
  FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL
  SELECT 'protein', CAST(l_orderkey AS VARCHAR), 'p' || l_suppkey, l_suppkey, l_orderkey,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT)
  FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey, l_suppkey""",
    ),
    "rna": (("x",), "SELECT * FROM x WHERE modality = 'rna'"),
    "members": (("x",), "SELECT DISTINCT modality, obs_id, obs_ord FROM x"),
    "feat": (
        (),
        """
  SELECT o_orderpriority AS source_id, CAST(left(o_orderpriority, 1) AS BIGINT) AS source_ord,
    'g' || l_partkey AS feature_id, l_partkey AS feature_ord, 'c' || (l_partkey % 500) AS canonical_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderpriority, l_partkey HAVING max(l_quantity) >= 45""",
    ),
    "evt": (
        (),
        """
  SELECT event_id AS id, 'u' || user_id AS session_id, ts AS occurred_at,
    CASE event_type WHEN 'click' THEN 'page_view' WHEN 'view' THEN 'catalogue_search'
      WHEN 'signup' THEN 'database_detail_view' WHEN 'error' THEN 'challenge_detail_view'
      WHEN 'purchase' THEN 'download' END AS event_type,
    '/' || event_type AS path, props AS details,
    CAST(json_extract_string(props, '$.k') AS INTEGER) < 10 AS automated,
    CASE WHEN event_id % 20 = 0 THEN 404 ELSE 200 END AS status_code, value AS duration_ms,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS marker,
    event_type AS route_name, '10.0.' || (user_id % 256) || '.' || (event_id % 256) AS ip_address,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 10 THEN 'Crawlerbot/1.0' ELSE 'Mozilla/5.0' END AS user_agent,
    CASE WHEN event_id % 3 > 0 THEN '/from/' || event_type END AS referrer
  FROM events""",
    ),
    "pts": (
        (),
        """
  SELECT CAST(vec_id AS VARCHAR) AS obs_id, vec_id AS obs_ord,
    CASE WHEN label < 5 THEN 'train' ELSE 'test' END AS domain, 'L' || label AS truth,
    CAST(vec_id % 4 AS VARCHAR) AS sample_id, CAST(embedding AS DOUBLE[]) AS vector
  FROM embeddings""",
    ),
    "ls": (
        ("pts",),
        """
  SELECT obs_id, obs_ord, truth, sample_id, i AS label_ord, 'L' || i AS label, vector[i + 1] AS score
  FROM pts, (SELECT unnest(range(10)) AS i)""",
    ),
    "cells": (
        (),
        """
  SELECT o_orderkey AS cell_id, o_orderpriority AS donor_id, n_name AS cell_type,
    'CL:' || lpad(CAST(n_nationkey AS VARCHAR), 7, '0') AS ontology_id,
    'coll_' || n_regionkey AS dataset_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "scores": (
        (),
        """
  SELECT 'split_' || n_nationkey AS split_id, 'type_' || n_regionkey AS challenge_type,
    CAST(left(o_orderpriority, 1) AS INTEGER) AS repeat,
    round(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) / count(*), 2) AS auroc
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_nationkey, n_regionkey, o_orderpriority""",
    ),
}


def using(*names: str, more: str = "") -> str:
    """``WITH`` clause that defines the named views and what they need; ``more`` adds CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in ordered]
    if more:
        parts.append(more)
    return "WITH " + ",\n".join(parts) + "\n"
