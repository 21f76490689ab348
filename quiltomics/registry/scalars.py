"""Scalar function queries over the driver tables."""

from pyspark.sql import functions as F

from quiltomics import schema
from quiltomics.functions import scalar as Z
from quiltomics.registry import query
from quiltomics.registry.views import using
from quiltomics.sources import bindings as B


def _part(spark, d):
    return B.table(spark, d, "part")


@query(
    "fn_clean_list",
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 7 = 0 THEN NULL ELSE p_name || '|' || p_type END AS cleaned,
      nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE ' ' || p_name END), '') AS label FROM part""",
)
def _(spark, d):
    size = F.col("p_size")
    values = (
        F.when(size % 5 == 0, F.array("p_name", F.concat(F.col("p_name"), F.lit(" "))))
        .when(size % 7 == 0, F.array("p_name", F.lit(" ")))
        .otherwise(F.array(F.concat(F.lit(" "), F.col("p_name")), F.concat(F.col("p_type"), F.lit(" "))))
    )
    text = F.when(size % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name")))
    return _part(spark, d).select(
        "p_partkey", F.array_join(Z.clean_list(values), "|").alias("cleaned"), Z.clean_text(text).alias("label")
    )


_IDS = (
    "CASE p_size % 6 WHEN 0 THEN 'ds_' || p_partkey WHEN 1 THEN '-x' WHEN 2 THEN 'CL:0000' || lpad(CAST(p_size AS VARCHAR), 3, '0')"
    " WHEN 3 THEN '#a0B1c2' WHEN 4 THEN sha256(p_name) ELSE 'a b' END"
)


@query(
    "fn_id_rules",
    f"""SELECT p_partkey, regexp_full_match(i, '[A-Za-z0-9][A-Za-z0-9._-]{{0,127}}') AS dataset_id,
      regexp_full_match(i, 'CL:[0-9]{{7}}') AS ontology_id, regexp_full_match(i, '#[0-9A-Fa-f]{{6}}') AS colour,
      regexp_full_match(i, '[0-9a-f]{{64}}') AS sha256, regexp_full_match(i, '[a-z0-9][a-z0-9_-]{{0,63}}') AS auxiliary_id
      FROM (SELECT p_partkey, {_IDS} AS i FROM part)""",
)
def _(spark, d):
    k = F.col("p_size") % 6
    value = (
        F.when(k == 0, F.concat(F.lit("ds_"), F.col("p_partkey").cast("string")))
        .when(k == 1, "-x")
        .when(k == 2, F.concat(F.lit("CL:0000"), F.lpad(F.col("p_size").cast("string"), 3, "0")))
        .when(k == 3, "#a0B1c2")
        .when(k == 4, F.sha2("p_name", 256))
        .otherwise("a b")
    )
    rules = {
        "dataset_id": schema.DATASET_ID_PATTERN,
        "ontology_id": schema.ONTOLOGY_ID_PATTERN,
        "colour": schema.COLOUR_PATTERN,
        "sha256": schema.SHA256_PATTERN,
        "auxiliary_id": schema.AUXILIARY_ID_PATTERN,
    }
    return _part(spark, d).select("p_partkey", *[F.rlike(value, F.lit(p)).alias(n) for n, p in rules.items()])


@query(
    "fn_prefix",
    """SELECT o_orderkey, o_orderstatus || '::' || o_orderpriority AS encoded, o_orderpriority AS stripped,
      'x::' || o_orderpriority AS other FROM orders""",
)
def _(spark, d):
    encoded = Z.prefixed(F.col("o_orderstatus"), F.col("o_orderpriority"))
    other = Z.prefixed(F.lit("x"), F.col("o_orderpriority"))
    return B.table(spark, d, "orders").select(
        "o_orderkey",
        encoded.alias("encoded"),
        Z.without_prefix(F.col("o_orderstatus"), encoded).alias("stripped"),
        Z.without_prefix(F.col("o_orderstatus"), other).alias("other"),
    )


@query(
    "fn_like_escape",
    r"""SELECT doc_id, sha256(replace(replace(replace(text, '\', '\\'), '%', '\%'), '_', '\_')) AS digest FROM documents""",
)
def _(spark, d):
    return B.table(spark, d, "documents").select(
        "doc_id", F.sha2(Z.like_literal(F.col("text")), 256).alias("digest")
    )


@query(
    "fn_casefold",
    "SELECT s_suppkey, lower(s_name) = lower(upper(s_name)) AS same, lower(s_name) AS folded FROM supplier",
)
def _(spark, d):
    return B.table(spark, d, "supplier").select(
        "s_suppkey", Z.same_folded(F.col("s_name"), F.upper("s_name")).alias("same"), F.lower("s_name").alias("folded")
    )


@query(
    "fn_date_parse",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) - INTERVAL 29 DAY AS first_day, NULL::DATE AS bad FROM orders""".replace(
        "CAST(o_orderdate AS DATE) - INTERVAL 29 DAY", "CAST(CAST(o_orderdate AS DATE) - INTERVAL 29 DAY AS DATE)"
    ),
)
def _(spark, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    wrong = F.date_format("o_orderdate", "dd/MM/yyyy")
    day = Z.iso_day(text)
    return B.table(spark, d, "orders").select(
        "o_orderkey", day.alias("day"), Z.default_range_start(day).alias("first_day"), Z.iso_day(wrong).alias("bad")
    )


@query(
    "fn_iso_timestamp",
    """SELECT event_id, left(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 23) || 'Z' AS text,
      CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 - CASE WHEN event_id % 4 = 0 THEN 7200000 ELSE 0 END END AS millis FROM events""",
)
def _(spark, d):
    from quiltomics.operators.events import iso_millis

    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    k = F.col("event_id") % 4
    zoned = F.concat(stamp, F.when(k == 0, "+02:00").when(k == 2, "Z").otherwise(""))
    return B.table(spark, d, "events").select(
        "event_id", iso_millis(F.col("ts")).alias("text"), F.unix_millis(Z.zoned_instant(zoned)).alias("millis")
    )


@query(
    "fn_day_bounds",
    """SELECT event_id, epoch_us(date_trunc('day', ts)) AS low_us, epoch_us(date_trunc('day', ts)) + 86400000000 AS high_us FROM events""",
)
def _(spark, d):
    low, high = Z.day_bounds(F.to_date("ts"))
    return B.table(spark, d, "events").select(
        "event_id",
        F.unix_micros(low.cast("timestamp")).alias("low_us"),
        F.unix_micros(high.cast("timestamp")).alias("high_us"),
    )


@query(
    "fn_retention_cutoff",
    "SELECT event_id, ts < TIMESTAMP '2024-02-10 06:00:00' - INTERVAL 30 DAY AS expired FROM events",
)
def _(spark, d):
    cutoff = Z.retention_cutoff(F.lit("2024-02-10 06:00:00").cast("timestamp_ntz"), 30)
    return B.table(spark, d, "events").select("event_id", (F.col("ts") < cutoff).alias("expired"))


@query(
    "fn_numeric",
    """SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, round(sum(ln(1 + l_quantity)), 4) AS log1p,
      round(sum(1 / (1 + exp(-(l_discount * 10 - 0.5)))), 6) AS sigmoid, round(sum(least(30, greatest(5, l_quantity))), 6) AS clipped,
      CAST(sum(round_even(l_quantity / 2, 0)) AS BIGINT) AS half_even FROM lineitem GROUP BY ALL""",
)
def _(spark, d):
    quantity = F.col("l_quantity")
    return B.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.log1p(quantity)), 4).alias("log1p"),
        F.round(F.sum(Z.sigmoid(F.col("l_discount") * 10 - 0.5)), 6).alias("sigmoid"),
        F.round(F.sum(Z.clip(quantity, 5.0, 30.0)), 6).alias("clipped"),
        F.sum(Z.half_even(quantity / 2)).alias("half_even"),
    )


@query(
    "fn_entropy",
    using("pts")
    + """SELECT obs_id, round(list_sum(list_transform(w, lambda p: -p * ln(p))) / ln(len(w)), 6) AS entropy,
      round(exp(list_sum(list_transform(w, lambda p: -p * ln(p)))), 6) AS effective FROM
      (SELECT obs_id, list_transform(vector, lambda v: abs(v) / list_sum(list_transform(vector, lambda u: abs(u)))) AS w FROM pts)""",
)
def _(spark, d):
    sizes = F.transform("vector", lambda v: F.abs(v))
    total = F.aggregate(sizes, F.lit(0.0), lambda a, v: a + v)
    weights = B.points(spark, d).select("obs_id", sizes.alias("h"), total.alias("t")).select(
        "obs_id", F.transform("h", lambda v: v / F.col("t")).alias("w")
    )
    return weights.select(
        "obs_id",
        F.round(Z.normalised_entropy(F.col("w")), 6).alias("entropy"),
        F.round(Z.effective_types(F.col("w")), 6).alias("effective"),
    )


@query(
    "fn_logistic",
    using("pts")
    + "SELECT obs_id, round(1 / (1 + exp(-(0.5 + 2.0 * vector[1] - 1.5 * vector[2]))), 6) AS probability FROM pts",
)
def _(spark, d):
    from quiltomics.operators.calibration import logistic

    rows = B.points(spark, d).select(
        "obs_id", F.element_at("vector", 1).alias("a"), F.element_at("vector", 2).alias("b")
    )
    return rows.select("obs_id", F.round(logistic({"intercept": 0.5, "a": 2.0, "b": -1.5}), 6).alias("probability"))


@query(
    "fn_reliability",
    using("pts")
    + "SELECT obs_id, round(vector[1] + 0.5 * coalesce(CASE WHEN obs_ord % 3 > 0 THEN vector[2] END, 0), 6) AS raw FROM pts",
)
def _(spark, d):
    from quiltomics.operators.calibration import reliability

    delta = F.when(F.col("obs_ord") % 3 > 0, F.element_at("vector", 2))
    return B.points(spark, d).select(
        "obs_id", F.round(reliability(F.element_at("vector", 1), delta, 0.5), 6).alias("raw")
    )


@query(
    "fn_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
      '{"a":' || event_id || ',"b":"' || event_type || '","c":' || user_id || '}' AS canonical FROM events""",
)
def _(spark, d):
    return B.table(spark, d, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        Z.canonical_json({"c": F.col("user_id"), "a": F.col("event_id"), "b": F.col("event_type")}).alias("canonical"),
    )


@query(
    "fn_json_list",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name || '|' || p_type END AS items FROM part""",
)
def _(spark, d):
    k = F.col("p_size") % 4
    text = (
        F.when(k == 0, F.to_json(F.array("p_name", "p_type")))
        .when(k == 1, F.to_json(F.array("p_name", "p_name")))
        .when(k == 2, F.lit('["a", ""]'))
        .otherwise(F.lit("{broken"))
    )
    return _part(spark, d).select("p_partkey", F.array_join(Z.json_string_list(text), "|").alias("items"))


@query(
    "fn_arrays",
    """SELECT p_partkey, list_contains(w, 'widget') AS has_widget, CAST(coalesce(list_position(w, 'ring'), 0) AS BIGINT) AS ring_at,
      array_to_string(w[1:1], '|') AS first_word, len(list_distinct(w || w)) AS n_words FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""",
)
def _(spark, d):
    words = F.split("p_name", " ")
    return _part(spark, d).select(
        "p_partkey",
        F.array_contains(words, "widget").alias("has_widget"),
        F.array_position(words, "ring").alias("ring_at"),
        F.array_join(F.slice(words, 1, 1), "|").alias("first_word"),
        F.size(F.array_distinct(F.concat(words, words))).cast("long").alias("n_words"),
    )


@query(
    "fn_map_lookup",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'O' THEN 'train' ELSE 'other' END AS kind FROM orders""",
)
def _(spark, d):
    names = F.create_map(F.lit("F"), F.lit("full"), F.lit("O"), F.lit("train"))
    return B.table(spark, d, "orders").select(
        "o_orderkey", Z.lookup(names, F.col("o_orderstatus"), F.lit("other")).alias("kind")
    )


@query("fn_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


_UUID = "left(sha256(CAST(o_orderkey AS VARCHAR)), 32)"


@query(
    "fn_uuid",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN left(h, 8) || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] END AS session_id
      FROM (SELECT o_orderkey, {_UUID} AS h FROM orders)""",
)
def _(spark, d):
    key = F.col("o_orderkey")
    bare = F.substring(F.sha2(key.cast("string"), 256), 1, 32)
    parts = [F.substring(bare, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    value = (
        F.when(key % 4 == 0, F.upper(F.concat_ws("-", *parts)))
        .when(key % 4 == 1, bare)
        .when(key % 4 == 2, F.concat(bare, F.lit("------")))
        .otherwise("visitor")
    )
    return B.table(spark, d, "orders").select("o_orderkey", Z.session_uuid(value).alias("session_id"))


@query(
    "fn_range",
    "SELECT o_orderkey, o_totalprice BETWEEN 1000 AND 200000 AND o_orderkey % 3 > 0 AS ok FROM orders",
)
def _(spark, d):
    value = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return B.table(spark, d, "orders").select("o_orderkey", Z.in_range(value, 1000.0, 200000.0).alias("ok"))


@query(
    "fn_warnings",
    """SELECT o_orderkey, concat_ws('|', CASE WHEN o_totalprice < 50000 THEN 'low' END, CASE WHEN o_totalprice > 400000 THEN 'high' END,
      CASE WHEN o_orderstatus = 'P' THEN 'pending' END) AS warnings FROM orders""",
)
def _(spark, d):
    flags = {
        "low": F.col("o_totalprice") < 50000,
        "high": F.col("o_totalprice") > 400000,
        "pending": F.col("o_orderstatus") == "P",
    }
    return B.table(spark, d, "orders").select("o_orderkey", F.array_join(Z.warning_list(flags), "|").alias("warnings"))


@query(
    "fn_status",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'Uncertain' WHEN o_orderstatus = 'O' THEN 'Mixed' ELSE 'Predicted' END AS status FROM orders""",
)
def _(spark, d):
    return B.table(spark, d, "orders").select(
        "o_orderkey", Z.status_of(F.col("o_totalprice") < 100000, F.col("o_orderstatus") == "O").alias("status")
    )


@query(
    "fn_three_valued",
    """SELECT o_orderkey, (o_orderstatus = 'F') OR (CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END < 100000) OR (o_totalprice < 20000) AS uncertain FROM orders""",
)
def _(spark, d):
    delta = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))
    value = Z.any_uncertain(F.col("o_orderstatus") == "F", delta < 100000, F.col("o_totalprice") < 20000)
    return B.table(spark, d, "orders").select("o_orderkey", value.alias("uncertain"))


@query(
    "fn_url",
    """SELECT page_id, regexp_matches(CASE page_id % 4 WHEN 0 THEN replace(url, 'http', 'ftp') WHEN 1 THEN 'http://' ELSE ' ' || url || ' ' END, '^ *https?://[^/ ]+') AS ok FROM pages""",
)
def _(spark, d):
    k = F.col("page_id") % 4
    value = (
        F.when(k == 0, F.replace(F.col("url"), F.lit("http"), F.lit("ftp")))
        .when(k == 1, "http://")
        .otherwise(F.concat(F.lit(" "), F.col("url"), F.lit(" ")))
    )
    return B.table(spark, d, "pages").select("page_id", Z.web_address(value).alias("ok"))
