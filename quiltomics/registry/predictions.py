"""Prediction, calibration and visualisation queries."""

from pyspark.sql import functions as F

from quiltomics.operators import calibration as P
from quiltomics.operators import scoring as K
from quiltomics.registry import query
from quiltomics.registry.views import using
from quiltomics.sources import bindings as B

SCORE_KNOTS = ((0.0, 0.05), (0.15, 0.2), (0.25, 0.55), (0.5, 0.95))
PROBABILITY_KNOTS = ((0.0, 0.1), (0.3, 0.35), (0.6, 0.5), (1.0, 0.9))
COEFFICIENTS = {"intercept": -2.0, "top_weight": 4.0, "delta": 3.0, "entropy": -0.5}


def _values(knots):
    return "(VALUES " + ", ".join(f"({x}::DOUBLE, {y}::DOUBLE)" for x, y in knots) + ") k(x, y)"


def _interp(source, raw, knots, name, extra=""):
    """Oracle text of a piecewise linear interpolation."""
    return f"""{name}_k AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM {knots}),
    {name} AS (SELECT s.*, least(1, greatest(0, CASE WHEN k.x1 IS NULL THEN k.y ELSE k.y + (k.y1 - k.y) * (v - k.x) / (k.x1 - k.x) END)) AS confidence
      FROM (SELECT *, least((SELECT max(x) FROM {name}_k), greatest((SELECT min(x) FROM {name}_k), {raw})) AS v FROM {source}) s
      JOIN {name}_k k ON v >= k.x AND (k.x1 IS NULL OR v < k.x1))"""


_TOP = """r AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY score DESC, label_ord) AS rn FROM ls),
    t2 AS (SELECT a.obs_id, a.obs_ord, a.truth, a.sample_id, a.label, a.score AS best, b.label AS second_label,
      b.score AS second, a.score - b.score AS delta, a.score + 0.5 * (a.score - b.score) AS raw,
      CASE WHEN a.obs_ord % 10 = 0 THEN NULL WHEN a.obs_ord % 10 = 5 THEN '' ELSE a.label END AS pruned
      FROM r a JOIN r b ON a.obs_id = b.obs_id WHERE a.rn = 1 AND b.rn = 2)"""
TOP = using("ls", more=_TOP)
_STATUS = (
    _TOP
    + ",\n"
    + _interp("t2", "raw", _values(SCORE_KNOTS), "c")
    + """,
    st AS (SELECT *, coalesce(pruned, '') = '' AS pruned_missing, delta < 0.03 AS delta_below, best < 0.12 AS score_below,
      CASE WHEN coalesce(pruned, '') = '' OR delta < 0.03 OR best < 0.12 THEN 'Uncertain' ELSE 'Predicted' END AS status FROM c)"""
)
STATUS = using("ls", more=_STATUS)


def _knots(spark, knots):
    return spark.createDataFrame(list(knots), "x double, y double")


def _ontology(spark, d):
    labels = B.table(spark, d, "embeddings").select("label").distinct()
    return labels.select(
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"),
        F.concat(F.lit("CL:"), F.lpad(F.col("label").cast("string"), 7, "0")).alias("ontology_id"),
    )


def _best(spark, d):
    rows = B.points(spark, d).select("obs_id", "obs_ord", "truth", "sample_id")
    best = K.top_two(B.label_scores(spark, d))
    return best.join(rows, "obs_id").withColumn("raw", P.reliability(F.col("best"), F.col("delta"), 0.5))


def _pruned(spark, d):
    turn = F.col("obs_ord") % 10
    return _best(spark, d).select(
        "obs_id", F.when(turn == 0, None).when(turn == 5, "").otherwise(F.col("label")).alias("pruned_label")
    )


def _predictions(spark, d):
    judged = P.score_status(
        B.label_scores(spark, d), _pruned(spark, d), _knots(spark, SCORE_KNOTS), _ontology(spark, d), 0.5, 0.03, 0.12
    )
    rows = B.points(spark, d).select(
        "obs_id",
        "obs_ord",
        "truth",
        "sample_id",
        F.element_at("vector", 11).alias("x"),
        F.element_at("vector", 12).alias("y"),
    )
    return judged.join(rows, "obs_id")


@query(
    "top2_scores",
    TOP + "SELECT obs_id, label, round(best, 6) AS best, second_label, round(second, 6) AS second, round(delta, 6) AS delta FROM t2",
)
def _(spark, d):
    return K.top_two(B.label_scores(spark, d)).select(
        "obs_id",
        "label",
        F.round("best", 6).alias("best"),
        "second_label",
        F.round("second", 6).alias("second"),
        F.round("delta", 6).alias("delta"),
    )


@query(
    "interpolate_calibration",
    using("ls", more=_TOP + ",\n" + _interp("t2", "raw", _values(SCORE_KNOTS), "c"))
    + "SELECT obs_id, round(raw, 6) AS raw, round(confidence, 6) AS confidence FROM c",
)
def _(spark, d):
    judged = P.interpolate(_best(spark, d), "raw", _knots(spark, SCORE_KNOTS))
    return judged.select("obs_id", F.round("raw", 6).alias("raw"), F.round("confidence", 6).alias("confidence"))


@query(
    "score_status",
    STATUS
    + """SELECT obs_id, CASE WHEN pruned_missing THEN label ELSE pruned END AS label, status, round(confidence, 6) AS confidence,
      CASE WHEN status = 'Predicted' THEN 'CL:' || lpad(substr(label, 2), 7, '0') END AS ontology_id FROM st""",
)
def _(spark, d):
    return _predictions(spark, d).select(
        "obs_id", "label", "status", F.round("confidence", 6).alias("confidence"), "ontology_id"
    )


@query(
    "ontology_lookup",
    STATUS
    + """SELECT status, CASE WHEN status = 'Predicted' THEN 'CL:' || lpad(substr(label, 2), 7, '0') END AS ontology_id, count(*) AS n
      FROM st GROUP BY ALL""",
)
def _(spark, d):
    return _predictions(spark, d).groupBy("status", "ontology_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "display_label",
    STATUS + "SELECT obs_id, CASE WHEN status = 'Uncertain' THEN status ELSE label END AS category FROM st",
)
def _(spark, d):
    return _predictions(spark, d).select("obs_id", P.display_label("label", "status").alias("category"))


@query(
    "status_reasons",
    STATUS
    + """SELECT 'pruned_missing' AS reason, count(*) FILTER (pruned_missing) AS n FROM st UNION ALL
      SELECT 'delta_below', count(*) FILTER (delta_below) FROM st UNION ALL
      SELECT 'score_below', count(*) FILTER (score_below) FROM st""",
)
def _(spark, d):
    return P.status_reasons(_predictions(spark, d), ["pruned_missing", "delta_below", "score_below"])


@query(
    "status_fractions",
    STATUS
    + """SELECT sample_id, count(*) AS n_observations, round(avg(CASE WHEN status = 'Uncertain' THEN 1 ELSE 0 END), 6) AS uncertain_fraction,
      round(avg(CASE WHEN status = 'Mixed' THEN 1 ELSE 0 END), 6) AS mixed_fraction FROM st GROUP BY sample_id""",
)
def _(spark, d):
    return K.status_fractions(_predictions(spark, d), ["sample_id"]).select(
        "sample_id",
        "n_observations",
        F.round("uncertain_fraction", 6).alias("uncertain_fraction"),
        F.round("mixed_fraction", 6).alias("mixed_fraction"),
    )


_METRICS = """per AS (SELECT {g} t.truth, count(*) AS support, count(*) FILTER (t.predicted = t.truth) AS tp,
      (SELECT count(*) FROM p u WHERE u.predicted = t.truth {j}) AS claimed FROM p t GROUP BY {g} t.truth)"""


def _metrics_sql(view, groups=""):
    g, j = (f"t.{groups},", f"AND u.{groups} = t.{groups}") if groups else ("", "")
    tail = f"GROUP BY {groups}" if groups else ""
    head = f"{groups}," if groups else ""
    return (
        view.rstrip()
        + ",\n"
        + _METRICS.format(g=g, j=j)
        + f"""
    SELECT {head} round(avg(tp / support), 6) AS balanced_accuracy,
      round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (claimed + support) END), 6) AS macro_f1,
      CAST(sum(support) AS BIGINT) AS evaluated_cells, count(*) AS evaluated_types FROM per {tail}"""
    )


def _round_metrics(df, *keys):
    return df.select(
        *keys,
        F.round("balanced_accuracy", 6).alias("balanced_accuracy"),
        F.round("macro_f1", 6).alias("macro_f1"),
        "evaluated_cells",
        "evaluated_types",
    )


@query(
    "classification_metrics",
    _metrics_sql(TOP.rstrip() + ", p AS (SELECT truth, sample_id, nullif(pruned, '') AS predicted FROM t2)", "sample_id"),
)
def _(spark, d):
    rows = _best(spark, d).join(_pruned(spark, d), "obs_id").withColumn(
        "predicted", F.nullif(F.col("pruned_label"), F.lit(""))
    )
    return _round_metrics(K.classification_metrics(rows, "truth", "predicted", ["sample_id"]), "sample_id")


@query(
    "binary_label_metrics",
    _metrics_sql("WITH p AS (SELECT quality AS truth, 1 - toxic AS predicted FROM labels)"),
)
def _(spark, d):
    rows = B.table(spark, d, "labels").withColumn("predicted", 1 - F.col("toxic"))
    return _round_metrics(K.classification_metrics(rows, "quality", "predicted"))


@query(
    "expected_calibration_error",
    STATUS
    + """SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM
      (SELECT greatest(1, ceil(confidence * 10)) AS bin, count(*) AS n, avg(CASE WHEN label = truth THEN 1 ELSE 0 END) AS acc,
        avg(confidence) AS conf FROM st GROUP BY 1)""",
)
def _(spark, d):
    rows = P.interpolate(_best(spark, d), "raw", _knots(spark, SCORE_KNOTS))
    return K.expected_calibration_error(rows, F.col("label") == F.col("truth"), "confidence").select(
        F.round("ece", 6).alias("ece")
    )


def _nearest_sql(metric, view="t2"):
    return " UNION ALL ".join(
        f"""SELECT '{metric}' AS metric, '{k}' AS name, (SELECT {metric} FROM
        (SELECT {metric}, row_number() OVER (ORDER BY {metric}) - 1 AS rn, count(*) OVER () AS n FROM {view})
        WHERE rn = CAST(round_even({f} * (n - 1), 0) AS BIGINT)) AS value"""
        for k, f in K.SUMMARY_QUANTILES.items()
    )


@query(
    "quantile_summary_nearest",
    TOP
    + "SELECT metric, name, round(value, 6) AS value FROM ("
    + " UNION ALL ".join(_nearest_sql(m) for m in ("best", "second", "delta"))
    + ")",
)
def _(spark, d):
    return K.quantile_summary(_best(spark, d), ["best", "second", "delta"]).withColumn(
        "value", F.round("value", 6)
    )


@query(
    "failure_diagnostics",
    STATUS
    + "SELECT metric, name, round(value, 6) AS value FROM ("
    + " UNION ALL ".join(_nearest_sql(m, "st") for m in ("confidence", "best", "delta"))
    + " UNION ALL SELECT 'status_counts', status, count(*) FROM st GROUP BY status)",
)
def _(spark, d):
    rows = _predictions(spark, d)
    counts = rows.groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return (
        K.quantile_summary(rows, ["confidence", "best", "delta"])
        .unionByName(counts.select(F.lit("status_counts").alias("metric"), "name", "value"))
        .withColumn("value", F.round("value", 6))
    )


@query(
    "alternating_split_2",
    using("pts")
    + """SELECT obs_id, CASE WHEN row_number() OVER (PARTITION BY truth, sample_id ORDER BY obs_ord) % 2 = 1
      THEN 'calibration' ELSE 'evaluation' END AS part FROM pts""",
)
def _(spark, d):
    rows = B.points(spark, d).drop("vector")
    return P.alternating_split(rows, ["truth", "sample_id"], "obs_ord", ["calibration", "evaluation"]).select(
        "obs_id", "part"
    )


@query(
    "alternating_split_3",
    using("pts")
    + """SELECT obs_id, CASE row_number() OVER (PARTITION BY truth, sample_id ORDER BY obs_ord) % 3 WHEN 1
      THEN 'model_fit' WHEN 2 THEN 'recalibration' ELSE 'evaluation' END AS part FROM pts""",
)
def _(spark, d):
    rows = B.points(spark, d).drop("vector")
    return P.alternating_split(
        rows, ["truth", "sample_id"], "obs_ord", ["model_fit", "recalibration", "evaluation"]
    ).select("obs_id", "part")


@query(
    "stratified_kfold",
    using("pts")
    + """SELECT obs_id, domain, CAST((row_number() OVER (PARTITION BY domain ORDER BY sha256('7' || chr(0) || obs_id)) - 1) % 5 AS INTEGER) AS fold
      FROM pts""",
)
def _(spark, d):
    return P.stratified_folds(B.points(spark, d).drop("vector"), "domain", "obs_id", 5, 7).select(
        "obs_id", "domain", "fold"
    )


@query(
    "balanced_sample",
    using("pts")
    + """SELECT repeat, domain, obs_id FROM (SELECT repeat, domain, obs_id,
        row_number() OVER (PARTITION BY repeat, domain ORDER BY sha256('42' || chr(0) || repeat || chr(0) || obs_id)) AS rn
      FROM pts, (SELECT unnest(range(5)) AS repeat))
      WHERE rn <= least(200, (SELECT min(n) FROM (SELECT count(*) AS n FROM pts GROUP BY domain)))""".replace(
        "SELECT repeat, domain, obs_id FROM", "SELECT CAST(repeat AS INTEGER) AS repeat, domain, obs_id FROM", 1
    ),
)
def _(spark, d):
    return P.balanced_sample(B.points(spark, d).drop("vector"), "domain", "obs_id", 5, 200, 42).select(
        "repeat", "domain", "obs_id"
    )


_ISO = """cal AS (SELECT *, row_number() OVER (ORDER BY raw, obs_ord) AS i FROM (SELECT round(raw, 2) AS raw, obs_ord,
      CAST(label = truth AS INTEGER) AS v FROM (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY obs_ord) AS rn FROM t2) WHERE rn % 2 = 1)),
    cs AS (SELECT i, raw, sum(v) OVER (ORDER BY i) AS c FROM cal),
    ab AS (SELECT a.i AS a, b.i AS b, (b.c - coalesce(p.c, 0)) / (b.i - a.i + 1) AS m FROM cs a JOIN cs b ON b.i >= a.i LEFT JOIN cs p ON p.i = a.i - 1),
    lowest AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM ab),
    fit AS (SELECT i, max(m) AS f FROM lowest GROUP BY i),
    knots AS (SELECT raw AS x, least(1, greatest(0, avg(f))) AS y FROM cal JOIN fit USING (i) GROUP BY raw)"""


def _calibration_half(spark, d):
    rows = _best(spark, d).withColumn("correct", F.col("label") == F.col("truth"))
    return P.alternating_split(rows, ["truth"], "obs_ord", ["calibration", "evaluation"])


def _fitted(spark, d):
    half = _calibration_half(spark, d).where("part = 'calibration'").withColumn("raw", F.round("raw", 2))
    return P.isotonic_fit(half.withColumn("hit", F.col("correct").cast("int")), "raw", "hit", "obs_ord")


@query("isotonic_fit", using("ls", more=_TOP + ",\n" + _ISO) + "SELECT round(x, 2) AS x, round(y, 6) AS y FROM knots")
def _(spark, d):
    return _fitted(spark, d).select("x", F.round("y", 6).alias("y"))


@query(
    "isotonic_calibration",
    using("ls", more=_TOP + ",\n" + _ISO + ",\n" + _interp("t2", "raw", "knots", "c"))
    + "SELECT obs_id, round(confidence, 6) AS confidence FROM c",
)
def _(spark, d):
    return P.interpolate(_best(spark, d), "raw", _fitted(spark, d)).select(
        "obs_id", F.round("confidence", 6).alias("confidence")
    )


@query(
    "uncertain_thresholds",
    TOP
    + """, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY obs_ord) AS rn FROM t2) WHERE rn % 2 = 1 AND label = truth)
      SELECT 'uncertain_min_score' AS name, CASE WHEN count(*) >= 20 THEN round(quantile_cont(best, 0.05), 6) END AS value FROM c
      UNION ALL SELECT 'uncertain_min_delta', CASE WHEN count(*) >= 20 THEN round(quantile_cont(delta, 0.1), 6) END FROM c""",
)
def _(spark, d):
    half = _calibration_half(spark, d).where("part = 'calibration'")
    return P.uncertain_thresholds(half, 0.05, 0.1).withColumn("value", F.round("value", 6))


def _weights(spark, d):
    return B.label_scores(spark, d).where("score > 0 AND obs_ord % 17 <> 0").select(
        "obs_id", "label_ord", "label", F.col("score").alias("weight")
    )


_ALIGNED = """al AS (SELECT obs_id, obs_ord, label_ord, label, CASE WHEN score > 0 AND obs_ord % 17 <> 0 THEN score ELSE 0 END AS weight FROM ls),
    nt AS (SELECT obs_id, obs_ord, label_ord, label, sum(weight) OVER (PARTITION BY obs_id) > 0 AS converged,
      weight / CASE WHEN sum(weight) OVER (PARTITION BY obs_id) > 0 THEN sum(weight) OVER (PARTITION BY obs_id) ELSE 1 END AS p FROM al),
    cf AS (SELECT obs_id, arg_min(label, rn) AS label, max(p) FILTER (rn = 1) AS top_weight, max(p) FILTER (rn = 2) AS second_weight,
      max(p) FILTER (rn = 1) - max(p) FILTER (rn = 2) AS delta, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(10) AS entropy,
      exp(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)) AS effective_types, bool_and(converged) AS converged
      FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY p DESC, label_ord) AS rn FROM nt) GROUP BY obs_id)"""


@query(
    "align_weights",
    using("ls", more=_ALIGNED) + "SELECT obs_id, label, round(weight, 6) AS weight FROM al",
)
def _(spark, d):
    return P.align_weights(B.points(spark, d), _weights(spark, d)).select(
        "obs_id", "label", F.round("weight", 6).alias("weight")
    )


_CF_COLUMNS = ("top_weight", "second_weight", "delta", "entropy", "effective_types")


@query(
    "top2_weights",
    using("ls", more=_ALIGNED)
    + "SELECT obs_id, label, converged, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _CF_COLUMNS)
    + " FROM cf",
)
def _(spark, d):
    aligned = P.align_weights(B.points(spark, d), _weights(spark, d))
    return P.composition_features(aligned).select(
        "obs_id", "label", "converged", *[F.round(c, 6).alias(c) for c in _CF_COLUMNS]
    )


@query(
    "composition_status",
    using(
        "ls",
        more=_ALIGNED
        + ", pr AS (SELECT *, 1 / (1 + exp(-(-2.0 + 4.0 * top_weight + 3.0 * delta - 0.5 * entropy))) AS probability FROM cf),\n"
        + _interp("pr", "probability", _values(PROBABILITY_KNOTS), "c")
        + """, st AS (SELECT *, CASE WHEN NOT converged OR confidence < 0.3 THEN 'Uncertain'
          WHEN top_weight < 0.3 OR delta < 0.05 OR entropy > 0.8 THEN 'Mixed' ELSE 'Predicted' END AS status FROM c)""",
    )
    + """SELECT obs_id, label, status, round(confidence, 6) AS confidence,
      CASE WHEN status = 'Predicted' THEN 'CL:' || lpad(substr(label, 2), 7, '0') END AS ontology_id FROM st""",
)
def _(spark, d):
    aligned = P.align_weights(B.points(spark, d), _weights(spark, d))
    judged = P.composition_status(
        aligned, COEFFICIENTS, _knots(spark, PROBABILITY_KNOTS), _ontology(spark, d), 0.3, 0.3, 0.05, 0.8
    )
    return judged.select("obs_id", "label", "status", F.round("confidence", 6).alias("confidence"), "ontology_id")


@query("logistic_calibration")
def _(spark, d):
    aligned = P.align_weights(B.points(spark, d), _weights(spark, d))
    rows = (
        P.composition_features(aligned)
        .join(B.points(spark, d).select("obs_id", "obs_ord", "truth"), "obs_id")
        .withColumn("correct", (F.col("label") == F.col("truth")).cast("int"))
        .withColumn("mixed", F.col("obs_ord") % 2 == 1)
    )
    parts = P.alternating_split(rows, ["truth", "mixed"], "obs_ord", ["model_fit", "recalibration", "evaluation"])
    coefficients = P.fit_logistic(parts.where("part = 'model_fit'"), ["top_weight", "delta", "entropy"], "correct")
    scored = parts.withColumn("probability", P.logistic(coefficients))
    knots = P.isotonic_fit(scored.where("part = 'recalibration'"), "probability", "correct", "obs_ord")
    judged = P.interpolate(scored.where("part = 'evaluation'"), "probability", knots)
    ece = K.expected_calibration_error(judged, F.col("correct") == 1, "confidence")
    pure = K.classification_metrics(judged.where("NOT mixed"), "truth", "label")
    return pure.withColumn("ece", ece.select("ece").scalar())


@query(
    "source_label_predictions",
    using("lobs")
    + """SELECT obs_id, cell_type AS label, CASE cell_type WHEN 'BUILDING' THEN 'CL:0000001' WHEN 'MACHINERY' THEN 'CL:0000002' END AS ontology_id,
      'Source' AS status, NULL::DOUBLE AS confidence FROM lobs""",
)
def _(spark, d):
    ontology = spark.createDataFrame(
        [("BUILDING", "CL:0000001"), ("MACHINERY", "CL:0000002")], "source_label string, ontology_id string"
    )
    labelled = B.labelled_observations(spark, d).withColumnRenamed("cell_type", "label")
    return P.source_predictions(labelled, ontology)


def _categorised(spark, d):
    return _predictions(spark, d).withColumn("category", P.display_label("label", "status"))


_CATS = STATUS.rstrip() + """,
    ca AS (SELECT *, CASE WHEN status = 'Uncertain' THEN status ELSE label END AS category FROM st),
    cc AS (SELECT s.sample_id, k.category, (SELECT count(*) FROM ca WHERE ca.sample_id = s.sample_id AND ca.category = k.category) AS n
      FROM (SELECT DISTINCT sample_id FROM ca) s, (SELECT DISTINCT category FROM ca) k
      UNION ALL SELECT NULL, category, count(*) FROM ca GROUP BY category)
"""


@query("category_counts", _CATS + "SELECT * FROM cc")
def _(spark, d):
    return P.category_counts(_categorised(spark, d))


@query(
    "category_reconcile",
    _CATS
    + """, sp AS (SELECT sample_id, category, n + CASE WHEN sample_id = '2' AND category = 'Uncertain' THEN 3 ELSE 0 END AS n FROM cc),
      lv AS (SELECT category, CAST(sum(n) FILTER (sample_id IS NULL) AS BIGINT) AS whole, CAST(sum(n) FILTER (sample_id IS NOT NULL) AS BIGINT) AS samples FROM sp GROUP BY category)
      SELECT 'category:' || category AS level, whole, samples FROM lv WHERE whole <> samples
      UNION ALL SELECT 'observations', CAST(sum(whole) AS BIGINT), CAST(sum(samples) AS BIGINT) FROM lv HAVING sum(whole) <> sum(samples)""",
)
def _(spark, d):
    counts = P.category_counts(_categorised(spark, d))
    spoiled = counts.withColumn(
        "n",
        F.col("n")
        + F.when((F.col("sample_id") == "2") & (F.col("category") == "Uncertain"), 3).otherwise(0),
    )
    size = B.table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    return P.category_mismatches(spoiled, size.scalar())


@query(
    "legend_proportions",
    using("pts", more="""c AS (SELECT CAST(substr(truth, 2) AS BIGINT) AS type_id, count(*) AS n FROM pts GROUP BY 1),
      k AS (SELECT i AS type_id, 'Type ' || i AS label FROM (SELECT DISTINCT label + 3 AS i FROM embeddings))""")
    + """SELECT coalesce(c.type_id, k.type_id) AS type_id, coalesce(label, 'Unknown ' || c.type_id) AS label, coalesce(n, 0) AS n,
      round(coalesce(n, 0) / (SELECT sum(n) FROM c), 6) AS share FROM c FULL JOIN k ON c.type_id = k.type_id""",
)
def _(spark, d):
    counts = (
        B.points(spark, d)
        .groupBy(F.substring("truth", 2, 9).cast("long").alias("type_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    categories = (
        B.table(spark, d, "embeddings")
        .select((F.col("label") + 3).cast("long").alias("type_id"))
        .distinct()
        .withColumn("label", F.concat(F.lit("Type "), F.col("type_id").cast("string")))
    )
    return P.legend(counts, categories).withColumn("share", F.round("share", 6))


@query(
    "visualization_points",
    _CATS.replace("ls AS", "ls AS", 1)
    + """, ids AS (SELECT category, row_number() OVER (ORDER BY min(obs_ord)) - 1 AS type_id FROM ca GROUP BY category)
      SELECT ca.sample_id, ca.obs_id, round(CAST(CAST(pts.vector[11] AS FLOAT) AS DOUBLE), 6) AS x, round(CAST(CAST(pts.vector[12] AS FLOAT) AS DOUBLE), 6) AS y, type_id,
        round(CAST(CAST(confidence AS FLOAT) AS DOUBLE), 4) AS confidence
      FROM ca JOIN ids USING (category) JOIN pts USING (obs_id)""",
)
def _(spark, d):
    from quiltomics.operators.splits import first_appearance

    rows = _categorised(spark, d)
    ids = first_appearance(rows, "category").select("category", "type_id")
    return rows.join(ids, "category").select(
        "sample_id",
        "obs_id",
        F.round(F.col("x").cast("float").cast("double"), 6).alias("x"),
        F.round(F.col("y").cast("float").cast("double"), 6).alias("y"),
        "type_id",
        F.round(F.col("confidence").cast("float").cast("double"), 4).alias("confidence"),
    )


@query(
    "prediction_alignment",
    using("obs")
    + """SELECT obs_id, CASE WHEN sample_id = '2-HIGH' THEN 'missing_prediction' WHEN obs_ord % 30 = 0 THEN 'order'
      ELSE 'coordinates' END AS problem FROM obs WHERE sample_id = '2-HIGH' OR obs_ord % 30 = 0 OR obs_ord % 31 = 0""",
)
def _(spark, d):
    observed = B.observations(spark, d)
    predicted = observed.where("sample_id <> '2-HIGH'").select(
        "obs_id",
        F.when(F.col("obs_ord") % 31 == 0, F.col("x") + 1).otherwise(F.col("x")).alias("x"),
        "y",
        F.when(F.col("obs_ord") % 30 == 0, F.col("obs_ord") + 1).otherwise(F.col("obs_ord")).alias("obs_ord"),
    )
    return P.misaligned_predictions(predicted, observed)


@query(
    "sample_aligned_coords",
    using("members", "obs")
    + "SELECT obs_id, sample_id, x, y FROM obs WHERE obs_id IN (SELECT obs_id FROM members WHERE modality = 'rna')",
)
def _(spark, d):
    rna = B.memberships(spark, d).where("modality = 'rna'").select("obs_id")
    return rna.join(B.observations(spark, d), "obs_id").select("obs_id", "sample_id", "x", "y")


_GATES = (
    ("balanced_accuracy", "min", 0.1),
    ("macro_f1", "min", 0.09),
    ("ece", "max", 0.4),
    ("uncertain_fraction", "max", 0.6),
    ("shared_genes", "min", 100.0),
)


@query(
    "qc_gates",
    STATUS.rstrip()
    + """,
    p AS (SELECT truth, sample_id, nullif(pruned, '') AS predicted FROM st),
    """
    + _METRICS.format(g="t.sample_id,", j="AND u.sample_id = t.sample_id")
    + """,
    m AS (SELECT sample_id, round(avg(tp / support), 6) AS ba, round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (claimed + support) END), 6) AS f1 FROM per GROUP BY sample_id),
    e AS (SELECT sample_id, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM (SELECT sample_id, greatest(1, ceil(confidence * 10)) AS bin,
        count(*) AS n, avg(CASE WHEN nullif(pruned, '') = truth THEN 1 ELSE 0 END) AS acc, avg(confidence) AS conf FROM st GROUP BY 1, 2) GROUP BY sample_id),
    u AS (SELECT sample_id, round(avg(CASE WHEN status = 'Uncertain' THEN 1 ELSE 0 END), 6) AS unc FROM st GROUP BY sample_id),
    f AS (SELECT sample_id AS dataset_id, CASE WHEN ba < 0.1 THEN 'balanced_accuracy fails' END AS a, CASE WHEN f1 < 0.09 THEN 'macro_f1 fails' END AS b,
      CASE WHEN ece > 0.4 THEN 'ece fails' END AS c, CASE WHEN unc > 0.6 THEN 'uncertain_fraction fails' END AS d, 'shared_genes is missing' AS e
      FROM m JOIN e USING (sample_id) JOIN u USING (sample_id))
    SELECT dataset_id, concat_ws('; ', a, c, b, e, d) AS failures,
      CAST((a IS NOT NULL) AS BIGINT) + CAST((b IS NOT NULL) AS BIGINT) + CAST((c IS NOT NULL) AS BIGINT) + CAST((d IS NOT NULL) AS BIGINT) + 1 AS n_failures FROM f""",
)
def _(spark, d):
    rows = _predictions(spark, d).withColumn("predicted", F.nullif(F.col("pruned_label"), F.lit("")))
    groups = ["sample_id"]
    correct = F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False))
    wide = (
        K.classification_metrics(rows, "truth", "predicted", groups)
        .join(K.expected_calibration_error(rows, correct, "confidence", groups), groups)
        .join(K.status_fractions(rows, groups), groups)
    )
    names = ("balanced_accuracy", "macro_f1", "ece", "uncertain_fraction")
    metrics = wide.select(
        F.col("sample_id").alias("dataset_id"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.round(n, 6).alias("value")) for n in names])).alias("m"),
    ).select("dataset_id", "m.name", "m.value")
    gates = (
        rows.select(F.col("sample_id").alias("dataset_id"))
        .distinct()
        .select(
            "dataset_id",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(t).alias("threshold"))
                        for n, k, t in _GATES
                    ]
                )
            ).alias("g"),
        )
        .select("dataset_id", "g.name", "g.kind", "g.threshold")
    )
    return K.qc_failures(metrics, gates)
