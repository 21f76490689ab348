"""Exact ordering under ties and hot groups, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quiltomics.operators import ordering as O


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 4000
    # One group holds most rows and one value most of that group.
    group = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.4, 5, rng.integers(0, 300, n))
    pdf = pd.DataFrame({"g": group, "v": value, "id": rng.permutation(n)})
    return spark.createDataFrame(pdf).repartition(7), pdf


def test_numbered(skewed):
    df, pdf = skewed
    got = O.numbered(df, [F.col("v"), F.col("id")], ["g"]).toPandas().set_index("id")["ordinal"]
    want = pdf.sort_values(["v", "id"]).groupby("g").cumcount()
    want.index = pdf.loc[want.index, "id"]
    assert (got.sort_index() == want.sort_index()).all()


def test_running_totals(skewed):
    df, pdf = skewed
    hist = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = O.running_totals(hist, [F.col("v")], ["n"], ["g"]).toPandas().sort_values(["g", "v"])
    counts = pdf.groupby(["g", "v"]).size().reset_index(name="n")
    before = counts.groupby("g")["n"].cumsum() - counts["n"]
    assert got["before_n"].tolist() == before.tolist()


def test_average_ranks(skewed):
    df, pdf = skewed
    got = O.value_ranks(df, "v", ["g"]).toPandas().set_index(["g", "v"])["avg_rank"]
    pdf = pdf.assign(r=pdf.groupby("g")["v"].rank())
    want = pdf.groupby(["g", "v"])["r"].first()
    assert (got.sort_index() == want.sort_index()).all()


def test_quantiles(skewed):
    df, pdf = skewed
    fractions = {"low": 0.013, "mid": 0.5, "high": 0.977}
    got = O.linear_quantiles(df, "v", fractions, ["g"]).toPandas().set_index(["g", "name"])["value"]
    for (group, name), value in got.items():
        assert value == pytest.approx(pdf.loc[pdf.g == group, "v"].quantile(fractions[name]))
    near = O.nearest_quantiles(df, "v", fractions, ["g"]).toPandas().set_index(["g", "name"])["value"]
    for (group, name), value in near.items():
        ordered = sorted(pdf.loc[pdf.g == group, "v"])
        assert value == ordered[round(fractions[name] * (len(ordered) - 1))]


def test_hash_rank(skewed):
    df, pdf = skewed
    hashed = df.withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    got = O.rank_by_hash(hashed, "h", ["g"]).toPandas()
    want = got.sort_values("h").groupby("g").cumcount() + 1
    assert (got.loc[want.index, "rank"] == want).all()
    few = O.smallest_by_hash(hashed, "h", ["g"], F.lit(25)).groupBy("g").count().toPandas()
    assert (few["count"] == 25).all()


def test_top_n(skewed):
    df, pdf = skewed
    got = O.top_n(df, ["g"], [F.desc("v"), F.asc("id")], 5).toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("g").head(5)
    assert set(got["id"]) == set(want["id"])
