"""Language, quality and toxicity: accuracy outside the training rows, and the defined cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiltomics.llm import queries
from quiltomics.llm.common import held_out, table
from quiltomics.llm.language import fit_languages, identify, profiles
from quiltomics.llm.linear import hinge_machine, logistic_fit
from quiltomics.llm.quality import chain_marginals, fit_chain, fit_quality, score_quality
from quiltomics.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity

FOLDER = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "12 34 !?"), (5, "the and of " * 20_000), (5, "the and of " * 20_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, FOLDER, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, FOLDER, "labels")


def odd(spark, column):
    return spark.createDataFrame([(i, t, 0.5) for i, t in ODD], f"doc_id long, text string, `{column}` double")


def truth(query, spark, labels, name):
    rows = query(spark, FOLDER)
    assert rows.where("score is null or score < 0 or score > 1").count() == 0
    return rows.where("held_out").join(labels.select("doc_id", name), "doc_id")


def test_language(spark, docs):
    rows = queries.QUERIES["op10_language_id"](spark, FOLDER)
    assert rows.count() == docs.count()
    right = rows.where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert right.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert rows.where(F.col("held_out") != held_out()).count() == 0


def test_language_cases(spark, docs):
    model = fit_languages(docs)
    found = identify(odd(spark, "score"), model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score"]
    by_text = {(r.doc_id, r.lang_pred) for r in found.collect()}
    assert by_text == {(1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "en")}
    nothing = fit_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in identify(odd(spark, "x"), nothing).collect()} == {("und", 0.0)}
    assert identify(odd(spark, "x").limit(0), model).count() == 0
    # A text with any letter gets a language, however short it is.
    short = spark.createDataFrame([(1, "a"), (2, "7 é!"), (3, "日")], "doc_id long, text string")
    assert identify(short, model).where("lang_pred = 'und'").count() == 0
    one = fit_languages(docs.where("lang = 'fr'"))
    assert identify(docs.limit(5), one).where("lang_pred <> 'fr'").count() == 0


def test_profiles_ignore_case_and_marks():
    rows = profiles(pa.array(["Grüße, Welt!!", "grüße welt ", None, "12"]))
    assert np.allclose(rows[0], rows[1], atol=1e-3) and not rows[2].any()


def test_quality(spark, labels):
    rows = truth(queries.QUERIES["op8_quality"], spark, labels, "quality")
    right = rows.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a")).collect()
    assert all(r.a > 0.97 for r in right) and len(right) == 2


def test_quality_cases(spark, docs, labels):
    model = fit_quality(docs, labels)
    found = score_quality(odd(spark, "quality_score"), model)
    assert found.columns == ["doc_id", "text", "quality_score"]
    scores = [(r.doc_id, r.quality_score) for r in found.collect()]
    assert all(0 <= s <= 1 for _, s in scores) and len({s for i, s in scores if i in (1, 2, 3)}) == 1
    assert len({s for i, s in scores if i == 5}) == 1
    assert score_quality(odd(spark, "x").limit(0), model).count() == 0
    unknown = fit_quality(docs, labels.withColumn("quality", F.lit(None).cast("int")))
    assert {r.quality_score for r in score_quality(odd(spark, "x"), unknown).collect()} == {1.0}


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    bounds, scores, steps = np.array([0, 4, 5, 8]), rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, total = chain_marginals(scores, bounds, steps)
    inner = 0
    for a, b, z in zip(bounds[:-1], bounds[1:], total):
        paths = [[(n >> i) & 1 for i in range(b - a)] for n in range(1 << (b - a))]
        logs = np.array([sum(scores[a + i] * s for i, s in enumerate(p)) + sum(steps[x, y] for x, y in zip(p, p[1:])) for p in paths])
        share = np.exp(logs - np.log(np.exp(logs).sum()))
        assert np.isclose(z, np.log(np.exp(logs).sum()))
        for i in range(b - a):
            assert np.isclose(good[a + i], sum(w for w, p in zip(share, paths) if p[i]))
        for i in range(b - a - 1):
            for x in (0, 1):
                for y in (0, 1):
                    assert np.isclose(pairs[inner, x, y], sum(w for w, p in zip(share, paths) if (p[i], p[i + 1]) == (x, y)))
            inner += 1


def test_neighbours_matter():
    """A plain line between shouting ones is worse than the same line between plain ones."""
    good, bad = "some calm words stand here", "LOUD!! WORDS!! ARE!! HERE!!"
    texts = [f"{good} {i}\n{good} x\n{good}" for i in range(40)] + [f"{bad}\n{good}\n{bad} {i}" for i in range(40)]
    model = fit_chain(texts, np.array([1] * 40 + [0] * 40))
    plain, mixed = model.scores(["\n".join([good] * 3), "\n".join([bad, good, bad])])
    assert plain > 0.5 > mixed


def test_toxicity(spark, labels):
    rows = truth(queries.QUERIES["op2_toxicity"], spark, labels, "toxic")
    right = rows.groupBy("toxic").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("a")).collect()
    assert all(r.a > 0.9 for r in right) and len(right) == 2


def test_toxicity_cases(spark, docs, labels):
    model = fit_toxicity(docs, labels)
    found = score_toxicity(odd(spark, "toxicity_score"), model)
    assert found.columns == ["doc_id", "text", "toxicity_score", "strongest_clause"]
    assert len({r.toxicity_score for r in found.collect() if r.doc_id < 5}) == 1
    assert score_toxicity(odd(spark, "x").limit(0), model).count() == 0
    unknown = fit_toxicity(docs, labels.withColumn("toxic", F.lit(None).cast("int")))
    assert unknown.score("you are an idiot, you idiot. you moron. what a stupid idiot you are.") > 0.5 > unknown.score("a fine day")


def test_grammar_scores_clauses():
    model = ToxicityModel({"idiot": 4.0, "kill": 4.0}, {"vequ": 2.0}, np.array([1.0, 0, 0, 0]))
    plain = model.clauses("what an idiot")
    assert plain == [4.0]
    assert model.clauses("you are an idiot") == [6.0] == model.clauses("idiot are you")
    assert model.clauses("he is not an idiot")[0] < 6.0 and model.clauses("no idiot here")[0] < plain[0]
    assert model.clauses("somebody said what an idiot")[0] < plain[0]
    assert model.clauses('"what an idiot" it was')[0] < plain[0]
    assert model.clauses("they kill you. fine words. an idiot")[0] == 6.0 and len(model.clauses("they kill you. an idiot")) == 2
    assert model.clauses("le vequmo est") == [2.0] and model.clauses("") == [] and model.clauses("veq") == []


def test_machines():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(400, 3))
    signs = np.where(points @ [1, -2, 0.5] > 0.3, 1.0, -1.0)
    weights, bias = hinge_machine(points, signs)
    assert ((points @ weights + bias > 0) == (signs > 0)).mean() > 0.95
    fitted = logistic_fit(points, (signs > 0).astype(float))
    assert ((points @ fitted[:-1] + fitted[-1] > 0) == (signs > 0)).mean() > 0.95
