import importlib

import pyarrow  # noqa: F401
import pytest

from quiltomics.llm.common import table
from quiltomics.llm.decontam import contaminated
from quiltomics.llm.language import fit_languages, identify
from quiltomics.llm.minhash import near_duplicates
from quiltomics.llm.quality import fit_quality, score_quality
from quiltomics.session import settled

FOLDER = "/root/testdata/sf0.01"
pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def outputs(spark):
    docs, found = table(spark, FOLDER, "documents"), []
    for name, stage in pipeline.STAGES:
        docs = settled(stage(spark, docs, FOLDER), name)
        found.append(docs)
    return found


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_every_stage_decides_on_what_is_left(spark, outputs):
    docs = table(spark, FOLDER, "documents")
    language, quality, dedup, clean, packed = outputs
    for part in (language, quality, dedup, clean):
        assert part.columns == docs.columns
    found = identify(docs, fit_languages(docs)).where("lang_pred <> 'und' and score >= 0.2")
    assert ids(language) == ids(found)
    labels, benchmark = table(spark, FOLDER, "labels"), table(spark, FOLDER, "benchmark")
    assert ids(quality) == ids(score_quality(language, fit_quality(language, labels)).where("quality_score >= 0.3"))
    assert ids(dedup) == ids(near_duplicates(quality).where("kept"))
    leaks = {r.doc_id for r in contaminated(dedup, benchmark).collect()}
    assert leaks and ids(clean) == [i for i in ids(dedup) if i not in leaks]
    assert sorted(set(ids(packed))) == ids(clean)


def test_run_gives_the_last_stage(spark, outputs):
    def rows(df):
        return sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32").collect())

    assert rows(pipeline.run(spark, FOLDER)) == rows(outputs[-1])


def test_stages_keep_other_columns_and_empty_tables(spark):
    docs = table(spark, FOLDER, "documents").selectExpr("*", "1 AS score", "'x' AS kept", "2 AS quality_score", "'y' AS lang_pred",
        "3 AS _language", "4 AS _certainty", "5 AS _quality", "6 AS _mark", "7 AS _text")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), FOLDER).count() == 0


UNKNOWN = [
    "Девочка пошла на рынок, чтобы купить хлеб, а потом вернулась домой.",
    "少女はパンを買うために市場に行きました。",
    "Το κορίτσι πήγε στην αγορά για να αγοράσει ψωμί.",
    "xqzjv kwpfh zzkqj vbnmq wxcrt plkjh qwzxv bvcnm",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
]
# Rejected where no such text was learned from: they share many 3-grams with the learned languages.
RELATED = [
    "Dziewczyna poszła na targ kupić chleb, a potem wróciła do domu z przyjaciółmi.",
    "Tyttö meni torille ostamaan leipää ja palasi sitten kotiin ystäviensä kanssa.",
]


@pytest.mark.parametrize("lang, texts", [(None, UNKNOWN + RELATED), ("en", UNKNOWN)])
def test_language_stage_rejects_unknown_texts(spark, lang, texts):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text", "lang")
    odd = [(-1 - i, text, lang) for i, text in enumerate([*texts, "123 !?", None])]
    mixed = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    assert ids(pipeline.language_stage(spark, mixed, FOLDER)) == ids(docs)
