"""What tasks leave in their Python workers, which outlive them and count beside an executor's heap."""

import random
import tracemalloc

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from quiltomics.llm import common
from quiltomics.llm.language import BUCKETS, LanguageModel, fit_languages, identify
from quiltomics.llm.linear import bounded_sample
from quiltomics.llm.packing import token_pieces


class Caught:
    """Stands for a DataFrame and catches the function that its tasks would run."""

    def __init__(self, df):
        self.columns, self.schema = df.columns, df.schema

    def drop(self, *names):
        return self

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_tasks_let_go_of_what_others_kept(spark):
    docs = spark.createDataFrame([(1, "a word or two")], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a word or two"]})
    pack = token_pieces(Caught(docs), path)
    assert [r.num_rows for r in pack(iter([rows]))] == [1]
    first = common._KEPT[path]
    list(pack(iter([rows])))
    assert common._KEPT[path] is first
    assert [r.num_rows for r in identify(Caught(docs), LanguageModel([]))(iter([rows]))] == [1]
    assert not common._KEPT


def test_workers_let_go_too(spark):
    """The same in Spark's workers, whose functions arrive by value."""
    path = public_tokenizers.path("word_bpe_49k.json")
    one = spark.range(1).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("a word or two").alias("text"))

    def count(batches):
        held = __import__("quiltomics.llm.common", fromlist=["_KEPT"])._KEPT
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"held": pa.array([len(held)], pa.int64())})

    assert token_pieces(one, path).count() == 1
    assert one.mapInArrow(common.tidy(count), "held long").collect()[0].held == 0


def test_language_profiles_of_a_batch_are_made_in_slices(spark):
    docs = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    draw = random.Random(5)
    texts = ["".join(draw.choices("abcdefghij ", k=400)) for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": texts, "lang": ["en"] * 1000})
    run = identify(Caught(docs), LanguageModel(["en"], {"germanic": ["en"]}))
    list(run(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    assert sum(r.num_rows for r in run(iter([batch]))) == 1000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The table of known 3-grams (1 << 24 bytes), and less than 512 profiles and one copy of them.
    assert most < (1 << 24) + 512 * BUCKETS * 4 * 2


def test_rates_of_a_sample_need_no_python_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en" if i % 2 else "de", 0) for i in range(40)], "doc_id long, text string, lang string, _rate int")
    whole = bounded_sample(spark.range(40).selectExpr("concat('text ', id) AS text", "if(id % 2 = 1, 'en', 'de') AS lang"), "lang", "text", 100)
    assert whole.count() == 40 and "ExistingRDD" not in whole._jdf.queryExecution().toString()
    assert bounded_sample(docs, "lang", "text", 100).count() == 40
    nothing = bounded_sample(docs.where("false"), "lang", "text", 100)
    assert nothing.count() == 0 and nothing.columns == ["lang", "doc_id", "text", "_rate"]
    assert fit_languages(docs.where("false")).languages == []
