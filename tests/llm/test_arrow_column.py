import weakref

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tabtwin.llm.common import with_arrow_column

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def doubling():
    return lambda texts, *_: pa.array([None if t is None else t + t for t in texts.to_pylist()], pa.string())


def test_a_source_that_stays_goes_to_python_once(spark):
    """The packed row leaves the sources out; order, names, types and rows of the result are as ever."""
    rows = [(1, "a", [1, None], "p"), (None, None, None, "q"), (1, "a", [1, None], "p"), (2, "", [], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, `odd.name` string")
    out = with_arrow_column(df, "twice", "string", ["text", "ids"], True, doubling())
    packed = plan(out).split("AS row#")[0]
    assert "text#" not in packed.split("struct(")[-1] and "ids#" not in packed.split("struct(")[-1]
    assert out.columns == ["doc_id", "text", "ids", "odd.name", "twice"] and out.schema["ids"].dataType == df.schema["ids"].dataType
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(*r, None if r[1] is None else r[1] * 2) for r in rows], key=str)
    gone = with_arrow_column(df, "twice", "string", "text", False, doubling())
    assert gone.columns == ["doc_id", "ids", "odd.name", "twice"] and gone.count() == 4
    same = with_arrow_column(df, "text", "string", "text", True, doubling())
    assert same.columns == ["doc_id", "ids", "odd.name", "text"] and {r.text for r in same.collect()} == {"aa", None, ""}
    assert with_arrow_column(df.limit(0), "twice", "string", "text", True, doubling()).count() == 0


def test_a_batch_is_let_go_before_the_next_is_read(spark):
    class Frame:
        columns = ["text"]

        def __init__(self, df):
            self.df = df

        def select(self, *columns):
            inner = self.df.select(*columns)
            taken = type("Inner", (), {"schema": inner.schema, "mapInArrow": lambda _, run, kind: (found.append(run), inner)[1].select("*", F.lit(None).alias("value"))})
            return taken()

    found, held = [], []
    with_arrow_column(Frame(spark.createDataFrame([("a",)], "text string")), "twice", "string", "text", True, doubling())

    def batches():
        for n in (3, 0, 2):
            batch = pa.RecordBatch.from_arrays([pa.array([{"_": 0}] * n, pa.struct([("_", pa.int32())])), pa.array(["ab"] * n, pa.string())], names=["row", "source0"])
            held.append(weakref.ref(batch))
            yield batch
            del batch
            assert held[-1]() is None

    assert sum(rows for rows in map(lambda made: made.num_rows, found[0](batches()))) == 5 and len(held) == 3


def test_encoding_and_decoding_are_not_in_one_task(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.tokenize(spark, docs, DATA)
    assert plan(out).count("MapInArrow") == 1
    assert out.count() == docs.count()
