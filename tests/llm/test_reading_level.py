import numpy as np

from tallyforge.llm.boosted_trees import BoostedTrees
from tallyforge.llm.reading_level import reading_levels, sentences, train, train_on

D = "/root/testdata/sf0.01"


def test_held_out_sources(spark):
    model = train_on(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/reading_labels.parquet"))
    assert model.exact >= 0.8 and model.within_one >= 0.98


def test_one_row_a_document(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/reading_labels.parquet")
    extra = [(900_001, None, "s"), (900_002, "", "s"), (900_003, " \n ", None), (900_004, "Wir gehen heim. " * 5000, "s"), (900_004, "Wir gehen heim. " * 5000, "s")]
    few = docs.select("doc_id", "text", "source").limit(200)
    df = few.unionAll(spark.createDataFrame(extra, few.schema)).selectExpr("*", "'clash' AS reading_level")
    # the labels point at documents beyond the first 200 too
    got = {}
    for r in reading_levels(df, labels.unionAll(labels)).collect():
        got.setdefault(r.doc_id, []).append(r.reading_level)
    assert len(got) == few.select("doc_id").distinct().count() + 4
    assert got[900_001] == got[900_002] == got[900_003] == [0] and len(got[900_004]) == 2
    assert all(0 <= x <= 4 for levels in got.values() for x in levels)


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "A text.", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, reading_level int")
    assert [tuple(r) for r in reading_levels(docs, labels).collect()] == [(1, 0)]
    assert reading_levels(docs.limit(0), labels).collect() == []


def test_bound_on_labels():
    texts = [f"Short text {i}. It is read." for i in range(10)] + ["Notwithstanding multilateral considerations, reconciliation presupposes operationalisation."] * 10
    model = train(texts, [1] * 10 + [4] * 10, ["a", "b"] * 10)
    assert model.grade("Short text 3. It is read.") == 1
    assert model.grade("Multilateral reconciliation presupposes considerations notwithstanding operationalisation.") == 4


def test_sentences():
    assert sentences("<p>Come in! It is <b>late</b>.</p>\n12 x") == [["Come", "in"], ["It", "is", "late"], ["12", "x"]]


def test_trees_fit_a_step():
    x = np.linspace(0, 1, 200)[:, None]
    y = (x[:, 0] > 0.5) * 3.0
    assert abs(BoostedTrees().fit(x, y).predict(x) - y).mean() < 0.05
