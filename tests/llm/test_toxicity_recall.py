"""Held-out figures of the toxicity model, at the threshold that the query uses."""

from pyspark.sql import functions as F

from saldo.llm import queries, toxicity


def test_held_out_recall_and_false_positives(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    met = queries.op2_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r.n for r in met.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    caught, missed, wrong, clean = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0), n.get((0, 0), 0)
    # Some toxic labels stand on texts without any word that speaks for them, so not all can be found.
    assert caught >= 0.88 * (caught + missed) and wrong <= 0.005 * (wrong + clean), n


def test_labels_of_one_kind_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "fine text"), (2, ""), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert all(r.score < 1e-8 and r.predicted == 0 for r in toxicity.scored(docs, labels).collect())


def test_a_very_long_text(spark):
    """One strong word in a text of ten megabytes is read; memory holds distinct words only."""
    docs = spark.createDataFrame([(i, f"plain words {i} here" + (" vileness vilest" if i % 2 else "")) for i in range(400)] + [(1000, "plain here " * 1_000_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    out = {r.doc_id: r.predicted for r in toxicity.scored(docs, labels).collect()}
    assert out[1000] == 0 and sum(out[i] for i in range(1, 400, 2)) > 190 and not any(out[i] for i in range(0, 400, 2))
