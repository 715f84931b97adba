from pyspark.sql import functions as F

from inkstone.plans.queries import QUERIES


def test_pages_travel_as_texts(spark, tmp_path):
    """The one shuffle has a row for each page, not one for each object; null, empty and spaced texts as before."""
    rows = [(1, " ".join("w%d" % (i % 90) for i in range(1000))), (2, None), (3, ""), (4, " a  b "), (5, "x " * 40), (6, "x " * 39 + "y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["overlay_filter"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    assert plan.index("Generate posexplode(split(") < plan.index("RepartitionByExpression") < plan.rindex("Generate posexplode(")  # from the last step to the first
    shown = {(r.doc_id, r.obj_no): (r.page_no, r.raw) for r in got.collect()}
    assert {k: v for k, v in shown.items() if k[0] in (3, 4)} == {(3, 0): (1, "BACKUP COPY"), (4, 0): (1, "BACKUP COPY"), (4, 1): (1, "a"), (4, 3): (1, "BACKUP COPY")}
    assert {(k[1], v[0]) for k, v in shown.items() if k[0] in (5, 6) and k[1] >= 39} == {(39, 1)}
    assert max(r.page_no for r in got.where(F.col("doc_id") == 1).collect()) == 25
