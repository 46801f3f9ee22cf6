from pyspark.sql import functions as F

from ledgerloom.operators import screening
from ledgerloom.plans import documents

SF = "/root/testdata/sf0.001"


def test_signs_of_odd_texts(spark):
    many = " ".join(f"w{i}" for i in range(11))
    rows = [(1, "", "", ""), (2, None, many, None), (3, "ERROR: x", "a note", many), (4, many, "", "w1"), (5, "a", many, "a"), (6, "a", "a", many)]
    df = spark.createDataFrame(rows, "id int, n string, l string, o string").select("id", screening.hidden_issues(F.col("n"), F.col("l"), F.col("o")).alias("x"))
    found = {r.id: set(r.x) for r in df.collect()}
    assert found[1] == set() and found[2] == {"more in layout"} and found[3] == {"more in layout", "annotation", "only recognised"}
    assert found[4] == {"more words native"} and found[5] == {"methods differ", "more in layout", "only layout"}
    assert found[6] == {"more recognised", "only recognised", "more words recognised"}


def test_parts_grow_with_the_input_and_hold_no_texts(spark):
    for query in (documents.hidden, documents.similarity):
        plan = query(spark, SF)._jdf.queryExecution().toString()
        assert "RepartitionByExpression" in plan
        joined = plan[plan.index("== Optimized Logical Plan ==") : plan.index("== Physical Plan ==")]
        assert all("text#" not in line for line in joined.splitlines() if "Join" in line)
