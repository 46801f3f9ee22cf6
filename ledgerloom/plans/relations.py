"""Queries with joins, set operations, numbering and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import dedupe as D
from ledgerloom.operators import joins as J
from ledgerloom.plans.tables import table

NAME = "CASE {k} % 3 WHEN 0 THEN lower(c_name) || ' ' WHEN 1 THEN replace(c_name, '#', '_') ELSE c_name END"


def files(s, d):
    """Orders as files: named after their customer, some with other spelling, some of an unknown agreement."""
    orders, customers = table(s, d, "orders"), table(s, d, "customer")
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lower("c_name"), F.lit(" "))).when(k % 3 == 1, F.replace("c_name", F.lit("#"), F.lit("_"))).otherwise(F.col("c_name"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(k.alias("file_id"), name.alias("name"), (F.col("c_nationkey") + (k % 7 == 0).cast("int") * 100).alias("nation"))


def info(s, d):
    """Customers as known periods; every name comes twice, with another id and date."""
    c = table(s, d, "customer")
    rows = c.select("c_name", "c_nationkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), "c_custkey")
    return rows.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") * 10 + F.col("n")).alias("id"), F.concat(F.lit("2020-01-0"), F.col("n")).alias("start"), (F.col("c_custkey") * 10 + F.col("n")).alias("position"))


INFO_JOIN = """WITH f AS (SELECT o_orderkey AS file_id, CASE o_orderkey % 3 WHEN 0 THEN lower(c_name) || ' ' WHEN 1 THEN replace(c_name, '#', '_') ELSE c_name END AS name, c_custkey AS c, o_orderkey % 7 = 0 AS odd,
 c_nationkey + CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE 0 END AS nation FROM orders JOIN customer ON o_custkey = c_custkey),
i AS (SELECT c_name AS name, c_nationkey AS nation, c_custkey * 10 AS id FROM customer)
SELECT file_id, f.name, f.nation, CASE WHEN e.id IS NOT NULL THEN e.id + 2 ELSE (SELECT min(x.id) + 1 FROM i x WHERE x.nation = f.nation AND replace(replace(replace(lower(x.name), ' ', ''), '_', ''), '-', '') = replace(replace(replace(lower(f.name), ' ', ''), '_', ''), '-', '')) END AS id,
 CASE WHEN e.id IS NOT NULL THEN '2020-01-02' END AS start FROM f LEFT JOIN i e ON e.name = f.name AND e.nation = f.nation"""


def info_join(s, d):
    return J.with_info(files(s, d), info(s, d), "name", "nation", "id", ["start"], "position")


def old_and_new(s, d):
    orders = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("o_custkey"), "o_totalprice")
    return orders.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 3 <> 2").withColumn("extra", F.lit("x"))


def append_new(s, d):
    """Old rows and those new ones whose customer is not there yet."""
    old, new = old_and_new(s, d)
    fresh = J.new_rows(new, old.where("o_custkey % 2 = 0"), ["o_custkey"])
    return old.unionByName(fresh, allowMissingColumns=True)


def union_first(s, d):
    """Both lists one behind another; of each customer the first row stays."""
    old, new = old_and_new(s, d)
    both = old.withColumn("part", F.lit(0)).unionByName(new.drop("extra").withColumn("part", F.lit(1)))
    return D.first_seen(both.where("o_custkey is not null").withColumn("position", F.struct("part", "o_orderkey")), ["o_custkey"], "position").drop("position")


def key_sets(s, d):
    """Customers and months in both lists, and those in one only."""
    months = table(s, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("month"))
    old, new = (x.where("o_custkey is not null").join(months, "o_orderkey").select("o_custkey", "month") for x in old_and_new(s, d))
    both = old.intersect(new).withColumn("side", F.lit("both"))
    return both.unionByName(J.both_ways(old, new, ["o_custkey", "month"]))


def listed_names(s, d):
    listing = table(s, d, "supplier").select(F.concat(F.lit("  "), F.upper("s_name")).alias("n"))
    parts = table(s, d, "lineitem").select("l_suppkey").distinct().join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    listed = J.listed(parts.select("s_suppkey", "s_name"), listing.where(F.length("n") > 3), "s_name", "n")
    return J.kept_if(listed.withColumn("flag", F.col("s_suppkey") % 2 == 0), F.col("flag"), F.col("s_suppkey") % 3 == 0)


def inventories(s, d):
    docs, labels = table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id")
    bench = table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return J.reconciled({"documents": docs, "labels": labels, "benchmark": bench}, [("documents", "labels"), ("labels", "documents"), ("benchmark", "labels"), ("labels", "benchmark"), ("benchmark", "documents")], ["doc_id"])


def field_differences(s, d):
    """Lines of even and of odd orders as two tables of the same parts."""
    rows = table(s, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("quantity"), "l_orderkey")
    fields = ["l_returnflag", "l_linestatus", "line", "quantity"]
    return J.field_differences(rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1"), ["l_partkey"], fields)


def unmatched_parts(s, d):
    """Parts with lines of even orders and none of odd ones."""
    rows = table(s, d, "lineitem").select("l_partkey", "l_linenumber", "l_orderkey")
    return J.unmatched(rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1"), ["l_partkey", "l_linenumber"])


def contract_dates(s, d):
    """Wages get the last non-empty date of their order's other lines."""
    lines = table(s, d, "lineitem")
    date = F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).when(F.col("l_linenumber") == 3, "")
    place = F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice")
    others = lines.select("l_orderkey", place.alias("place"), date.alias("start_date"))
    items = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return J.propagated(items, others, "l_orderkey", "place", ["start_date"])


def sequence(s, d):
    old, new = old_and_new(s, d)
    numbered = old.withColumn("n", (F.col("o_orderkey") % 1200).cast("int"))
    return D.sequence_ids(new.where("o_custkey is not null").drop("extra"), numbered, "o_custkey", "n", "o_orderkey", "id")


def unique_names(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("name"))
    return D.unique_names(rows, ["o_custkey"], "name", "o_orderkey", "unique_name")


def workers(s, d):
    return D.assigned(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 7)


def shuffled(s, d):
    """A seeded order, and the work of one of two processes in it."""
    rows = D.shuffled(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 43).withColumn("at", D.shuffle_key("o_orderkey", 43))
    return D.assigned(rows, ["at", "o_orderkey"], 2).select("o_orderkey", "worker")


def limited(s, d):
    """The first 10 orders that are not done yet; done ones do not count."""
    orders = table(s, d, "orders").select("o_orderkey", "o_totalprice")
    return J.new_rows(orders, orders.where("o_orderkey % 3 = 0"), ["o_orderkey"]).orderBy("o_orderkey").limit(10)


def paired_files(s, d):
    """Parts with the candidate file of their stem, the first wanted suffix winning."""
    parts = table(s, d, "part").select("p_partkey", F.col("p_name").alias("stem"))
    found = table(s, d, "part").select(F.col("p_name").alias("stem"), F.explode(F.when(F.col("p_size") > 25, F.array(F.lit("PDF"), F.lit("pdf"))).when(F.col("p_size") > 10, F.array(F.lit("PDF"))).otherwise(F.array(F.lit("txt")))).alias("suffix"))
    return J.preferred(parts, found, "stem", "suffix", ["pdf", "PDF"])


def numeric_order(s, d):
    """Flagged keys as numbers, in order of their value."""
    rows = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.when(F.col("c_acctbal") > 0, "Yes").otherwise("No").alias("needed"))
    return rows.where("needed = 'Yes'").select(F.col("k").try_cast("int").alias("k")).dropna().orderBy("k")


QUERIES = {"info_join": info_join, "append_new_rows": append_new, "union_first_wins": union_first, "key_sets": key_sets, "listed_names": listed_names, "inventory_checks": inventories, "field_differences": field_differences, "unmatched_parts": unmatched_parts, "contract_dates": contract_dates, "sequence_ids": sequence, "unique_names": unique_names, "worker_split": workers, "shuffled_split": shuffled, "limit_after_skip": limited, "paired_files": paired_files, "numeric_keys": numeric_order}

OLD = "o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS o_custkey, o_totalprice FROM orders), old AS (SELECT * FROM o WHERE o_orderkey % 3 <> 0), new AS (SELECT * FROM o WHERE o_orderkey % 3 <> 2)"
FIELD = " UNION ALL ".join(f"SELECT l_partkey, l_orderkey % 2 AS side, '{name}' AS field, CAST({e} AS VARCHAR) AS v FROM lineitem" for name, e in (("l_returnflag", "l_returnflag"), ("l_linestatus", "l_linestatus"), ("line", "l_linenumber"), ("quantity", "CAST(trunc(l_quantity) AS INTEGER)")))
ORACLES = {
    "info_join": INFO_JOIN,
    "append_new_rows": f"WITH {OLD} SELECT *, NULL::VARCHAR AS extra FROM old UNION ALL SELECT *, 'x' FROM new WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT o_custkey FROM old WHERE o_custkey % 2 = 0)",
    "union_first_wins": f"WITH {OLD}, b AS (SELECT *, 0 AS part FROM old UNION ALL SELECT *, 1 FROM new) SELECT DISTINCT ON (o_custkey) * FROM b WHERE o_custkey IS NOT NULL ORDER BY o_custkey, part, o_orderkey",
    "key_sets": f"""WITH {OLD}, m AS (SELECT o_orderkey, month(o_orderdate) AS month FROM orders), a AS (SELECT DISTINCT o_custkey, month FROM old JOIN m USING (o_orderkey) WHERE o_custkey IS NOT NULL), b AS (SELECT DISTINCT o_custkey, month FROM new JOIN m USING (o_orderkey) WHERE o_custkey IS NOT NULL)
 SELECT o_custkey, month, CASE WHEN a.x AND b.x THEN 'both' WHEN a.x THEN 'left' ELSE 'right' END AS side FROM (SELECT *, true AS x FROM a) a FULL JOIN (SELECT *, true AS x FROM b) b USING (o_custkey, month)""",
    "listed_names": "SELECT s_suppkey, s_name, s_suppkey % 2 = 0 AS flag FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem) AND (s_suppkey % 2 <> 0 OR s_suppkey % 3 = 0)",
    "inventory_checks": " UNION ALL ".join(f"SELECT doc_id, '{a} not in {b}' AS check FROM (SELECT {ia} AS doc_id FROM {a} EXCEPT SELECT {ib} FROM {b})" for a, ia, b, ib in (("documents", "doc_id", "labels", "doc_id"), ("labels", "doc_id", "documents", "doc_id"), ("benchmark", "item_id", "labels", "doc_id"), ("labels", "doc_id", "benchmark", "item_id"), ("benchmark", "item_id", "documents", "doc_id"))),
    "field_differences": f"""WITH v AS (SELECT DISTINCT * FROM ({FIELD})), k AS (SELECT l_partkey, field FROM v GROUP BY 1, 2 HAVING count(DISTINCT side) = 2), x AS (SELECT l_partkey, field, v, min(side) AS side FROM v GROUP BY 1, 2, 3 HAVING count(*) = 1)
 SELECT l_partkey, field, coalesce(list(v ORDER BY v) FILTER (side = 0), []) AS only_left, coalesce(list(v ORDER BY v) FILTER (side = 1), []) AS only_right FROM x JOIN k USING (l_partkey, field) GROUP BY 1, 2""",
    "unmatched_parts": "SELECT DISTINCT l_partkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0 AND (l_partkey, l_linenumber) NOT IN (SELECT (l_partkey, l_linenumber) FROM lineitem WHERE l_orderkey % 2 = 1)",
    "shuffled_split": "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY md5(o_orderkey || ':43'), o_orderkey) - 1) % 2 AS INTEGER) AS worker FROM orders",
    "contract_dates": """WITH x AS (SELECT l_orderkey, l_linenumber AS n, l_shipdate, l_partkey, l_extendedprice FROM lineitem WHERE l_linenumber % 2 = 0)
 SELECT o_orderkey AS l_orderkey, o_totalprice, (SELECT strftime(l_shipdate, '%Y-%m-%d') FROM x WHERE x.l_orderkey = o_orderkey ORDER BY n DESC, l_shipdate DESC, l_partkey DESC, l_extendedprice DESC LIMIT 1) AS start_date FROM orders""",
    "sequence_ids": f"""WITH {OLD}, t AS (SELECT o_custkey, max(o_orderkey % 1200) AS top FROM old GROUP BY 1), n AS (SELECT new.*, coalesce(top, 0) + (SELECT count(*) FROM new y WHERE y.o_custkey = new.o_custkey AND y.o_orderkey <= new.o_orderkey) AS n FROM new LEFT JOIN t USING (o_custkey) WHERE o_custkey IS NOT NULL)
 SELECT o_orderkey, o_custkey, o_totalprice, o_custkey || CASE WHEN n > 999 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 3, '0') END AS id FROM n""",
    "unique_names": """SELECT o_orderkey, o_custkey, o_orderpriority AS name, o_orderpriority || coalesce((SELECT '_' || nullif(count(*), 0) FROM orders y WHERE y.o_custkey = x.o_custkey AND y.o_orderpriority = x.o_orderpriority AND y.o_orderkey < x.o_orderkey), '') AS unique_name FROM orders x""",
    "worker_split": "SELECT o_orderkey, o_totalprice, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS INTEGER) AS worker FROM orders",
    "limit_after_skip": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY o_orderkey LIMIT 10",
    "paired_files": "WITH c AS (SELECT p_name AS stem, bool_or(p_size > 25) AS lower, bool_or(p_size > 10) AS upper FROM part GROUP BY 1) SELECT p_partkey, p_name AS stem, CASE WHEN lower THEN 'pdf' ELSE 'PDF' END AS suffix FROM part JOIN c ON p_name = stem WHERE upper",
    "numeric_keys": "SELECT c_custkey::INTEGER AS k FROM customer WHERE c_acctbal > 0",
}
