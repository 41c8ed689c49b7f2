"""The registry: one query for each operator, and the SQL that says the same for the oracle.

A query is SQL text (the same for both engines unless two are given) or a
function of (spark, sf_dir) with SQL beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.functions import jsonpath as J
from lakequill.functions import scalars as S
from lakequill.functions import sqljson as Q
from lakequill.functions import temporal as T
from lakequill.operators import aggregates as A
from lakequill.operators import relational as R
from lakequill.operators import tables as TB
from lakequill.operators.ordering import asc, desc
from lakequill.operators.windows import global_ranks, over_groups
from lakequill.sources import copy as C
from lakequill.sources.tables import catalog_columns, sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def both(name: str, text: str, oracle: str | None = None, args: dict | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: sql(spark, sf_dir, text, args)
    ORACLE[name] = oracle or text


def plan(oracle: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def literal(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


# Small tables with nulls and ties, written in SQL that both engines read.
EDGE_A = "(1, 1, 10.0D, 'alpha', true, '{\"kind\":\"a\",\"n\":1}'), (2, 1, 20.0D, 'beta', false, '{\"kind\":\"b\",\"n\":2}'), (3, 2, NULL, NULL, true, NULL), (4, 2, 40.0D, 'delta', NULL, '{\"kind\":\"d\",\"n\":4}')"
EDGE_A_DUCK = EDGE_A.replace("0D,", "0::DOUBLE,")
EDGE_COLS = "id, group_id, value, label, flag, payload"
E = f"(SELECT * FROM (VALUES {EDGE_A}) AS t({EDGE_COLS}))"
ED = f"(SELECT * FROM (VALUES {EDGE_A_DUCK}) AS t({EDGE_COLS}))"


def edge(name: str, text: str, duck: str | None = None) -> None:
    """``text`` over the edge table EDGE."""
    both(name, text.replace("EDGE", E), (duck or text).replace("EDGE", ED))


# Flagship and benchmark shapes.
FLAGSHIP = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
  round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""
both("b00_rollup", FLAGSHIP, FLAGSHIP.replace("TIMESTAMP_NTZ", "TIMESTAMP"))
both("b01_top10", "SELECT event_id, value FROM events ORDER BY value DESC NULLS FIRST, event_id ASC NULLS LAST LIMIT 10")
both("b02_group_count_sum", "SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
both("b03_time_range", "SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP_NTZ '2024-01-05 00:00:00' AND TIMESTAMP_NTZ '2024-01-06 00:00:00' ORDER BY ts DESC NULLS FIRST", "SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
both("b06_selective_join", "SELECT o_orderkey, c_name, round(o_totalprice, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000")

# S: scans, sources, sinks.
both("s01_scan", "SELECT r_regionkey, r_name FROM region")
both("s02_scan_columns", "SELECT p_partkey, p_brand, p_size FROM part")
both("s04_range_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 400 AND o_orderstatus = 'O'")
both("s05_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
both("s08_values", "SELECT id, label FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS t(id, label)")
both("s09_no_from", "SELECT 1 + 1 AS two, 'x' AS x")
both("s10_generate_series", "SELECT id AS n FROM range(1, 20, 3)", "SELECT range AS n FROM range(1, 20, 3)")
both("s10_series_sequence", "SELECT explode(sequence(10, 1, -3)) AS n", "SELECT unnest(generate_series(10, 1, -3))::INTEGER AS n")


@plan("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def s06_view(spark, sf_dir):
    sql(spark, sf_dir, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey").createOrReplaceTempView("nation_region")
    return spark.sql("SELECT n_name, r_name FROM nation_region WHERE r_name <> 'ASIA'")


@plan("SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS ordinal_position FROM information_schema.columns WHERE table_name IN ('region', 'nation')")
def s07_catalog(spark, sf_dir):
    return catalog_columns(spark, {t: table(spark, sf_dir, t) for t in ("region", "nation")})


@plan("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def s11_copy_text(spark, sf_dir):
    return _copied(spark, table(spark, sf_dir, "supplier"), "text", False)


@plan("SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '1-URGENT') AS priority, o_orderdate FROM orders")
def s12_copy_csv(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus", "nullif(o_orderpriority, '1-URGENT') AS priority", "o_orderdate")
    return _copied(spark, orders, "csv", True)


def _copied(spark, df, form, header):
    path = C.staging_path(spark, "copy")
    C.copy_to(df, path, form, header)
    return C.copy_from(spark, path, df.schema, form, header)


@plan(None)
def s14_explain(spark, sf_dir):
    rows = sql(spark, sf_dir, "EXPLAIN FORMATTED SELECT o_orderstatus, count(*) FROM orders WHERE o_orderkey < 100 GROUP BY o_orderstatus")
    return rows.select(F.explode(F.split("plan", "\n")).alias("line"))


# F: projection, filter, predicates.
both("f01_projection", "SELECT c_custkey, c_name AS name, c_acctbal * 2 AS twice FROM customer")
both("f02_where", "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') <> 'MACHINERY'")
both("f03_compare", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 20 AND p_size <> 15")
edge("f04_logic", "SELECT id, (flag AND value > 15) AS a, (flag OR value > 15) AS o, (NOT flag) AS n FROM EDGE")
edge("f05_null_tests", "SELECT id, value IS NULL AS v, label IS NOT NULL AS l FROM EDGE")
edge("f06_truth_tests", "SELECT id, flag IS TRUE AS t, flag IS NOT FALSE AS nf, flag IS NULL AS u FROM EDGE")
edge("f07_distinct_from", "SELECT id, value IS DISTINCT FROM 20 AS d, label IS NOT DISTINCT FROM NULL AS s FROM EDGE")
edge("f08_between", "SELECT id, value BETWEEN 10 AND 20 AS b, value NOT BETWEEN 10 AND 20 AS nb FROM EDGE")
edge("f09_in_list", "SELECT id, value IN (10, NULL) AS i, value NOT IN (10, NULL) AS ni FROM EDGE")
both("f10_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%' AND p_type NOT LIKE 'S%' AND 'a%b' LIKE 'a!%b' ESCAPE '!'")
both("f11_ilike", "SELECT c_custkey FROM customer WHERE c_name ILIKE 'CUSTOMER%1' OR c_mktsegment ILIKE 'build%'")


@plan("SELECT c_custkey FROM customer WHERE c_mktsegment SIMILAR TO '.*IL.*' AND NOT c_mktsegment SIMILAR TO 'H.*'")
def f12_similar_to(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(S.similar_to(F.col("c_mktsegment"), "%IL%") & ~S.similar_to(F.col("c_mktsegment"), "H%")).select("c_custkey")


both("f13_regex_match", "SELECT c_custkey FROM customer WHERE c_name RLIKE '[13]$' AND c_mktsegment RLIKE '(?i)^b' AND NOT c_name RLIKE '11'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[13]$') AND regexp_matches(c_mktsegment, '^b', 'i') AND NOT regexp_matches(c_name, '11')")
both("f14_any_all_array", "SELECT n_nationkey, exists(array(1, 5, NULL), x -> x = n_nationkey) AS a, forall(array(1, 5), x -> x < n_nationkey) AS l FROM nation", "SELECT n_nationkey, n_nationkey = ANY(SELECT unnest([1, 5, NULL])) AS a, n_nationkey > ALL(SELECT unnest([1, 5])) AS l FROM nation")


@plan("SELECT p_partkey, p_size > ALL (SELECT nullif(n_nationkey, 24) FROM nation WHERE n_nationkey > 10) AS verdict FROM part")
def f15_all_subquery(spark, sf_dir):
    values = sql(spark, sf_dir, "SELECT nullif(n_nationkey, 24) AS v FROM nation WHERE n_nationkey > 10")
    return R.compare_all(table(spark, sf_dir, "part"), "p_size", ">", values).select("p_partkey", "verdict")


@plan("SELECT p_partkey, p_size < ANY (SELECT nullif(n_nationkey, 24) FROM nation) AS verdict FROM part")
def f15_any_subquery(spark, sf_dir):
    return R.compare_any(table(spark, sf_dir, "part"), "p_size", "<", sql(spark, sf_dir, "SELECT nullif(n_nationkey, 24) AS v FROM nation")).select("p_partkey", "verdict")


@plan("SELECT n_nationkey, n_regionkey <> ALL (SELECT nullif(r_regionkey, 2) FROM region WHERE r_regionkey > 1) AS no, n_regionkey = ALL (SELECT r_regionkey FROM region WHERE r_regionkey = 3) AS yes, n_regionkey <> ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 90) AS none FROM nation")
def f15_equal_all(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    for name, op, values in (("no", "<>", "SELECT nullif(r_regionkey, 2) AS v FROM region WHERE r_regionkey > 1"), ("yes", "=", "SELECT r_regionkey FROM region WHERE r_regionkey = 3"), ("none", "<>", "SELECT r_regionkey FROM region WHERE r_regionkey > 90")):
        n = R.compare_all(n, "n_regionkey", op, sql(spark, sf_dir, values)).withColumnRenamed("verdict", name)
    return n.select("n_nationkey", "no", "yes", "none")


@plan("SELECT o_orderkey, o_custkey = ANY (SELECT nullif(c_custkey, 7) FROM customer WHERE c_mktsegment = 'BUILDING') AS eq, o_custkey <> ANY (SELECT c_custkey FROM customer WHERE c_custkey = 5) AS ne, o_custkey = ANY (SELECT c_custkey FROM customer WHERE c_custkey < 0) AS none FROM orders")
def f15_equal_any(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    for name, op, values in (("eq", "=", "SELECT nullif(c_custkey, 7) AS v FROM customer WHERE c_mktsegment = 'BUILDING'"), ("ne", "<>", "SELECT c_custkey FROM customer WHERE c_custkey = 5"), ("none", "=", "SELECT c_custkey FROM customer WHERE c_custkey < 0")):
        o = R.compare_any(o, "o_custkey", op, sql(spark, sf_dir, values)).withColumnRenamed("verdict", name)
    return o.select("o_orderkey", "eq", "ne", "none")


both("f16_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' END AS a, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS b FROM orders")
edge("f17_coalesce_nullif", "SELECT id, coalesce(label, 'none') AS c, nullif(group_id, 1) AS n FROM EDGE")
edge("f18_is_json", "SELECT id, try_parse_json(payload) IS NOT NULL AS j, try_parse_json(label) IS NOT NULL AS k FROM EDGE", "SELECT id, coalesce(json_valid(payload), FALSE) AS j, coalesce(json_valid(label), FALSE) AS k FROM EDGE")
_forms = "CASE o_orderkey % 5 WHEN 0 THEN concat('{\"k\": ', o_custkey, '}') WHEN 1 THEN concat('[', o_custkey, ']') WHEN 2 THEN CAST(o_custkey AS {0}) WHEN 3 THEN concat('{{', o_custkey) END"


@plan("SELECT o_orderkey, " + ", ".join(f"CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE o_orderkey % 5 IN ({x}) END AS {k}" for k, x in (("v", "0, 1, 2"), ("o", "0"), ("a", "1"), ("s", "2"))) + " FROM orders")
def f18_json_kinds(spark, sf_dir):
    """IS JSON VALUE, OBJECT, ARRAY and SCALAR of objects, arrays, numbers, broken text and nulls."""
    docs = table(spark, sf_dir, "orders").withColumn("doc", F.expr(_forms.replace("{0}", "STRING").replace("{{", "{")))
    return docs.select("o_orderkey", *[J.is_json(F.col("doc"), kind).alias(kind[0]) for kind in ("value", "object", "array", "scalar")])


both("f19_subscripts", "SELECT vec_id, try_element_at(split(CAST(label AS STRING), ''), 1) AS first, embedding[0] AS x, try_element_at(embedding, 100000) AS none FROM embeddings", "SELECT vec_id, CAST(label AS VARCHAR)[1] AS first, embedding[1] AS x, embedding[100000] AS none FROM embeddings")
both("f20_row", "SELECT r.r_name AS name FROM (SELECT struct(region.*) AS r FROM region)", "SELECT r.r_name AS name FROM (SELECT region AS r FROM region)")
both("f21_casts", "SELECT CAST('12' AS INT) AS a, CAST(3.7 AS STRING) AS b, CAST('2024-02-29' AS DATE) AS c, TRY_CAST('x' AS INT) AS d, CAST(5 AS DOUBLE) AS e", "SELECT CAST('12' AS INT) AS a, CAST(3.7 AS VARCHAR) AS b, CAST('2024-02-29' AS DATE) AS c, TRY_CAST('x' AS INT) AS d, CAST(5 AS DOUBLE) AS e")
both("f22_literals", "SELECT 42 AS i, 1.5 AS d, 'it''s' AS s, DATE '2024-01-31' AS dt, TIMESTAMP_NTZ '2024-01-31 10:20:30' AS ts, true AS b", "SELECT 42 AS i, 1.5 AS d, 'it''s' AS s, DATE '2024-01-31' AS dt, TIMESTAMP '2024-01-31 10:20:30' AS ts, true AS b")

# J: joins.
both("j01_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
both("j02_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("j03_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000")
both("j04_right", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0")
both("j05_full", "SELECT c.k AS a, s.k AS b FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_custkey < 30) c FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) s ON c.k = s.k")
both("j06_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
both("j07_using", "SELECT k, r_name, n FROM (SELECT r_regionkey AS k, r_name FROM region) JOIN (SELECT n_regionkey AS k, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY n_regionkey) USING (k)")
both("j08_index_join", "SELECT l_linenumber, o_orderstatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 7")
both("j09_lateral", "SELECT n_name, t.c_name, t.bal FROM nation, LATERAL (SELECT c_name, round(c_acctbal, 2) AS bal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t")
both("j10_self", "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey")
both("j11_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
both("j12_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
both("j12_not_in_null", "SELECT r_regionkey FROM region WHERE r_regionkey NOT IN (SELECT nullif(n_regionkey, 3) FROM nation WHERE n_regionkey > 2)")


@plan("SELECT o_orderkey, b.name FROM orders JOIN (VALUES (0, 50000, 'low'), (50000, 150000, 'mid'), (150000, 600000, 'high')) AS b(lo, hi, name) ON o_totalprice >= b.lo AND o_totalprice < b.hi")
def j13_range_join(spark, sf_dir):
    bands = literal(spark, "(0, 50000, 'low'), (50000, 150000, 'mid'), (150000, 600000, 'high')", "lo, hi, name")
    return R.range_join(table(spark, sf_dir, "orders"), bands, "o_totalprice", "lo", "hi", 50000).select("o_orderkey", "name")


# Q: subqueries, CTEs, validation.
both("q01_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)")
both("q02_correlated", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer")
both("q03_from_subquery", "SELECT k, n FROM (SELECT o_custkey, CAST(count(*) AS BIGINT) FROM orders GROUP BY o_custkey) AS t(k, n) WHERE n > 5")
both("q04_array_subquery", "SELECT r_name, array_join((SELECT array_sort(collect_list(n_name)) FROM nation WHERE n_regionkey = r_regionkey), ',') AS names FROM region", "SELECT r_name, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS names FROM region")
both("q05_with", "WITH a(k, total) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey), b AS (SELECT k FROM a WHERE total > 500000) SELECT c_name FROM customer JOIN b ON c_custkey = k")
both("q06_recursive_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")


@plan("WITH RECURSIVE e(a, b) AS (VALUES (1, 2), (2, 3), (3, 1), (4, 5)), t(n) AS (SELECT 1 UNION SELECT b FROM t JOIN e ON a = n) SELECT n FROM t")
def q06_recursive_union(spark, sf_dir):
    e = literal(spark, "(1, 2), (2, 3), (3, 1), (4, 5)", "a, b")
    return R.recursive_union(spark.sql("SELECT 1 AS n"), lambda t: t.join(e, t["n"] == e["a"]).select(F.col("b").alias("n")))


both("q07_row_compare", "SELECT o_orderkey FROM orders WHERE struct(o_custkey, o_orderkey) < struct(CAST(10 AS BIGINT), CAST(500 AS BIGINT))", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderkey) < (10, 500)")


@plan("""SELECT 'not_null' AS kind, 'seg' AS name, count(*) AS n FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL
UNION ALL SELECT 'unique', 'c_nationkey', count(*) FROM (SELECT 1 FROM customer GROUP BY c_nationkey HAVING count(*) > 1)
UNION ALL SELECT 'check', 'positive', count(*) FROM customer WHERE NOT c_acctbal > 0
UNION ALL SELECT 'foreign', 'order', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def q08_constraints(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("seg", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return R.violations(c, not_null=["seg"], unique=[["c_nationkey"]], checks={"positive": F.col("c_acctbal") > 0}, foreign={"order": (["c_custkey"], table(spark, sf_dir, "orders"), ["o_custkey"])})


# A: aggregation.
edge("a01_count", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(value) AS BIGINT) AS v FROM EDGE")
both("a02_count_distinct", "SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
edge("a03_sum", "SELECT group_id, sum(value) AS s, CAST(sum(id) AS BIGINT) AS i FROM EDGE GROUP BY group_id")
edge("a04_avg", "SELECT group_id, avg(value) AS a, round(avg(id), 4) AS i FROM EDGE GROUP BY group_id")
edge("a05_min_max", "SELECT min(value) AS a, max(label) AS b, min(flag) AS c FROM EDGE")
both("a06_string_agg", "SELECT n_regionkey, listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")


@plan(f"SELECT group_id, array_to_string(array_agg(label ORDER BY id) FILTER (WHERE label IS NOT NULL), ',') AS labels FROM {ED} GROUP BY group_id")
def a07_array_agg(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {E}").groupBy("group_id").agg(F.array_join(A.array_agg(F.col("label"), F.col("id")), ",").alias("labels"))


@plan(f"SELECT group_id, replace(CAST(to_json(list(label ORDER BY id)) AS VARCHAR), ' ', '') AS j FROM {ED} GROUP BY group_id")
def a08_json_agg(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {E}").groupBy("group_id").agg(A.json_agg(F.col("label"), F.col("id")).alias("j"))


@plan("SELECT r_name, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def a09_json_object_agg(spark, sf_dir):
    n = sql(spark, sf_dir, "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")
    return n.groupBy("r_name").agg(A.json_object_agg(F.col("n_name"), F.col("n_nationkey")).alias("j"))


both("a10_distinct_aggs", "SELECT p_brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS s, round(avg(DISTINCT p_size), 4) AS a FROM part GROUP BY p_brand")
both("a11_filter", "SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS open, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS done FROM orders GROUP BY o_custkey")
both("a14_group_expression", "SELECT p_size % 10 AS k, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_size % 10")
both("a15_empty", "SELECT CAST(count(*) AS BIGINT) AS n, sum(p_size) AS s FROM part WHERE p_size < 0", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(p_size) AS BIGINT) AS s FROM part WHERE p_size < 0")
both("a16_having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
both("a17_grouping_sets", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
both("a18_rollup", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("a19_cube", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("a22_fast_paths", "SELECT CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS n, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS d FROM lineitem")

# W: windows.
W = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey)"


@plan(f"SELECT o_orderkey, CAST(row_number() {W} AS BIGINT) AS rn, CAST(rank() OVER (ORDER BY o_orderpriority) AS BIGINT) AS r, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS BIGINT) AS d FROM orders")
def w01_ranking(spark, sf_dir):
    """A window without partitions would put all rows into one task; ranks of the distinct keys take none."""
    numbered = sql(spark, sf_dir, f"SELECT o_orderkey, o_orderpriority, CAST(row_number() {W} AS BIGINT) AS rn FROM orders")
    return global_ranks(numbered, {"o_orderpriority": asc}, "r", "d").drop("o_orderpriority")


both("w04_distribution", f"SELECT o_orderkey, round(percent_rank() {W}, 6) AS p, round(cume_dist() {W}, 6) AS c, CAST(ntile(3) {W} AS BIGINT) AS t FROM orders")
both("w07_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) {W} AS a, lead(o_orderkey, 2, CAST(-1 AS BIGINT)) {W} AS b FROM orders")
both("w08_first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) {W} AS f, last_value(o_orderkey) {W} AS l, nth_value(o_orderkey, 2) {W} AS n FROM orders")
both("w11_aggregates", f"SELECT o_orderkey, round(sum(o_totalprice) {W}, 2) AS s, CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS n, round(max(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS m FROM orders")
edge("w12_peers", "SELECT id, CAST(sum(id) OVER (ORDER BY group_id) AS BIGINT) AS s FROM EDGE")
both("w13_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM events")


@plan("SELECT event_id, CAST(count(*) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events")
def w14_groups_frame(spark, sf_dir):
    return over_groups(table(spark, sf_dir, "events"), ["event_type"], [asc("user_id")], -1, 0, n=F.count("*")).select("event_id", "n")


both(  # rows are counted for each size first, so the window sees one row a size
    "w15_range_frame",
    "WITH s AS (SELECT p_size AS k, count(*) AS c FROM part GROUP BY p_size), t AS (SELECT k, sum(c) OVER (ORDER BY k RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM s) SELECT p_partkey, CAST(n AS BIGINT) AS n FROM part JOIN t ON p_size <=> k",
    "SELECT p_partkey, CAST(count(*) OVER (ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM part",
)
both("w17_many_specs", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS a, CAST(count(*) OVER w AS BIGINT) AS b FROM orders WINDOW w AS (PARTITION BY o_orderstatus)")
both("w20_window_over_aggregate", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM orders GROUP BY o_orderstatus")

# T: sort, limit, distinct.
edge("t01_order", "SELECT id, CAST(row_number() OVER (ORDER BY value DESC NULLS FIRST) AS BIGINT) AS d, CAST(row_number() OVER (ORDER BY value ASC NULLS LAST) AS BIGINT) AS a FROM EDGE")


@plan("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25")
def t02_top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(desc("o_totalprice"), asc("o_orderkey")).limit(25).select("o_orderkey", "o_totalprice")


both("t04_limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey NULLS LAST LIMIT 10 OFFSET 20")
both("t06_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")


@plan("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def t07_distinct_on(spark, sf_dir):
    return R.distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], [desc("o_totalprice"), asc("o_orderkey")]).select("o_custkey", "o_orderkey")


both("t09_keyset", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP_NTZ '1996-01-01 00:00:00' OR (o_orderdate = TIMESTAMP_NTZ '1996-01-01 00:00:00' AND o_orderkey > 50) ORDER BY o_orderdate NULLS LAST, o_orderkey NULLS LAST LIMIT 15", "SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1996-01-01', 50) ORDER BY o_orderdate, o_orderkey LIMIT 15")

# U: set operations.
for _name, _op in {"u01_union_all": "UNION ALL", "u02_union": "UNION", "u03_intersect": "INTERSECT", "u04_intersect_all": "INTERSECT ALL", "u05_except": "EXCEPT", "u06_except_all": "EXCEPT ALL"}.items():
    both(_name, f"SELECT p_size AS k FROM part {_op} SELECT n_nationkey AS k FROM nation")

# ST, M, N, O: scalar functions.
both("st01_case_length", "SELECT c_custkey, lower(c_name) AS l, upper(c_name) AS u, CAST(char_length(c_name) AS BIGINT) AS n FROM customer", "SELECT c_custkey, lower(c_name) AS l, upper(c_name) AS u, CAST(length(c_name) AS BIGINT) AS n FROM customer")
both("st03_trim", "SELECT trim('  a ') AS t, btrim('xxaxx', 'x') AS b, ltrim('x', 'xxa') AS l, rtrim('x', 'axx') AS r", "SELECT trim('  a ') AS t, trim('xxaxx', 'x') AS b, ltrim('xxa', 'x') AS l, rtrim('axx', 'x') AS r")


@plan("SELECT c_custkey, substr(c_name, 3, 4) AS a, substr(c_name, 1, 2) AS b, substr(c_name, 10) AS c FROM customer")
def st04_substring(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", S.substring_from(n, 3, 4).alias("a"), S.substring_from(n, -2, 2).alias("b"), S.substring_from(n, 10).alias("c"))


@plan(f"SELECT id, concat(label, '-', id) AS c, concat_ws(',', label, id) AS w FROM {ED}")
def st05_concat(spark, sf_dir):
    i = F.col("id").cast("string")
    return spark.sql(f"SELECT * FROM {E}").select("id", S.concat_all(F.col("label"), F.lit("-"), i).alias("c"), F.concat_ws(",", "label", i).alias("w"))


edge("st07_pipes", "SELECT id, label || '!' AS p FROM EDGE")
both("st08_replace_left_right", "SELECT p_partkey, replace(p_type, 'A', 'aa') AS r, left(p_name, 3) AS l, right(p_name, 3) AS e, reverse(p_name) AS v, CAST(position('a' IN p_name) AS BIGINT) AS p FROM part")


@plan("""SELECT c_custkey, 'name ' || c_name || ' "' || c_mktsegment || '" ''' || c_name || ''' %' AS f, '"' || c_name || '"' AS q FROM customer""")
def st12_format(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", S.format_text("name %s %I %L %%", F.col("c_name"), F.col("c_mktsegment"), F.col("c_name")).alias("f"), S.quote_ident(F.col("c_name")).alias("q"))


@plan("SELECT p_partkey, regexp_replace(p_name, '([aeiou])([a-z])', '<\\2\\1>') AS one, regexp_replace(p_name, '[aeiou]', '_', 'g') AS every FROM part")
def st14_regexp_replace(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", S.regexp_replace_first(n, "([aeiou])([a-z])", "<$2$1>").alias("one"), F.regexp_replace(n, "[aeiou]", "_").alias("every"))


@plan("SELECT c_custkey, CASE WHEN regexp_matches(c_name, '([a-z]+)[^0-9]*([0-9]+)') THEN regexp_extract(c_name, '([a-z]+)[^0-9]*([0-9]+)', 2) END AS m, nullif(regexp_extract(c_name, '[0-9]+'), '') AS s FROM customer")
def st15_regexp_match(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.try_element_at(S.regexp_match(n, "([a-z]+)[^0-9]*([0-9]+)"), F.lit(2)).alias("m"), F.regexp_substr(n, F.lit("[0-9]+")).alias("s"))


both("m01_rounding", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c FROM customer")
both("m04_powers", "SELECT n_nationkey, power(n_nationkey, 2) AS p, round(sqrt(n_nationkey), 9) AS s, n_nationkey % 7 AS m, n_nationkey div 4 AS d FROM nation", "SELECT n_nationkey, power(n_nationkey, 2) AS p, round(sqrt(n_nationkey), 9) AS s, n_nationkey % 7 AS m, CAST(n_nationkey // 4 AS BIGINT) AS d FROM nation")
both("m07_transcendental", "SELECT n_nationkey, round(sin(n_nationkey), 9) AS s, round(cos(n_nationkey), 9) AS c, round(tan(n_nationkey), 6) AS t, round(ln(n_nationkey + 1), 9) AS l, round(exp(n_nationkey / 10.0D), 6) AS e, round(log10(n_nationkey + 1), 9) AS g, round(pi(), 9) AS p FROM nation", "SELECT n_nationkey, round(sin(n_nationkey), 9) AS s, round(cos(n_nationkey), 9) AS c, round(tan(n_nationkey), 6) AS t, round(ln(n_nationkey + 1), 9) AS l, round(exp(n_nationkey / 10.0::DOUBLE), 6) AS e, round(log10(n_nationkey + 1), 9) AS g, round(pi(), 9) AS p FROM nation")
edge("m10_greatest_least", "SELECT id, greatest(value, 15) AS g, least(value, 15) AS l FROM EDGE")
both("m12_bits", "SELECT n_nationkey, n_nationkey & 5 AS a, n_nationkey | 8 AS o, n_nationkey ^ 3 AS x, shiftleft(n_nationkey, 2) AS l, shiftright(n_nationkey, 1) AS r FROM nation", "SELECT n_nationkey, n_nationkey & 5 AS a, n_nationkey | 8 AS o, xor(n_nationkey, 3) AS x, n_nationkey << 2 AS l, n_nationkey >> 1 AS r FROM nation")
both("n01_typeof", "SELECT typeof(r_name) AS t, typeof(r_regionkey) AS k FROM region", "SELECT CASE typeof(r_name) WHEN 'VARCHAR' THEN 'string' END AS t, CASE typeof(r_regionkey) WHEN 'INTEGER' THEN 'int' END AS k FROM region")
both("n02_row", "SELECT named_struct('a', r_regionkey, 'b', r_name).b AS b FROM region", "SELECT struct_pack(a := r_regionkey, b := r_name).b AS b FROM region")
QUERIES["n03_session"] = lambda spark, sf_dir: spark.sql("SELECT version() AS version, current_database() AS database, current_user() AS user")


@plan("SELECT n_nationkey, n_nationkey >= 3 AND n_nationkey < 9 AS c, n_nationkey < 9 AND n_nationkey + 2 > 3 AS o, (n_nationkey >= 1 AND n_nationkey < 4) OR (n_nationkey >= 20 AND n_nationkey < 22) AS m FROM nation")
def o20_ranges(spark, sf_dir):
    n, r = F.col("n_nationkey"), S.int_range(F.lit(3), F.lit(9))
    many = F.array(S.int_range(F.lit(1), F.lit(4)), S.int_range(F.lit(20), F.lit(22)))
    return table(spark, sf_dir, "nation").select("n_nationkey", S.range_contains(r, n).alias("c"), S.ranges_overlap(r, S.int_range(n, n + 2)).alias("o"), S.multirange_contains(many, n).alias("m"))


# DT: date and time.
_fields = ["year", "month", "day", "quarter", "hour", "minute", "second", "doy", "dow", "isodow", "decade", "century"]


@plan("SELECT event_id, " + ", ".join(f"CAST(extract({f} FROM ts) AS BIGINT) AS f_{f}" for f in _fields) + " FROM events")
def dt01_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *[T.part(f, F.col("ts")).cast("bigint").alias(f"f_{f}") for f in _fields])


_at = "CAST(make_date(2024, 2, 29) AS TIMESTAMP) + to_microseconds(event_id * 7919017)"


@plan(f"SELECT event_id, round(microsecond({_at}) / 1000000.0, 6) AS s, round(microsecond({_at}) / 1000.0, 3) AS ms, microsecond({_at}) AS us FROM events")
def dt01_fractions(spark, sf_dir):
    """Seconds and their parts keep their fractions."""
    at = F.expr("TIMESTAMP_NTZ '2024-02-29 00:00:00' + make_dt_interval(0, 0, 0, CAST(event_id * 7919017 / 1000000 AS DECIMAL(18, 6)))")
    return table(spark, sf_dir, "events").select("event_id", T.part("second", at).cast("double").alias("s"), T.part("milliseconds", at).cast("double").alias("ms"), T.part("microseconds", at).alias("us"))


@plan("SELECT event_id, " + ", ".join(f"CAST(date_trunc('{f}', ts) AS TIMESTAMP) AS t_{f}" for f in ("year", "month", "day", "hour", "minute", "second")) + " FROM events")
def dt02_trunc(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *[T.trunc(f, F.col("ts")).alias(f"t_{f}") for f in ("year", "month", "day", "hour", "minute", "second")])


@plan("""SELECT o_orderkey, CAST((2001 - extract(year FROM o_orderdate)) * 12 + 3 - extract(month FROM o_orderdate) - CASE WHEN extract(day FROM o_orderdate) > 15 THEN 1 ELSE 0 END AS BIGINT) AS months,
  CAST(15 - extract(day FROM o_orderdate) + CASE WHEN extract(day FROM o_orderdate) > 15 THEN 28 ELSE 0 END AS BIGINT) AS days FROM orders""")
def dt03_age(spark, sf_dir):
    a = T.age(F.expr("TIMESTAMP_NTZ '2001-03-15 00:00:00'"), F.col("o_orderdate").cast("date").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").select("o_orderkey", a["months"].cast("bigint").alias("months"), a["days"].cast("bigint").alias("days"))


both("dt04_make", "SELECT n_nationkey, make_date(2020, 1 + n_nationkey % 12, 5) AS d, make_timestamp_ntz(2020, 1 + n_nationkey % 12, 5, 6, 7, 8.5) AS t FROM nation", "SELECT n_nationkey, make_date(2020, 1 + n_nationkey % 12, 5) AS d, make_timestamp(2020, 1 + n_nationkey % 12, 5, 6, 7, 8.5) AS t FROM nation")
QUERIES["dt06_clock"] = lambda spark, sf_dir: spark.sql("SELECT now() = current_timestamp() AS stable, current_date() = to_date(now()) AS today")
ORACLE["dt06_clock"] = "SELECT now() = current_timestamp AS stable, TRUE AS today"
both("dt07_date_int", "SELECT o_orderkey, date_add(CAST(o_orderdate AS DATE), 10) AS a, date_sub(CAST(o_orderdate AS DATE), 3) AS b, CAST(datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS n FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10 AS a, CAST(o_orderdate AS DATE) - 3 AS b, CAST(DATE '2000-01-01' - CAST(o_orderdate AS DATE) AS BIGINT) AS n FROM orders")
both("dt09_ts_interval", "SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS a, o_orderdate - INTERVAL '36' HOUR AS b FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS a, o_orderdate - INTERVAL '36' HOUR AS b FROM orders")
both("dt11_ts_difference", "SELECT event_id, CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) AS BIGINT) AS s FROM events", "SELECT event_id, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS s FROM events")
both("dt14_buckets", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS bucket, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 4) AS a FROM events GROUP BY 1, 2", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 4) AS a FROM events GROUP BY 1, 2")
both("dt15_gap_fill", "SELECT b AS bucket, CAST(count(event_id) AS BIGINT) AS n FROM (SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-31 00:00:00', INTERVAL '1' HOUR)) AS b) LEFT JOIN events ON CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) = b AND event_type = 'error' GROUP BY b", "SELECT b AS bucket, CAST(count(event_id) AS BIGINT) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL '1' HOUR)) AS b) LEFT JOIN events ON date_trunc('hour', ts) = b AND event_type = 'error' GROUP BY b")
both("dt16_dynamic_interval", "SELECT event_id, timestampadd(MINUTE, CAST(user_id % 60 AS INT), ts) AS t FROM events", "SELECT event_id, ts + to_minutes(CAST(user_id % 60 AS BIGINT)) AS t FROM events")

# AR: arrays.
both("ar01_arrays", "SELECT n_nationkey, CAST(size(a) AS BIGINT) AS n, array_join(array_append(a, 9), ',') AS ap, array_join(array_prepend(a, 0), ',') AS pr, array_join(concat(a, array(7)), ',') AS c, CAST(nullif(array_position(a, 2), 0) AS BIGINT) AS p, CAST(size(flatten(array(a, a))) AS BIGINT) AS card FROM (SELECT n_nationkey, array(1, n_nationkey, 3) AS a FROM nation)", "SELECT n_nationkey, len(a) AS n, array_to_string(list_append(a, 9), ',') AS ap, array_to_string(list_prepend(0, a), ',') AS pr, array_to_string(list_concat(a, [7]), ',') AS c, CAST(nullif(list_position(a, 2), 0) AS BIGINT) AS p, len(flatten([a, a])) AS card FROM (SELECT n_nationkey, [1, n_nationkey, 3] AS a FROM nation)")


@plan("SELECT p_partkey, array_to_string(string_split(p_type, ' '), '|') AS w, substr(p_brand, 1, 1) AS c FROM part")
def ar08_string_to_array(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.string_to_array(F.col("p_type"), " "), "|").alias("w"), S.string_to_array(F.col("p_brand"), "")[0].alias("c"))


both("ar09_unnest", "SELECT p_partkey, w FROM part LATERAL VIEW explode(split(p_type, ' ')) t AS w", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part")
both("ar09_ordinality", "SELECT p_partkey, CAST(pos + 1 AS BIGINT) AS i, w FROM part LATERAL VIEW posexplode(split(p_type, ' ')) t AS pos, w", "SELECT p_partkey, unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS i, unnest(string_split(p_type, ' ')) AS w FROM part")
both("ar10_select_series", "SELECT n_nationkey, i * 2 AS i FROM (SELECT n_nationkey, explode(sequence(1, 1 + n_nationkey % 3)) AS i FROM nation)", "SELECT n_nationkey, unnest(generate_series(1, 1 + n_nationkey % 3))::INTEGER * 2 AS i FROM nation")

# JS: JSON.
DOC = '{"a": {"b": [10, 20, {"c": "x"}]}, "k": null, "n": 5, "tags": ["red", "blue"]}'
both("js01_arrow", "SELECT event_id, get_json_object(props, '$.k') AS k, CAST(variant_get(parse_json(props), '$.k', 'int') AS BIGINT) AS n FROM events", "SELECT event_id, props->>'k' AS k, CAST(props->>'k' AS BIGINT) AS n FROM events")
both("js02_path", f"SELECT get_json_object('{DOC}', '$.a.b[1]') AS a, get_json_object('{DOC}', '$.a.b[2].c') AS c", f"SELECT '{DOC}'::JSON->>'$.a.b[1]' AS a, '{DOC}'::JSON->>'$.a.b[2].c' AS c")


def documents_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, DOC), (2, '{"n": 1}'), (3, None), (4, "broken {"), (5, "[1, [2, 3]]")], "id int, doc string")


def json_rows(name: str, expected: str, **columns: Callable[[], object]) -> None:
    """A query over a few documents whose results are written out as the oracle."""
    QUERIES[name] = lambda spark, sf_dir: documents_of(spark).select("id", *[c().alias(k) for k, c in columns.items()])
    ORACLE[name] = f"SELECT * FROM (VALUES {expected}) AS t(id, {', '.join(columns)})"


D = lambda: F.col("doc")
json_rows("js01_negative_index", "(1, NULL, '{\"c\": \"x\"}'), (2, NULL, NULL), (3, NULL, NULL), (4, NULL, NULL), (5, '[2, 3]', NULL)", last=lambda: J.json_get(D(), -1), deep=lambda: J.json_get(D(), "a", "b", -1))
json_rows("js03_contains", "(1, TRUE, FALSE), (2, FALSE, TRUE), (3, NULL, NULL), (4, NULL, NULL), (5, FALSE, FALSE)", a=lambda: J.json_contains(D(), F.lit('{"tags": ["blue"]}')), b=lambda: J.json_contains(F.lit('{"n": 1, "m": 2}'), D()))
json_rows("js04_keys", "(1, TRUE, TRUE), (2, TRUE, FALSE), (3, NULL, NULL), (4, NULL, NULL), (5, NULL, NULL)", n=lambda: F.array_contains(F.json_object_keys(D()), "n"), all_keys=lambda: F.forall(F.array(F.lit("n"), F.lit("k")), lambda k: F.array_contains(F.json_object_keys(D()), k)))
json_rows("js05_path_tests", "(1, TRUE, TRUE), (2, FALSE, FALSE), (3, NULL, NULL), (4, NULL, NULL), (5, FALSE, NULL)", e=lambda: J.path_exists(D(), '$.tags[*] ? (@ == "red")'), m=lambda: F.when(F.col("id") != 5, J.path_match(D(), "$.n > 3")))
json_rows("js06_delete_path", "(1, '{\"a\": {\"b\": [20, {\"c\": \"x\"}]}, \"k\": null, \"n\": 5, \"tags\": [\"red\", \"blue\"]}'), (2, '{\"n\": 1}'), (3, NULL), (4, NULL), (5, '[1, [2, 3]]')", d=lambda: J.json_delete(D(), ["a", "b", "0"]))
json_rows("js08_concat", "(1, NULL), (2, '{\"n\": 1, \"z\": 0}'), (3, NULL), (4, NULL), (5, '[1, [2, 3], {\"z\": 0}]')", c=lambda: F.when(F.col("id") != 1, J.json_concat(D(), F.lit('{"z": 0}'))))
json_rows("js12_set_insert", "(1, NULL, NULL), (2, '{\"n\": 1, \"new\": true}', '{\"n\": 1}'), (3, NULL, NULL), (4, NULL, NULL), (5, '[1, [2, 3]]', '[1, [2, 9, 3]]')", s=lambda: F.when(F.col("id") != 1, J.json_set(D(), ["new"], True)), i=lambda: F.when(F.col("id") != 1, J.json_insert(D(), ["1", "1"], 9)))
json_rows("js13_strip_typeof", "(1, FALSE, 'object'), (2, FALSE, 'object'), (3, NULL, NULL), (4, NULL, NULL), (5, FALSE, 'array')", s=lambda: F.contains(J.json_strip_nulls(D()), F.lit("null")), t=lambda: J.json_typeof(D()))
json_rows("js15_length_pretty", "(1, NULL, TRUE), (2, NULL, TRUE), (3, NULL, NULL), (4, NULL, NULL), (5, 2, TRUE)", n=lambda: F.json_array_length(D()), p=lambda: F.contains(J.json_pretty(D()), F.lit("\n")))
json_rows("js20_path", "(1, '20,{\"c\": \"x\"}', '2', '[10, 20, {\"c\": \"x\"}]'), (2, '', '', NULL), (3, NULL, NULL, NULL), (4, NULL, NULL, NULL), (5, '', '', NULL)", last=lambda: F.array_join(J.path_query(D(), "$.a.b[1 to last]"), ","), size=lambda: F.array_join(J.path_query(D(), "$.tags.size()"), ","), first=lambda: J.path_query_first(D(), "$..b"))
json_rows("js21_filter_vars", "(1, '20'), (2, ''), (3, NULL), (4, NULL), (5, '')", q=lambda: F.array_join(J.path_query(D(), "$.a.b[*] ? (@ > $min && @ < 100)", {"min": 15}), ","))
both("js07_delete_key", "SELECT event_id, to_json(map_filter(from_json(props, 'map<string,variant>'), (k, v) -> k <> 'k')) AS j FROM events", "SELECT event_id, '{}' AS j FROM events")
both(
    "js07_delete_typed",
    "SELECT o_orderkey, to_json(map_filter(from_json(to_json(named_struct('k', o_orderpriority, 'n', o_custkey, 'o', named_struct('z', o_orderstatus, 't', o_orderkey % 2 = 0))), 'map<string,variant>'), (k, v) -> k <> 'k')) AS j FROM orders",
    "SELECT o_orderkey, CAST(json_object('n', o_custkey, 'o', json_object('t', o_orderkey % 2 = 0, 'z', o_orderstatus)) AS VARCHAR) AS j FROM orders",
)
both("js09_build", "SELECT r_regionkey, to_json(named_struct('k', r_regionkey, 'name', r_name)) AS o, to_json(array(r_regionkey, 1)) AS a FROM region", "SELECT r_regionkey, CAST(json_object('k', r_regionkey, 'name', r_name) AS VARCHAR) AS o, CAST(json_array(r_regionkey, 1) AS VARCHAR) AS a FROM region")
edge("js10_null_on_null", "SELECT id, to_json(named_struct('l', label), map('ignoreNullFields', 'false')) AS n FROM EDGE", "SELECT id, CAST(json_object('l', label) AS VARCHAR) AS n FROM EDGE")
edge("js11_value", "SELECT id, get_json_object(payload, '$.kind') AS k, CAST(get_json_object(payload, '$.n') AS BIGINT) AS n FROM EDGE", "SELECT id, json_extract_string(payload, '$.kind') AS k, CAST(json_extract_string(payload, '$.n') AS BIGINT) AS n FROM EDGE")
both("js17_elements", "SELECT explode(from_json('[1, 2, 3]', 'array<int>')) AS e", "SELECT unnest([1, 2, 3]) AS e")
edge("js18_keys", "SELECT id, k FROM (SELECT id, explode(json_object_keys(payload)) AS k FROM EDGE)", "SELECT id, unnest(json_keys(payload)) AS k FROM EDGE")
edge("js19_each", "SELECT id, key, value FROM (SELECT id, explode(from_json(payload, 'map<string,string>')) AS (key, value) FROM EDGE)", "SELECT id, key, json_extract_string(payload, key) AS value FROM (SELECT id, payload, unnest(json_keys(payload)) AS key FROM EDGE)")
both("js22_json_table", """SELECT CAST(pos + 1 AS BIGINT) AS i, x.id, coalesce(x.name, 'none') AS name, t AS tag FROM (SELECT posexplode(from_json('[{"id": 1, "name": "a", "tags": ["x", "y"]}, {"id": 2, "tags": ["z"]}, {"id": 3, "name": "c", "tags": []}]', 'array<struct<id:int,name:string,tags:array<string>>>')) AS (pos, x)) LATERAL VIEW explode(x.tags) e AS t""", "SELECT * FROM (VALUES (1::BIGINT, 1, 'a', 'x'), (1, 1, 'a', 'y'), (2, 2, 'none', 'z')) AS t(i, id, name, tag)")
edge("js23_to_record", "SELECT id, r.kind, r.n FROM (SELECT id, from_json(payload, 'kind string, n int') AS r FROM EDGE)", "SELECT id, json_extract_string(payload, '$.kind') AS kind, CAST(json_extract_string(payload, '$.n') AS INTEGER) AS n FROM EDGE")


_order_doc = "to_json(named_struct('k', o_custkey, 's', o_orderstatus, 'p', named_struct('q', o_orderpriority)))"


@plan("SELECT o_orderkey, o_custkey::INTEGER AS k, 'none' AS missing, CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'O' THEN -1 WHEN 'P' THEN -1 END AS bad, 'not scalar' AS deep, o_orderpriority AS q FROM orders")
def js11_value_clauses(spark, sf_dir):
    """JSON_VALUE with RETURNING, ON EMPTY and ON ERROR."""
    d = F.expr(_order_doc)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", Q.json_value(d, "$.k", "int", on_error=Q.ERROR).alias("k"), Q.json_value(d, "$.x", on_empty="none").alias("missing"), Q.json_value(d, "$.s", "int", on_error=-1).alias("bad"), Q.json_value(d, "$.p", on_error="not scalar").alias("deep"), Q.json_value(d, "strict $.p.q").alias("q")
    )


@plan("""SELECT r_name, '[' || string_agg(n_nationkey, ', ' ORDER BY n_nationkey) || ']' AS bare, '[[' || string_agg(n_nationkey, ', ' ORDER BY n_nationkey) || ']]' AS wrapped, '[' || string_agg(n_nationkey, ', ' ORDER BY n_nationkey) || ']' AS each, '{}' AS nothing, NULL AS missing,
  '{"r": "' || r_name || '", "ns": [' || string_agg(n_nationkey, ', ' ORDER BY n_nationkey) || ']}' AS whole FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def js11_query(spark, sf_dir):
    """JSON_QUERY with and without WRAPPER and ON EMPTY, and JSON_SERIALIZE."""
    docs = sql(spark, sf_dir, "SELECT r_name, to_json(named_struct('ns', array_sort(collect_list(n_nationkey)), 'r', r_name)) AS d FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
    d = F.col("d")
    return docs.select("r_name", Q.json_query(d, "$.ns").alias("bare"), Q.json_query(d, "$.ns", True).alias("wrapped"), Q.json_query(d, "$.ns[*]").alias("each"), Q.json_query(d, "$.x", on_empty="{}").alias("nothing"), Q.json_query(d, "$.x").alias("missing"), Q.json_serialize(d).alias("whole"))


@plan("SELECT o_orderkey, o_orderstatus <> 'O' AS any_key, o_orderstatus = 'F' AS all_keys FROM orders")
def js04_any_keys(spark, sf_dir):
    """?| and ?&."""
    docs = sql(spark, sf_dir, "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '{\"a\": 1, \"b\": null}' WHEN 'O' THEN '{\"c\": {\"a\": 1}}' ELSE '[\"b\", 2]' END AS d FROM orders")
    return docs.select("o_orderkey", J.has_any_key(F.col("d"), "a", "b").alias("any_key"), J.has_all_keys(F.col("d"), "a", "b").alias("all_keys"))


@plan("""SELECT p_partkey, '{"name":"' || p_name || '","brand":null}' AS n, '{"name":"' || p_name || '"}' AS a, '[' || p_size || ',"' || p_name || '",true]' AS absent, '[' || p_size || ',null,"' || p_name || '",true]' AS kept FROM part""")
def js10_constructors(spark, sf_dir):
    """JSON_OBJECT and JSON_ARRAY with NULL and ABSENT ON NULL."""
    none = F.lit(None).cast("string")
    items = F.col("p_size"), none, F.col("p_name"), F.lit(True)
    return table(spark, sf_dir, "part").select(
        "p_partkey", Q.json_object(name=F.col("p_name"), brand=none).alias("n"), Q.json_object(absent_on_null=True, unique_keys=True, name=F.col("p_name"), brand=none).alias("a"), Q.json_array(*items).alias("absent"), Q.json_array(*items, null_on_null=True).alias("kept")
    )


@plan("""SELECT r_regionkey, r_name AS name, 'none' AS note, TRUE AS has, dense_rank() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS no, n_nationkey AS id, n_name AS nation, -1 AS number, '{"nk": ' || n_nationkey || ', "nn": "' || n_name || '"}' AS item, x AS tag
FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('s'), ('t')) AS t(x)""")
def js22_table_operator(spark, sf_dir):
    """JSON_TABLE over stored documents: paths, ordinality, EXISTS, defaults, FORMAT JSON, nested and sibling columns."""
    regions = sql(spark, sf_dir, "SELECT r_regionkey, to_json(named_struct('r', r_name, 'ns', array_sort(collect_list(named_struct('nk', n_nationkey, 'nn', n_name))), 'tags', array('s', 't'))) AS d FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
    nations = Q.Nested("$.ns[*]", (Q.Ordinality("no"), Q.Item("id", "int", "$.nk"), Q.Item("nation", "string", "$.nn"), Q.Item("number", "int", "$.nn", on_error=-1), Q.Item("item", "json", "$")))
    rows = Q.json_table(regions, F.col("d"), "$", Q.Item("name", path="$.r"), Q.Item("note", on_empty="none"), Q.Exists("has", "$.ns[0]"), nations, Q.Nested("$.tags[*]", (Q.Item("tag", path="$"),)))
    return rows.drop("d")


# X: statements as DataFrames.
@plan("SELECT n_nationkey AS r_regionkey, coalesce(nullif(n_name, 'CHINA'), 'unnamed') AS r_name, upper(n_name) AS up FROM nation WHERE n_regionkey = 2")
def x01_returning(spark, sf_dir):
    """INSERT ... SELECT ... RETURNING."""
    rows = sql(spark, sf_dir, "SELECT n_nationkey AS r_regionkey, coalesce(nullif(n_name, 'CHINA'), 'unnamed') AS r_name, upper(n_name) AS up FROM nation WHERE n_regionkey = 2")
    target = table(spark, sf_dir, "region").withColumn("up", F.lit("-"))
    return R.insert_returning(target, rows, [F.col("r_regionkey"), F.col("r_name"), F.col("up")]).returning


@plan("SELECT c_custkey, round(c_acctbal * 2, 2) AS doubled FROM customer WHERE c_mktsegment = 'BUILDING'")
def x03_returning(spark, sf_dir):
    """UPDATE ... RETURNING the new values."""
    change = R.update_returning(table(spark, sf_dir, "customer"), {"c_acctbal": F.col("c_acctbal") * 2}, F.col("c_mktsegment") == "BUILDING", [F.col("c_custkey"), F.round("c_acctbal", 2).alias("doubled")])
    return change.returning


@plan("SELECT o_orderkey, 'high' AS why FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_orderkey, 'customer' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def x04_returning(spark, sf_dir):
    """DELETE ... RETURNING and DELETE ... USING ... RETURNING the rows that went."""
    orders = table(spark, sf_dir, "orders")
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    high = R.delete_returning(orders, F.col("o_totalprice") > 300000, [F.col("o_orderkey"), F.lit("high").alias("why")])
    return high.returning.unionByName(R.delete_using_returning(orders, poor, ["o_custkey"], [F.col("o_orderkey"), F.lit("customer").alias("why")]).returning)


@plan("SELECT r_regionkey, r_name FROM region UNION ALL VALUES (9, 'new'), (10, 'none')")
def x01_insert(spark, sf_dir):
    rows = literal(spark, "(9, 'new')", "r_regionkey, r_name")
    return R.insert_rows(R.insert_rows(table(spark, sf_dir, "region"), rows), literal(spark, "(10)", "r_regionkey"), {"r_name": F.lit("none")})


@plan("SELECT r_regionkey, r_name FROM region UNION ALL VALUES (9, 'new')")
def x02_do_nothing(spark, sf_dir):
    return R.insert_missing(table(spark, sf_dir, "region"), literal(spark, "(1, 'again'), (9, 'new')", "r_regionkey, r_name"), ["r_regionkey"])


@plan("SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN r_name || '+again' ELSE r_name END AS r_name FROM region UNION ALL VALUES (9, 'new')")
def x02_do_update(spark, sf_dir):
    rows = literal(spark, "(1, 'again'), (2, 'no'), (9, 'new')", "r_regionkey, r_name")
    return R.upsert(table(spark, sf_dir, "region"), rows, ["r_regionkey"], {"r_name": lambda was, new: F.concat(was, F.lit("+"), new)}, lambda old, new: F.col("new.r_name") != "no")


@plan("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def x03_update(spark, sf_dir):
    return R.update_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), {"c_acctbal": F.col("c_acctbal") + 1}, F.col("c_mktsegment") == "BUILDING").drop("c_mktsegment")


@plan("SELECT n_nationkey, coalesce(r_name, n_name) AS n_name FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
def x03_update_from(spark, sf_dir):
    source = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_nationkey")
    return R.update_from(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), source, ["n_nationkey"], {"n_name": F.col("r_name")})


@plan("SELECT o_orderkey FROM orders WHERE o_totalprice <= 100000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def x04_delete(spark, sf_dir):
    orders = R.delete_rows(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 100000)
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return R.delete_using(orders, gone, ["o_custkey"]).select("o_orderkey")


@plan("SELECT r_regionkey, r_name FROM region WHERE FALSE")
def x05_truncate(spark, sf_dir):
    return table(spark, sf_dir, "region").limit(0)


both("x06_generated", "SELECT n_nationkey, concat(n_name, '/', n_regionkey) AS made FROM nation")


@plan("SELECT r_regionkey AS region_key, 0 AS added FROM region")
def x10_alter(spark, sf_dir):
    return table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "region_key").withColumn("added", F.lit(0)).drop("r_name")


@plan(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")))
def x14_analyze(spark, sf_dir):
    return R.profile(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


both("x17_parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = :status AND o_orderkey < :top", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey < 300", {"status": "F", "top": 300})


@plan("SELECT n_nationkey, n_nationkey * 3 + 1 AS y FROM nation")
def ud01_sql_function(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION thrice_plus(x INT) RETURNS INT RETURN x * 3 + 1")
    return sql(spark, sf_dir, "SELECT n_nationkey, thrice_plus(n_nationkey) AS y FROM nation")


# Operators that share a query above, each with one of its own.
both("s03_column_chunks", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 1")
edge("a12_ordered_inputs", "SELECT group_id, listagg(id, ',') WITHIN GROUP (ORDER BY value DESC NULLS LAST, id) AS last, listagg(id, ',') WITHIN GROUP (ORDER BY value ASC NULLS FIRST, id) AS first FROM EDGE GROUP BY group_id", "SELECT group_id, string_agg(id, ',' ORDER BY value DESC NULLS LAST, id) AS last, string_agg(id, ',' ORDER BY value ASC NULLS FIRST, id) AS first FROM EDGE GROUP BY group_id")
both("a13_hash_group", "SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey")
both("a20_column_aggregates", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(l_partkey) AS BIGINT) AS s, min(l_orderkey) AS a, max(l_orderkey) AS b, round(avg(l_suppkey), 6) AS m, CAST(count(DISTINCT l_partkey) AS BIGINT) AS d, min(l_returnflag) AS t, max(l_linestatus) AS u FROM lineitem")
both("a21_grouping_statistics", "SELECT p_brand, CAST(grouping(p_brand) AS BIGINT) AS g, round(stddev_samp(p_size), 6) AS sd, round(corr(p_size, p_retailprice), 6) AS c, percentile_cont(0.5) WITHIN GROUP (ORDER BY p_size) AS med FROM part GROUP BY ROLLUP (p_brand)")
P = "OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority)"
both("w02_rank", f"SELECT o_orderkey, CAST(rank() {P} AS BIGINT) AS r FROM orders")
both("w03_dense_rank", f"SELECT o_orderkey, CAST(dense_rank() {P} AS BIGINT) AS r FROM orders")
both("w05_cume_dist", f"SELECT o_orderkey, round(cume_dist() {P}, 9) AS c FROM orders")
both("w06_ntile", f"SELECT o_orderkey, CAST(ntile(4) {W} AS BIGINT) AS t FROM orders")
both("w09_last_value", f"SELECT o_orderkey, last_value(o_orderkey) {W} AS to_here, last_value(o_orderkey) {W.replace(')', ' ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')} AS whole FROM orders")
both("w10_nth_value", f"SELECT o_orderkey, nth_value(o_orderkey, 3) {W} AS third FROM orders")
both("w16_range_offset", "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events")
both("w18_named_window", "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, round(max(o_totalprice) OVER w, 2) AS m FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
both("w19_conditional_window", "SELECT o_orderkey, CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER (PARTITION BY o_custkey) AS BIGINT) AS done, CAST(size(collect_set(o_orderpriority) OVER (PARTITION BY o_custkey)) AS BIGINT) AS kinds FROM orders", "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS done, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS kinds FROM orders")
both("t03_top_k_expression", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem ORDER BY l_extendedprice * (1 - l_discount) DESC NULLS FIRST, l_orderkey, l_linenumber LIMIT 15")
both("t05_limit", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT l_orderkey FROM lineitem LIMIT 100)")
both("st02_length", "SELECT n_nationkey, CAST(length(n_name) AS BIGINT) AS a, CAST(char_length(n_name) AS BIGINT) AS b, CAST(character_length('h\u00e9llo') AS BIGINT) AS c FROM nation", "SELECT n_nationkey, length(n_name) AS a, length(n_name) AS b, length('h\u00e9llo') AS c FROM nation")
edge("st06_concat_ws", "SELECT id, concat_ws('-', label, CAST(id AS STRING), NULL) AS w, concat_ws(NULL, 'a', 'b') AS n FROM EDGE", "SELECT id, concat_ws('-', label, CAST(id AS VARCHAR), NULL) AS w, concat_ws(NULL, 'a', 'b') AS n FROM EDGE")
both("st09_left_right", "SELECT p_partkey, left(p_name, 4) AS l, right(p_name, 4) AS r FROM part")
both("st10_reverse", "SELECT n_nationkey, reverse(n_name) AS r FROM nation")
both("st11_position", "SELECT n_nationkey, CAST(position('AN' IN n_name) AS BIGINT) AS p, CAST(position('zz' IN n_name) AS BIGINT) AS z FROM nation")
both("m02_round", "SELECT o_orderkey, round(2.5) AS a, round(-2.5) AS b, round(o_totalprice, -2) AS c FROM orders", "SELECT o_orderkey, round(2.5) AS a, round(-2.5) AS b, round(o_totalprice, -2) AS c FROM orders")
both("m03_floor_ceil", "SELECT c_custkey, CAST(floor(-c_acctbal) AS BIGINT) AS f, CAST(ceiling(c_acctbal) AS BIGINT) AS c FROM customer")
both("m05_sqrt", "SELECT p_partkey, round(sqrt(p_size), 9) AS s FROM part")
both("m06_mod", "SELECT n_nationkey, CAST(mod(n_nationkey, 7) AS BIGINT) AS m, CAST(-n_nationkey % 5 AS BIGINT) AS s FROM nation")
both("m08_log", "SELECT p_partkey, round(log10(p_size), 9) AS t, round(log(2, p_size), 9) AS b FROM part")
both("m09_pi_random", "SELECT round(pi(), 12) AS p, rand() < 1 AND rand() >= 0 AS r", "SELECT round(pi(), 12) AS p, random() < 1 AND random() >= 0 AS r")
both("m11_arithmetic", "SELECT p_partkey, p_size + 3 AS a, p_size - 3 AS s, p_size * 3 AS m, p_size div 3 AS d, p_size % 3 AS r, -p_size AS n, round(p_retailprice / p_size, 6) AS q FROM part", "SELECT p_partkey, p_size + 3 AS a, p_size - 3 AS s, p_size * 3 AS m, CAST(p_size // 3 AS BIGINT) AS d, p_size % 3 AS r, -p_size AS n, round(p_retailprice / p_size, 6) AS q FROM part")
both("n04_sequence", "SELECT CAST(count(DISTINCT id) AS BIGINT) AS n, min(id) >= 100 AS from_start FROM (SELECT monotonically_increasing_id() + 100 AS id FROM orders)", "SELECT count(*) AS n, TRUE AS from_start FROM orders")
both("dt05_make_timestamp", "SELECT n_nationkey, make_timestamp_ntz(2024, 2, 29, n_nationkey % 24, 59, 1.25) AS t FROM nation", "SELECT n_nationkey, make_timestamp(2024, 2, 29, n_nationkey % 24, 59, 1.25) AS t FROM nation")
both("dt08_date_interval", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP_NTZ) + INTERVAL '1' MONTH AS a, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP_NTZ) - INTERVAL '90' MINUTE AS b FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL '1' MONTH AS a, CAST(o_orderdate AS DATE) - INTERVAL '90' MINUTE AS b FROM orders")
both("dt10_date_difference", "SELECT o_orderkey, CAST(datediff(CAST(o_orderdate AS DATE), DATE '1995-06-17') AS BIGINT) AS n FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1995-06-17' AS n FROM orders")
both("dt12_interval_builders", "SELECT event_id, ts + make_dt_interval(1, 2, 3, 4.5) AS a, ts + make_ym_interval(1, 2) AS b FROM events", "SELECT event_id, ts + INTERVAL '1 day 2 hours 3 minutes 4.5 seconds' AS a, ts + INTERVAL '14 months' AS b FROM events")
both("ar02_array_length", "SELECT p_partkey, CAST(size(split(p_type, ' ')) AS BIGINT) AS n, CAST(size(array(array(1, 2, 3), array(4, 5, 6))[0]) AS BIGINT) AS inner_n FROM part", "SELECT p_partkey, len(string_split(p_type, ' ')) AS n, len([[1, 2, 3], [4, 5, 6]][1]) AS inner_n FROM part")
both("ar03_cardinality", "SELECT n_nationkey, CAST(size(flatten(array(array(1, n_nationkey), array(3)))) AS BIGINT) AS n FROM nation", "SELECT n_nationkey, len(flatten([[1, n_nationkey], [3]])) AS n FROM nation")
both("ar04_append_prepend", "SELECT n_nationkey, array_join(array_append(array(1, 2), n_nationkey), ',') AS a, array_join(array_prepend(array(1, 2), n_nationkey), ',') AS p FROM nation", "SELECT n_nationkey, array_to_string(list_append([1, 2], n_nationkey), ',') AS a, array_to_string(list_prepend(n_nationkey, [1, 2]), ',') AS p FROM nation")
both("ar05_array_cat", "SELECT p_partkey, array_join(concat(split(p_type, ' '), array(p_brand)), '|') AS a FROM part", "SELECT p_partkey, array_to_string(list_concat(string_split(p_type, ' '), [p_brand]), '|') AS a FROM part")
both("ar07_array_to_string", "SELECT n_nationkey, array_join(array(n_name, NULL, 'z'), ',') AS a, array_join(array(n_name, NULL, 'z'), ',', '*') AS b FROM nation", "SELECT n_nationkey, concat_ws(',', n_name, 'z') AS a, concat_ws(',', n_name, '*', 'z') AS b FROM nation")
json_rows("js14_typeof", "(1, 'object', 'array'), (2, 'object', NULL), (3, NULL, NULL), (4, NULL, NULL), (5, 'array', NULL)", t=lambda: J.json_typeof(D()), tags=lambda: J.json_typeof(J.json_get(D(), "tags")))
json_rows("js24_subscript_update", "(1, '[1]'), (2, NULL), (3, NULL), (4, NULL), (5, NULL)", s=lambda: J.json_get(J.json_set(D(), S.json_path_of("doc['a']['b']"), [1]), "a", "b"))


@plan("SELECT n_nationkey, nullif(list_position([3, 5, 7], n_nationkey), 0)::BIGINT AS p FROM nation")
def ar06_array_position(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", S.array_position(F.array(F.lit(3), F.lit(5), F.lit(7)), F.col("n_nationkey")).cast("bigint").alias("p"))


@plan("SELECT event_id, make_timestamp((epoch_us(ts) + 500) // 1000 * 1000) AS ms, make_timestamp((epoch_us(ts) + 500000) // 1000000 * 1000000) AS s FROM events")
def dt13_timestamp_precision(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.round_to(F.col("ts"), 3).alias("ms"), T.round_to(F.col("ts"), 0).alias("s"))


@plan("""SELECT n_nationkey, '"' || n_name || '"' AS q, '"a""b"' AS c FROM nation""")
def st13_quote_ident(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", S.quote_ident(F.col("n_name")).alias("q"), S.quote_ident(F.lit('a"b')).alias("c"))


@plan("SELECT p_partkey, nullif(regexp_extract(p_name, '[a-e]+'), '') AS first, list_extract(regexp_extract_all(p_name, '[a-e]+'), 2) AS second FROM part")
def st16_regexp_substr(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT p_partkey, regexp_substr(p_name, '[a-e]+') AS first, try_element_at(regexp_extract_all(p_name, '[a-e]+', 0), 2) AS second FROM part")


@plan("SELECT * FROM (VALUES (1, '10.0.0.1'), (2, NULL), (3, '10.0.0.0/8'), (4, NULL), (5, NULL)) AS t(id, a)")
def n06_inet(spark, sf_dir):
    return literal(spark, "(1, '10.0.0.1'), (2, '256.1.1.1'), (3, '10.0.0.0/8'), (4, '1.2.3'), (5, NULL)", "id, s").select("id", S.inet(F.col("s")).alias("a"))


@plan("SELECT event_id, '{\n    \"k\": ' || (props->>'k') || '\n}' AS p FROM events")
def js16_pretty(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", J.json_pretty(F.col("props")).alias("p"))


@plan("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def s13_insert_sink(spark, sf_dir):
    path = C.staging_path(spark, "insert")
    sql(spark, sf_dir, "SELECT r_regionkey, r_name FROM region").write.parquet(path)
    sql(spark, sf_dir, "SELECT n_nationkey AS r_regionkey, n_name AS r_name FROM nation WHERE n_regionkey = 1").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@plan("SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def x07_replace_view(spark, sf_dir):
    sql(spark, sf_dir, "SELECT n_nationkey FROM nation WHERE n_regionkey = 1").createOrReplaceTempView("some_nations")
    sql(spark, sf_dir, "SELECT n_nationkey FROM nation WHERE n_regionkey = 2").createOrReplaceTempView("some_nations")
    out = spark.table("some_nations")
    spark.catalog.dropTempView("some_nations")
    return out


@plan("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 10 AND 20")
def x08_index_layout(spark, sf_dir):
    """An index as layout: rows dealt and sorted by the key, so that files and row groups are skipped by their statistics."""
    path = C.staging_path(spark, "indexed")
    sql(spark, sf_dir, "SELECT o_orderkey, o_custkey FROM orders").repartitionByRange("o_custkey").sortWithinPartitions("o_custkey").write.parquet(path)
    return spark.read.parquet(path).filter("o_custkey BETWEEN 10 AND 20")


@plan("SELECT 'Comment' AS info_name, 'more' AS info_value")
def x11_schema_comment(spark, sf_dir):
    spark.sql("CREATE SCHEMA IF NOT EXISTS lakequill_demo")
    spark.sql("COMMENT ON SCHEMA lakequill_demo IS 'more'")
    out = spark.sql("DESCRIBE SCHEMA lakequill_demo").filter("info_name = 'Comment'").collect()
    spark.sql("DROP SCHEMA lakequill_demo CASCADE")
    return spark.createDataFrame(out, "info_name string, info_value string")


@plan("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS place FROM orders")
def x09_enum_type(spark, sf_dir):
    """CREATE TYPE ... AS ENUM: a label's place in the declared order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", S.enum_place(F.col("o_orderstatus"), ["F", "O", "P"]).alias("place"))


@plan("SELECT 'r_regionkey' AS col_name, 'int' AS data_type UNION ALL SELECT 'r_name', 'string'")
def x13_describe(spark, sf_dir):
    return sql(spark, sf_dir, "DESCRIBE QUERY SELECT r_regionkey, r_name FROM region").select("col_name", "data_type")


@plan("SELECT p_partkey, p_size * 2 + 1 AS y FROM part")
def ud02_python_function(spark, sf_dir):
    twice = F.pandas_udf(lambda x: x * 2 + 1, "int")
    return table(spark, sf_dir, "part").select("p_partkey", twice("p_size").alias("y"))


@plan("SELECT p_brand, round(exp(avg(ln(p_size))), 6) AS g FROM part GROUP BY p_brand")
def ud03_custom_aggregate(spark, sf_dir):
    """An aggregate of one's own, made of built-in ones, which combine before the shuffle."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(A.geometric_mean(F.col("p_size")), 6).alias("g"))


@plan("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def ud04_table_function(spark, sf_dir):
    class Words:
        def eval(self, text: str):
            for word in (text or "").split(" "):
                yield (word,)

    spark.udtf.register("words_of", F.udtf(Words, returnType="word string"))
    return sql(spark, sf_dir, "SELECT p_partkey, w.word FROM part, LATERAL words_of(p_type) AS w")


@plan("SELECT n_nationkey, E'tab\\there' || n_name AS e, '1011' AS b, 11 AS n, '10:20:30.5' AS t, 12345678901234567890::DECIMAL(20, 0) AS big FROM nation")
def f22_more_literals(spark, sf_dir):
    """E'', B'', TIME and integers beyond 64 bits: escapes, bits as text and number, a time of day as that of day 0, a decimal."""
    return sql(spark, sf_dir, "SELECT n_nationkey, 'tab\\there' || n_name AS e, bin(conv('1011', 2, 10)) AS b, CAST(conv('1011', 2, 10) AS INT) AS n, date_format(TIMESTAMP_NTZ '1970-01-01 10:20:30.5', 'HH:mm:ss.S') AS t, CAST(12345678901234567890 AS DECIMAL(20, 0)) AS big FROM nation")


@plan("SELECT o_orderkey, 100 + 5 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS id, 100 + 5 * (count(*) OVER () - 1) AS last FROM orders")
def n04_nextval(spark, sf_dir):
    """nextval by order of the key and currval after it, with START and INCREMENT."""
    ids = TB.nextval(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey").asc()], "id", 100, 5)
    return ids.crossJoin(F.broadcast(TB.currval(ids, "id").withColumnRenamed("currval", "last")))  # one row


@plan("SELECT o_orderkey, unnest(['f', 'k', 'p']) AS key, unnest([CAST(o_orderkey % 2 = 0 AS VARCHAR), CAST(o_custkey AS VARCHAR), '{\"q\":\"' || o_orderpriority || '\"}']) AS value FROM orders")
def js19_each_json(spark, sf_dir):
    """json_each: values keep their JSON types."""
    return sql(spark, sf_dir, "SELECT o_orderkey, key, to_json(value) AS value FROM orders, LATERAL explode(from_json(to_json(named_struct('k', o_custkey, 'f', o_orderkey % 2 = 0, 'p', named_struct('q', o_orderpriority))), 'map<string,variant>')) AS t(key, value)")


@plan("SELECT c_custkey AS id, c_name AS name, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, round(c_acctbal * 100)::BIGINT AS cents, 'new' AS state FROM customer WHERE c_acctbal > 0 UNION ALL SELECT -1, 'x', 'none', 0, 'old'")
def x06_constraints(spark, sf_dir):
    """CREATE TABLE with NOT NULL, PRIMARY KEY, UNIQUE, CHECK, DEFAULT, GENERATED and a domain; INSERT keeps them."""
    cents = TB.Domain("cents", "bigint", lambda v: v >= 0)
    made = TB.Table(
        (TB.Field("id", "bigint"), TB.Field("name", "string", not_null=True), TB.Field("raw", "string"), TB.Field("segment", "string", generated="coalesce(raw, 'none')"), TB.Field("cents", cents, F.lit(0)), TB.Field("state", "string", F.lit("new"))),
        primary_key=("id",),
        unique=(("name",),),
        checks={"known_state": "state IN ('new', 'old')", "short": "length(name) < 100"},
    )
    first = made.insert(made.empty(spark), spark.createDataFrame([(-1, "x", "old")], "id bigint, name string, state string"))
    rows = sql(spark, sf_dir, "SELECT c_custkey AS id, c_name AS name, nullif(c_mktsegment, 'BUILDING') AS raw, round(c_acctbal * 100) AS cents FROM customer WHERE c_acctbal > 0")
    return made.insert(first, rows).drop("raw")


@plan("SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = 'building' AND c_nationkey BETWEEN 5 AND 9")
def x08_expression_index(spark, sf_dir):
    """A UNIQUE index on an expression and two columns, as layout."""
    customer = sql(spark, sf_dir, "SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer")
    made = TB.index_layout(customer, C.staging_path(spark, "index"), {"segment": F.lower("c_mktsegment"), "c_nationkey": F.col("c_nationkey"), "c_custkey": F.col("c_custkey")}, unique=True)
    return made.filter("segment = 'building' AND c_nationkey BETWEEN 5 AND 9").select("c_custkey", "c_name")


@plan("SELECT p_partkey, p_size AS size FROM part")
def x09_domain(spark, sf_dir):
    """CREATE DOMAIN ... CHECK, as a cast."""
    return table(spark, sf_dir, "part").select("p_partkey", TB.Domain("size", "int", lambda v: v.between(1, 1000), True).cast(F.col("p_size")).alias("size"))


@plan("SELECT 'k' AS col_name, 'the key' AS comment UNION ALL SELECT 'n', 'its name'")
def x11_column_comment(spark, sf_dir):
    """COMMENT ON COLUMN, on a view's columns."""
    table(spark, sf_dir, "region").createOrReplaceTempView("region")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW commented (k COMMENT 'the key', n COMMENT 'its name') AS SELECT r_regionkey, r_name FROM region")
    return spark.sql("DESCRIBE TABLE commented").select("col_name", "comment")


@plan("SELECT 'restrict' AS how, FALSE AS dropped UNION ALL SELECT 'cascade', TRUE")
def x11_drop_restrict(spark, sf_dir):
    """DROP SCHEMA refuses one that holds something, unless it cascades."""
    spark.sql("CREATE SCHEMA IF NOT EXISTS lakequill_full")
    spark.sql("CREATE OR REPLACE VIEW lakequill_full.one AS SELECT 1 AS one")
    done = []
    for how in ("restrict", "cascade"):
        try:
            spark.sql(f"DROP SCHEMA lakequill_full {how}")
        except AnalysisException:
            done.append((how, False))
        else:
            done.append((how, True))
    return spark.createDataFrame(done, "how string, dropped boolean")


@plan("SELECT 'Asia/Tokyo' AS zone, 'default' AS schema, 9 AS hours")
def x13_set_show(spark, sf_dir):
    """SET, SHOW and USE: a session's settings, on a session of their own."""
    own = spark.newSession()
    own.sql("SET TIME ZONE 'Asia/Tokyo'")
    own.sql("USE default")
    row = own.sql("SELECT current_timezone() AS zone, current_schema() AS schema, hour(CAST(TIMESTAMP '2024-01-01 00:00:00 UTC' AS TIMESTAMP_NTZ)) AS hours").collect()
    return spark.createDataFrame(row, "zone string, schema string, hours int")
