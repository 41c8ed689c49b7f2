"""Edge cases of the operators on small tables."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakequill.functions import jsonpath as J
from lakequill.functions import scalars as S
from lakequill.functions import sqljson as Q
from lakequill.functions import temporal as T
from lakequill.operators import relational as R
from lakequill.operators import tables as TB
from lakequill.operators.ordering import asc, desc
from lakequill.operators.windows import global_ranks, over_groups


def values(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_null_order(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, v int")
    assert values(df.orderBy(asc("v")), "id") == [(1,), (3,), (2,)]
    assert values(df.orderBy(desc("v")), "id") == [(2,), (3,), (1,)]


@pytest.mark.parametrize(("op", "rows", "all_", "any_"), [("<", [], True, False), ("<", [5, None], None, True), (">", [5, None], False, None), ("<=", [3, 9], True, True), (">=", [None], None, None), (">", [1, 2], True, True), (">", [1, 5], False, True)])
def test_quantified(spark, op, rows, all_, any_):
    df, vs = spark.createDataFrame([(3,)], "x int"), spark.createDataFrame([(r,) for r in rows], "v int")
    assert values(R.compare_all(df, "x", op, vs), "verdict") == [(all_,)]
    assert values(R.compare_any(df, "x", op, vs), "verdict") == [(any_,)]


@pytest.mark.parametrize(("op", "rows", "all_", "any_"), [("=", [], True, False), ("=", [3, 3], True, True), ("=", [3, None], None, True), ("=", [3, 5], False, True), ("=", [5, None], False, None), ("=", [None], None, None), ("<>", [], True, False), ("<>", [5, 7], True, True), ("<>", [3, 5], False, True), ("<>", [3, None], False, None), ("<>", [5, None], None, True), ("<>", [3], False, False)])
def test_quantified_equality(spark, op, rows, all_, any_):
    df, vs = spark.createDataFrame([(3,)], "x int"), spark.createDataFrame([(r,) for r in rows], "v int")
    assert values(R.compare_all(df, "x", op, vs), "verdict") == [(all_,)]
    assert values(R.compare_any(df, "x", op, vs), "verdict") == [(any_,)]
    null = spark.createDataFrame([(None,)], "x int")
    assert values(R.compare_any(null, "x", op, vs), "verdict") == [(None if rows else False,)]
    assert values(R.compare_all(null, "x", op, vs), "verdict") == [(None if rows else True,)]


def test_conflicts_with_nulls_and_repeats(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    rows = spark.createDataFrame([(None, "x"), (None, "x"), (2, "z"), (2, "y"), (1, "b")], "k int, v string")
    assert sorted(values(R.insert_missing(t, rows, ["k"])), key=str) == sorted([(1, "a"), (None, "n"), (None, "x"), (None, "x"), (2, "y")], key=str)
    change = {"v": lambda was, new: F.concat(was, new)}
    assert sorted(values(R.upsert(t, rows.filter("k is null or k = 1"), ["k"], change)), key=str) == sorted([(1, "ab"), (None, "n"), (None, "x"), (None, "x")], key=str)
    with pytest.raises(Exception, match="second time"):
        R.upsert(t, rows, ["k"], change).collect()
    source = spark.createDataFrame([(1, "q"), (1, "p"), (None, "r")], "k int, w string")
    assert sorted(values(R.update_from(t, source, ["k"], {"v": F.col("w")})), key=str) == sorted([(1, "p"), (None, "n")], key=str)


def test_returning(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "k int, v string, n int")
    done = R.insert_returning(t, spark.createDataFrame([(3,)], "k int"), [F.col("k"), F.col("v"), F.col("n").isNull()], {"v": F.lit("new")})
    assert values(done.returning) == [(3, "new", True)] and done.table.count() == 3
    done = R.update_returning(t, {"n": F.col("n") * 10}, F.col("v") == "a", [F.col("k"), F.col("n")])
    assert values(done.returning) == [(1, 10)] and sorted(values(done.table, "n")) == [(2,), (10,)]
    done = R.delete_returning(t, F.col("v") == "a", [F.col("n")])
    assert values(done.returning) == [(1,)] and values(done.table, "k") == [(2,)]
    done = R.delete_using_returning(t, spark.createDataFrame([(2,), (2,)], "k int"), ["k"], [F.col("n")])
    assert values(done.returning) == [(2,)] and values(done.table, "k") == [(1,)]


def test_ranks_without_a_window_of_all_rows(spark):
    rows = [(i, None if i % 7 == 0 else i % 5, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a int, b int")
    got = {r["id"]: (r["r"], r["d"]) for r in global_ranks(df, {"a": desc, "b": asc}, "r", "d").collect()}
    key = {i: (a is not None, -(a or 0), b) for i, a, b in rows}  # descending: nulls first
    distinct = sorted(set(key.values()))
    assert got == {i: (1 + sum(x < k for x in key.values()), 1 + distinct.index(k)) for i, k in key.items()}
    assert global_ranks(df.limit(0), {"a": asc}).count() == 0


def test_extract_fractions(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-05-06 07:08:30.750123' AS t, CAST(NULL AS TIMESTAMP_NTZ) AS n")
    got = df.select(*[T.part(f, F.col("t")).cast("string") for f in ("second", "milliseconds", "microseconds", "minute")], T.part("second", F.col("n")))
    assert values(got) == [("30.750123", "30750.123", "30750123", "8", None)]


def test_groups_frame_against_brute_force(spark):
    rows = [(i, k) for i, k in enumerate([1, 1, 2, 5, 5, 5, 9])]
    got = over_groups(spark.createDataFrame(rows, "id int, k int").withColumn("p", F.lit(0)), ["p"], [asc("k")], -1, 1, n=F.count("*"))
    ks = sorted({k for _, k in rows})
    for i, n in values(got, "id", "n"):
        at = ks.index(rows[i][1])
        assert n == sum(k in ks[max(0, at - 1) : at + 2] for _, k in rows)


def test_range_join_edges(spark):
    p = spark.createDataFrame([(0.0,), (9.999,), (10.0,), (25.0,)], "x double")
    s = spark.createDataFrame([(0.0, 10.0, "a"), (10.0, 25.0, "b"), (7.0, 7.0, "none")], "lo double, hi double, name string")
    assert sorted(values(R.range_join(p, s, "x", "lo", "hi", 4.0), "x", "name")) == [(0.0, "a"), (9.999, "a"), (10.0, "b")]


def test_recursion_ends_on_cycles_and_empty(spark):
    e = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    step = lambda t: t.join(e, t["n"] == e["a"]).select(F.col("b").alias("n"))
    assert sorted(values(R.recursive_union(spark.sql("SELECT 1 AS n"), step))) == [(1,), (2,)]
    assert values(R.recursive_union(spark.sql("SELECT 1 AS n").limit(0), step)) == []


def test_scalars(spark):
    df = spark.createDataFrame([("a.b,c", None)], "s string, n string")
    got = df.select(
        S.regexp_replace_first(F.col("s"), "[.,]", "-"), S.format_text("%s %L", F.col("n"), F.col("n")), S.concat_all(F.col("n"), F.col("s")), S.similar_to(F.col("s"), "a_b%"), S.similar_to(F.col("s"), "a.b"), S.array_position(F.array(F.lit(1)), F.lit(2))
    )
    assert values(got) == [("a-b,c", "<NULL> NULL", "a.b,c", True, False, None)]


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("$.a[*].b", [1, 2]), ("$.a[last]", []), ("$.a[-1].b", [2]), ("$.a.b", [1, 2]), ("$..b", [1, 2]), ("$.a[*] ? (@.b >= 2).b", [2]), ("$.s.type()", ["string"]), ("$.a.size()", [2]),
        ('$.s ? (@ like_regex "^X" flag "i")', ["xy"]), ('$.s ? (@ starts with "x")', ["xy"]), ("$.missing", []), ("$.a[0].b + 4", [5]), ("exists($.s) && !($.a[0].b == 2)", [True]), ("$.n == null", [True]), ("$.a[0 to 1].b", [1, 2]), ("$.o.keyvalue().key", ["k"]),
    ],
)
def test_json_path(path, expected):
    doc = {"a": [{"b": 1}, {"b": 2}], "s": "xy", "n": None, "o": {"k": 0}}
    if path == "$.a[last]":
        expected = [{"b": 2}]
    assert J.Path(path)(doc) == expected


def test_json_changes():
    assert J.set_path({"a": [1, 2]}, ["a", "-1"], 9) == {"a": [1, 9]}
    assert J.set_path({"a": 1}, ["b", "c"], 9) == {"a": 1}
    assert J.set_path([1], ["5"], 9) == [1, 9]
    assert J.delete_path({"a": {"b": 1}}, ["a", "b"]) == {"a": {}}
    assert J.strip_nulls({"a": None, "b": [None, {"c": None}]}) == {"b": [None, {}]}
    assert J.contains([1, [2, 3]], [[3]]) and not J.contains({"a": 1}, {"a": True}) and J.contains([1, 2], 2)
    assert J.dump({"bb": 1, "a": 2, "c": "é"}) == '{"a": 2, "c": "é", "bb": 1}'


def test_statements(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert values(R.delete_rows(t, F.col("v") == "a")) == [(2, None)]
    assert values(R.update_rows(t, {"v": F.lit("z")}, F.col("v") == "a")) == [(1, "z"), (2, None)]
    assert sorted(values(R.insert_missing(t, spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "k int, v string"), ["k"]))) == [(1, "a"), (2, None), (3, "y")]
    got = R.upsert(t, spark.createDataFrame([(2, "x")], "k int, v string"), ["k"], {"v": lambda was, new: new})
    assert sorted(values(got)) == [(1, "a"), (2, "x")]


def test_stream_rollup_matches_batch(spark, tmp_path):
    from lakequill.streaming.rollup import rollup

    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = rollup(stream, "ts", ["event_type"], "value", "1 day", "60 days").writeStream.outputMode("complete").format("memory").queryName("rolled").start()
    try:
        q.processAllAvailable()
        batch = events.groupBy(F.date_trunc("day", "ts").alias("bucket"), "event_type").count()
        assert sorted(values(spark.table("rolled"), "bucket", "event_type", "n")) == sorted(values(batch))
    finally:
        q.stop()


def test_json_changes_of_every_document(spark):
    from lakequill.plans.queries import DOC, documents_of

    doc, docs = F.col("doc"), documents_of(spark)
    more = lambda member: DOC.replace('"n": 5, ', f'"n": 5, {member}, ')
    assert values(docs, "id", J.path_match(doc, "$.n > 3")) == [(1, True), (2, False), (3, None), (4, None), (5, False)]
    assert values(docs, "id", J.json_concat(doc, F.lit('{"z": 0}'))) == [(1, more('"z": 0')), (2, '{"n": 1, "z": 0}'), (3, None), (4, None), (5, '[1, [2, 3], {"z": 0}]')]
    assert values(docs, "id", J.json_set(doc, ["new"], True)) == [(1, more('"new": true')), (2, '{"n": 1, "new": true}'), (3, None), (4, None), (5, "[1, [2, 3]]")]
    assert values(docs, "id", J.json_insert(doc, ["1", "1"], 9)) == [(1, DOC), (2, '{"n": 1}'), (3, None), (4, None), (5, "[1, [2, 9, 3]]")]


def test_json_numbers_keep_their_digits(spark):
    texts = ["12345678901234567890.123", "[1.0, 1e3, -0.5]", "1e400", "NaN", "[Infinity]", "-Infinity", "12345678901234567890"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, d string")
    got = [r[0] for r in df.orderBy("id").select(Q.json_serialize(F.col("d"))).collect()]
    assert got == [texts[0], "[1.0, 1000, -0.5]", "1" + "0" * 400, None, None, None, texts[6]]
    assert J.dump({"b": [], "a": {"x": [1, "é"]}, "c": {}}, True) == '{\n    "a": {\n        "x": [\n            1,\n            "é"\n        ]\n    },\n    "b": [],\n    "c": {}\n}'


def test_json_kinds_and_types(spark):
    rows = [('{"a": 1}', "object"), ("[1]", "array"), ('"x"', "string"), ("1", "number"), ("1.5", "number"), ("1e30", "number"), ("true", "boolean"), ("null", "null"), ("{", None), (None, None)]
    df = spark.createDataFrame(rows, "d string, kind string")
    assert all(r[0] == r[1] for r in df.select("kind", J.json_typeof(F.col("d"))).collect())
    got = df.select(*[J.is_json(F.col("d"), k) for k in ("value", "object", "array", "scalar")]).collect()
    assert [tuple(r) for r in got] == [(None,) * 4 if d is None else (k is not None, k == "object", k == "array", k not in (None, "object", "array")) for d, k in rows]


def test_sql_json_clauses(spark):
    df = spark.createDataFrame([('{"x": 1, "s": "bad", "l": [1, 2], "n": null}',), ("{}",), ("broken",), (None,)], "d string")
    d = F.col("d")
    assert values(df.select(Q.json_value(d, "$.x", "int"), Q.json_value(d, "$.x", on_empty="none"), Q.json_value(d, "$.s", "int", on_error=99), Q.json_value(d, "$.l", on_error="deep"), Q.json_value(d, "$.n", on_empty="e"))) == [(1, "1", 99, "deep", None), (None, "none", None, None, "e"), (None,) * 5, (None,) * 5]
    for bad in (Q.json_value(d, "$.y", on_empty=Q.ERROR), Q.json_value(d, "$.s", "int", on_error=Q.ERROR), Q.json_query(d, "$.y", on_empty=Q.ERROR)):
        with pytest.raises(Exception, match="SQL/JSON"):
            df.select(bad).collect()
    assert values(df.limit(1).select(Q.json_query(d, "$.l[*]"), Q.json_query(d, "$.l", True), Q.json_query(d, "$.x", True), Q.json_query(d, "$.y", on_empty="[]"), Q.json_query(d, "$.n"))) == [("[1, 2]", "[[1, 2]]", "[1]", "[]", "null")]
    with pytest.raises(ValueError, match="duplicate"):
        Q.json_object(unique_keys=True, a=d, A=d)


def test_json_table(spark):
    doc = '{"c": [{"id": 1, "o": [{"k": 10}, {"k": 11, "v": "x"}], "t": ["p", "q"]}, {"id": 2, "o": [], "t": ["p"]}, {"id": null, "o": [{"k": null}], "t": ["r"]}]}'
    df = spark.createDataFrame([(7, doc), (8, None), (9, "{"), (10, '{"c": []}')], "n int, d string")
    columns = (Q.Ordinality("i"), Q.Item("id", "int", on_empty=0), Q.Nested("$.o[*]", (Q.Ordinality("j"), Q.Item("k", "bigint"), Q.Item("v", on_empty="-"), Q.Exists("has", "$.v"))), Q.Nested("$.t[*]", (Q.Item("t", path="$"),)))
    got = Q.json_table(df, F.col("d"), "$.c[*]", *columns).drop("d")
    assert got.columns == ["n", "i", "id", "j", "k", "v", "has", "t"]
    assert sorted(values(got), key=str) == sorted([*[(7, 1, 1, j, k, v, h, t) for j, k, v, h in ((1, 10, "-", False), (2, 11, "x", True)) for t in "pq"], (7, 3, None, 1, None, "-", False, "r")], key=str)
    with pytest.raises(Exception, match="another type"):
        Q.json_table(df, F.col("d"), "$.c[*]", Q.Item("t", "int", "$.t[0]")).collect()


def test_explain_names_the_scan_and_its_filter(spark):
    from lakequill.plans.queries import QUERIES

    lines = [r["line"] for r in QUERIES["s14_explain"](spark, "/root/testdata/sf0.001").collect()]
    assert any("Scan parquet" in x for x in lines) and any("PushedFilters" in x and "LessThan(o_orderkey,100)" in x for x in lines) and any("ReadSchema" in x and "o_orderstatus" in x and "o_totalprice" not in x for x in lines)


def test_session_facts(spark):
    from lakequill.plans.queries import QUERIES

    (row,) = QUERIES["n03_session"](spark, "").collect()
    assert row["version"].startswith(spark.version) and row["database"] == "default" and row["user"]


def test_declared_tables(spark):
    made = TB.Table((TB.Field("id", "int"), TB.Field("v", "string", F.lit("d"), not_null=True), TB.Field("w", "int", generated="length(v)"), TB.Field("p", TB.Domain("pos", "int", lambda x: x > 0))), ("id",), (("p",),), {"short": "w < 4"})
    rows = lambda *r, of="id int, v string, p int": spark.createDataFrame(list(r), of)
    one = made.insert(made.empty(spark), rows((1, "ab", None), (2, "c", 5)))
    two = made.insert(one, rows((3, None), of="id int, p int"))
    assert sorted(values(two)) == [(1, "ab", 2, None), (2, "c", 1, 5), (3, "d", 1, None)]
    for bad, message in (((None, "a", None), "not-null"), ((4, None, None), "not-null"), ((4, "long", None), "short"), ((4, "a", -1), "domain pos"), ((2, "a", None), "unique constraint on id"), ((4, "a", 5), "unique constraint on p")):
        with pytest.raises(Exception, match=message):
            made.insert(two, rows(bad)).collect()


def test_sequences_and_unique_indexes(spark, tmp_path):
    df = spark.createDataFrame([(k,) for k in (5, 1, 9, 3, 7)], "k int")
    ids = TB.nextval(df, [F.col("k").asc()], "id", 10, -2)
    assert sorted(values(ids)) == [(1, 10), (3, 8), (5, 6), (7, 4), (9, 2)]
    assert values(TB.currval(TB.nextval(df.limit(0), [F.col("k").asc()]))) == [(None,)]
    with pytest.raises(Exception, match="unique index"):
        TB.index_layout(df, str(tmp_path / "i"), {"m": F.col("k") % 2}, unique=True)
    stored = TB.index_layout(df, str(tmp_path / "j"), {"m": F.col("k") % 4, "k": F.col("k")})
    assert sorted(values(stored.filter("m = 1"), "k")) == [(1,), (5,), (9,)]


def test_lax_set_and_keys(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null}',), ('["a", 1]',), ('"a"',), (None,)], "d string")
    d = F.col("d")
    assert values(df, J.has_any_key(d, "a", "z"), J.has_all_keys(d, "a", "b")) == [(True, True), (True, False), (True, False), (None, None)]
    one = df.limit(1)
    assert values(one, J.json_set_lax(d, ["a"], None), J.json_set_lax(d, ["a"], None, null="delete_key"), J.json_set_lax(d, ["a"], None, null="return_target")) == [('{"a": null, "b": null}', '{"b": null}', '{"a": 1, "b": null}')]
    with pytest.raises(ValueError, match="null"):
        J.json_set_lax(d, ["a"], None, null="raise_exception")
