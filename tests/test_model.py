import re
import time

import pytest

from quarry import AggQuery, ColumnValuesMode, ColumnValuesQuery, DataModel, Join, PreAggregation, QueryError, ViewQuery, allow
from quarry.functions.expr import avg, col, count, count_distinct, median, nullif, stddev, stddev_pop, sum_, var_pop, var_samp

VISITS = [("mon", "a", 3.5), ("mon", "b", 8.0), ("tue", "a", 4.5), ("tue", "b", 9.25), ("wed", None, 0.75), ("wed", "c", None)]
TAKINGS = PreAggregation("takings_by_day", ("visits.day", "visits.shop"), {"visits.spent": ("sum", "mean", "std")})
COARSE = PreAggregation("by_shop", ("visits.shop",), {"visits.spent": ("sum", "min", "max")})


def make(spark, path=None, defs=(TAKINGS,)):
    tables = {
        "visits": spark.createDataFrame(VISITS, "day string, shop string, spent double"),
        "shops": spark.createDataFrame([("a", "Oslo"), ("b", "Rome")], "shop string, city string"),
        "stock": spark.createDataFrame([(1.0,)], "price double"),
    }
    m = DataModel(spark, tables, [Join("visits", "shops", ("shop",), ("shop",), "left", "both")], list(defs), path)
    m.add_measure("takings", lambda dm, q: dm.table("visits").filter(q.filter_for("*")).aggregate(q.groups_for("*"), [sum_("visits.spent").alias("takings")]))
    m.add_measure("visits_n", lambda dm, q: dm.table("visits").aggregate(q.groups_for("*"), [count("visits.spent").alias("visits_n")]))
    m.add_measure("shops_n", lambda dm, q: dm.table("shops").aggregate(allow("shops.*", q.groups), [count("shops.shop").alias("shops_n")]))
    return m


@pytest.fixture(scope="module")
def plain(spark):
    return make(spark, None, ())


def test_names_and_defaults(plain):
    df = plain.execute({"measures": ["takings", "takings"], "groups": ["visits.shop"], "sorts": [["visits.shop", "desc"]]})
    assert df.columns == ["visits.shop", "takings"]
    assert [tuple(r) for r in df.collect()] == [(None, 0.75), ("c", None), ("b", 17.25), ("a", 8.0)]
    assert AggQuery(["m"]).limit == 10_000 and ViewQuery.from_dict({"columns": ["a.b"]}).to_dict()["limit"] == 10_000
    q = AggQuery(["m"], {"and": []}, ["a.b"], sorts=[["a.b", "asc"]])
    assert AggQuery.from_json(q.to_json()) == q and ColumnValuesQuery.from_json(ColumnValuesQuery("a.b", "range").to_json()).mode is ColumnValuesMode.RANGE
    assert ColumnValuesQuery("a.b", "range").to_dict()["mode"] == "range" and ColumnValuesQuery("a.b").mode is ColumnValuesMode.DISTINCT


@pytest.mark.parametrize(
    "query,message",
    [
        ({"measures": []}, "measures must not be empty"), ({"columns": []}, "columns must not be empty"), ({"measures": ["takings"], "limit": 0}, "limit must be > 0"),
        ({"measures": ["nope"]}, "Unknown measure"), ({"measures": ["takings"], "groups": ["visits.nope"]}, "Unknown group column"),
        ({"measures": ["takings"], "filters": {"left": {"col": "visits.nope"}, "op": "=", "right": {"lit": 1}}}, "Unknown filter column"),
        ({"measures": ["takings"], "havings": {"left": {"col": "visits.spent"}, "op": ">", "right": {"lit": 1}}}, "Invalid having column"),
        ({"measures": ["takings"], "sorts": [["visits.day", "asc"]]}, "Invalid sort column"), ({"measures": ["takings"], "sorts": [["takings", "up"]]}, "Invalid sort direction"),
        ({"columns": ["visits.nope"]}, "Unknown column"), ({"columns": ["visits.day"], "sorts": [["visits.spent", "asc"]]}, "Sort column not in selected columns"),
        ({"columns": ["day"]}, "columns must be table-qualified"), ({"columns": ["visits.day", "stock.price"]}, "no single base table can reach all tables"),
        ({"column": "visits"}, "column must be in 'table_name.column_name' format"), ({"column": ".x"}, "invalid table name"), ({"column": "visits.a-b"}, "invalid column name"),
        ({"column": "nope.x"}, "unknown table"), ({"column": "visits.x"}, "unknown column"),
        ({"measures": ["takings", "shops_n"], "groups": ["visits.shop"]}, "incompatible group-by columns across measures"),
    ],
)
def test_errors(plain, query, message):
    with pytest.raises(QueryError, match=re.escape(message)):
        plain.execute(query)


def test_measure_registration(spark, plain):
    with pytest.raises(QueryError, match="already registered"):
        plain.add_measure("takings", lambda dm, q: None)
    with pytest.raises(QueryError, match=r"measure must end with aggregate\(\)"):
        plain.add_measure("x", lambda dm, q: dm.table("visits"))
    with pytest.raises(QueryError, match="nothing can follow"):
        plain.table("visits").aggregate([], [count()]).filter(col("visits.spent") > 1)
    with pytest.raises(QueryError, match="takes a list"):
        plain.table("visits").aggregate(allow("*", {}), [count()])
    with pytest.raises(QueryError, match="takes a filter"):
        plain.table("visits").filter(allow("*", []))
    meta = plain.measure_metadata("takings")
    assert meta.outputs == ["takings"] and meta.aggregates == [("visits.spent", "sum")] and len(meta.scopes) == 2
    assert [n for n, _ in plain.schemas()] == ["shops", "stock", "visits"] and plain.can_join("shops", "visits") and not plain.can_join("visits", "stock")


def test_merged_measures_scan_once(plain):
    plan = plain.explain({"measures": ["takings", "visits_n"], "groups": ["visits.shop"]})
    assert plan.count("Join") == 0
    assert "Join" in plain.explain({"measures": ["takings", "shops_n"]})
    assert plain.display_graphviz({"measures": ["takings"]}).startswith("digraph plan {")


# recorder


def test_recorder_sees_what_it_uses(plain):
    t = lambda: plain.table("visits")
    both = (col("visits.shop").eq("x")) & (col("stock.price") > 1)
    assert t().filter(both).ops[0].predicate == col("visits.shop").eq("x")
    assert t().filter(col("stock.price") > 1).ops == []
    agg = lambda r, *a: r.aggregate(["visits.shop"], list(a) or [sum_("visits.spent")])
    assert agg(t()).pre_agg_allowed
    chained = t().with_columns(a=col("visits.spent")).with_columns(b=col("a"))
    assert chained.aliases == {"a": "visits.spent", "b": "visits.spent"}
    assert agg(chained, sum_("b")).pre_agg_allowed and [a.of.name for a in agg(t().with_columns(a=col("visits.spent")), sum_("a")).source_aggregates] == ["visits.spent"]
    assert agg(t().with_columns(a=col("visits.spent").cast("double"))).pre_agg_allowed
    for blocked in (t().with_columns(a=col("visits.spent") * 2), t().with_columns(a=col("visits.spent").cast("int")), t().limit(0, 5), t().distinct(), t().join(plain.scan_table("shops"), "left", ["visits.shop"], ["shops.shop"]), t().union(t())):
        assert not agg(blocked).pre_agg_allowed
    assert agg(t().sort("visits.spent")).pre_agg_allowed
    renamed = t().with_columns(where=col("visits.shop")).aggregate(["where"], [count().alias("n")]).build().to_df()
    assert renamed.columns == ["where", "n"] and renamed.count() == 4
    with pytest.raises(QueryError, match="can't be reached"):
        t().aggregate(["stock.price"], [count()]).build()


# pre-aggregations


def test_definitions():
    for bad, message in (((), "group_by must not be empty"),):
        with pytest.raises(QueryError, match=message):
            PreAggregation("x", bad, {"a.b": ("sum",)})
    with pytest.raises(QueryError, match="aggregations must not be empty"):
        PreAggregation("x", ("a.b",), {})
    with pytest.raises(QueryError, match="Unknown aggregation type"):
        PreAggregation("x", ("a.b",), {"a.c": ("median",)})
    with pytest.raises(QueryError, match="both encode to the physical column"):
        PreAggregation("x", ("x__y.z", "x.y__z"), {"a.d": ("sum",)})
    with pytest.raises(QueryError, match="both encode to the physical column"):
        PreAggregation("x", ("t.n__max",), {"t.n": ("max",)})
    assert dict(TAKINGS.components) == {"visits.spent": ("count", "sum", "sumsq")}


def served(m, query, name=None):
    plan = m.explain(query)
    return f"{name}." in plan if name else ".parquet" in plan


def test_rollup_gives_what_the_table_gives(spark, tmp_path):
    m = make(spark, str(tmp_path / "p"), (TAKINGS, COARSE))
    stats = [avg, stddev, stddev_pop, var_samp, var_pop, sum_, count]
    m.add_measure("stats", lambda dm, q: dm.table("visits").filter(q.filter_for("*")).aggregate(q.groups_for("*"), [f("visits.spent").alias(f"s{i}") for i, f in enumerate(stats)] + [(sum_("visits.spent") / nullif(count("visits.spent"), 0)).cast("float").alias("ratio")]))
    m.write_pre_aggs()
    for groups in (["visits.shop"], ["visits.day", "visits.shop"], []):
        for filters in ({}, {"left": {"col": "visits.day"}, "op": ">", "right": {"lit": "mon"}}):
            q = {"measures": ["stats"], "groups": groups, "filters": filters}
            assert served(m, q, "takings_by_day") and not served(m, q | {"use_pre_agg": False})
            key = lambda r: tuple(str(x) for x in r[: len(groups)])
            a, b = sorted(m.collect(q), key=key), sorted(m.collect(q | {"use_pre_agg": False}), key=key)
            assert len(a) == len(b) > 0
            for x, y in zip(a, b):
                assert [v if v is None or isinstance(v, str) else pytest.approx(v, rel=1e-9) for v in x] == list(y)
    assert served(m, {"measures": ["takings"], "groups": ["visits.shop"]}, "by_shop")  # the smallest
    for aggs in ([count_distinct("visits.spent")], [sum_("visits.spent"), count()], [median("visits.spent")], [sum_("visits.spent", where=col("visits.spent") > 1)]):
        assert m.table("visits").aggregate(["visits.shop"], aggs).build().version is None
    # the same columns from another base, or over a join that the rollup doesn't have
    assert m.table("shops").aggregate(["visits.shop"], [sum_("visits.spent")]).build().version is None
    assert m.table("visits").aggregate(["shops.city"], [sum_("visits.spent")]).build().version is None
    assert m.table("visits").with_columns(x=col("visits.spent")).aggregate(["visits.shop"], [sum_("x")]).build().version.name == "by_shop"


def test_fan_out_is_not_served(spark, tmp_path):
    tables = {"a": spark.createDataFrame([(1, 10)], "k int, v int"), "b": spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")}
    m = DataModel(spark, tables, [Join("a", "b", ("k",), ("k",))], [PreAggregation("r", ("b.w", "a.k"), {"a.v": ("sum",)})], str(tmp_path / "p"))
    m.add_measure("v", lambda dm, q: dm.table("a").aggregate(q.groups_for("*"), [sum_("a.v").alias("v")]))
    m.write_pre_aggs()
    assert m.collect({"measures": ["v"], "groups": ["a.k"]})[0].v == 10  # the rollup would say 20
    assert served(m, {"measures": ["v"], "groups": ["b.w"]}, "r")


def test_versions_leases_and_reclaiming(spark, tmp_path):
    path = str(tmp_path / "p")
    m = make(spark, path)
    m.set_pre_agg_retired_grace(0)
    m.write_pre_aggs(["takings_by_day"])
    first = m.store.current["takings_by_day"]
    assert first.row_count == 6 and re.search(r"takings_by_day\.\d+\.parquet$", first.path) and m.store.files.exists(f"{path}/takings_by_day.current")
    q = {"measures": ["takings"], "groups": ["visits.shop"]}
    with m.query(q) as df:
        report = m.write_pre_aggs()
        assert report.in_use == [first.path] and m.store.files.exists(first.path)
        assert len(df.collect()) == 4  # from the old version
    assert m.reclaim().deleted == [first.path] and not m.store.files.exists(first.path)
    second = m.store.current["takings_by_day"]
    m.set_pre_agg_retired_grace(60)
    assert m.write_pre_aggs().in_grace == [second.path]
    # a new model takes up the current version; a pointer to nothing counts as none
    again = make(spark, path)
    assert again.store.current["takings_by_day"].path == m.store.current["takings_by_day"].path and served(again, q)
    again.store.files.delete(again.store.current["takings_by_day"].path)
    assert make(spark, path).store.current == {} and not served(make(spark, path), q)


def test_orphans(spark, tmp_path):
    m = make(spark, str(tmp_path))
    m.write_pre_aggs()
    for name in ("takings_by_day.5.parquet", "takings_by_day.other.7.parquet", "other.7.parquet", "takings_by_day.current.tmp"):
        (tmp_path / name).mkdir()
    assert m.reclaim().deleted == []
    m.set_pre_agg_orphan_grace(0)
    assert sorted(p.rpartition("/")[2] for p in m.reclaim().deleted) == ["takings_by_day.5.parquet", "takings_by_day.current.tmp"]
    assert (tmp_path / "takings_by_day.other.7.parquet").exists()


def test_freshness(spark, tmp_path):
    m = make(spark, str(tmp_path))
    m.write_pre_aggs()
    q = {"measures": ["takings"], "groups": ["visits.shop"]}
    time.sleep(0.01)
    assert served(m, q | {"pre_agg_valid_secs": 3600}) and not served(m, q | {"pre_agg_valid_secs": 0})


def test_catalog(spark, tmp_path):
    m = make(spark, str(tmp_path), (TAKINGS, COARSE, PreAggregation("visits", ("visits.day",), {"visits.spent": ("sum",)})))
    m.write_pre_aggs(["takings_by_day", "visits"])
    listed = m.sql("SELECT table_name FROM information_schema.tables WHERE table_schema = 'pre_agg' ORDER BY 1").collect()
    assert [r.table_name for r in listed] == ["takings_by_day", "visits"]
    assert m.sql("SELECT count(*) AS n FROM pre_agg.visits").head().n == 3 and m.sql("SELECT count(*) AS n FROM visits").head().n == 6
    assert m.sql("SELECT visits__shop, visits__spent__sum FROM pre_agg.takings_by_day ORDER BY 1, 2 LIMIT 2").columns == ["visits__shop", "visits__spent__sum"]
    assert m.store.current["visits"].columns == {("visits.day", None): "visits__day", ("visits.spent", "sum"): "visits__spent__sum"}
    with pytest.raises(QueryError, match="not found"):
        m.write_pre_aggs(["nope"])
    with pytest.raises(QueryError, match="no pre-aggregations registered"):
        make(spark, None, ()).write_pre_aggs()
    with pytest.raises(QueryError, match="defined twice"):
        make(spark, str(tmp_path), (TAKINGS, PreAggregation("takings_by_day", ("visits.day",), {"visits.spent": ("sum",)})))


def test_equal_frames_of_two_unions_stay_apart(spark):
    t = DataModel(spark, {"t": spark.createDataFrame([(1, 10)], "k int, v int")})
    for name, n in (("few", 1), ("many", 3)):
        t.add_measure(name, lambda dm, q, name=name, n=n: dm.table("t").union(spark.createDataFrame([(1, 5)] * n, "k int, v int")).aggregate([], [sum_("t.v").alias(name)]))
    assert tuple(t.collect({"measures": ["few", "many"]})[0]) == (15, 25)


def test_column_values(spark, tmp_path):
    m = make(spark, str(tmp_path), (COARSE,))
    m.write_pre_aggs()
    assert sorted(str(r[0]) for r in m.collect({"column": "visits.shop"})) == ["None", "a", "b", "c"] and served(m, {"column": "visits.shop"})
    assert tuple(m.collect({"column": "visits.spent", "mode": "range"})[0]) == (0.75, 9.25) and served(m, {"column": "visits.spent", "mode": "range"})
    assert not served(m, {"column": "visits.day"}) and not served(m, {"column": "visits.shop", "use_pre_agg": False})


def test_pruned_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", *(f"id + {i} AS c{i}" for i in range(98))).write.parquet(str(tmp_path / "wide"))
    m = DataModel(spark, {"wide": spark.read.parquet(str(tmp_path / "wide"))})
    m.add_measure("s", lambda dm, q: dm.table("wide").filter(q.filter_for("*")).aggregate(q.groups_for("*"), [sum_("wide.c1").alias("s")]))
    plan = m.explain({"measures": ["s"], "groups": ["wide.c2"], "filters": {"left": {"col": "wide.c3"}, "op": ">", "right": {"lit": 4}}})
    read = re.search(r"ReadSchema: struct<(.*?)>", plan)[1]
    assert len(read.split(",")) == 3 and "GreaterThan(c3,4)" in plan
