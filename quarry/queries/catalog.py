"""The model over the standard tables, and its queries by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import allow, exclude
from quarry.functions.expr import Agg, Col, Func, Lit, avg, case, col, count, count_distinct, func, lit, max_, min_, nullif, stddev, stddev_pop, sum_, var_pop, var_samp
from quarry.plans.joins import Join
from quarry.plans.model import DataModel
from quarry.sources import tables
from quarry.sources.folders import scratch
from quarry.sources.preagg import PreAggregation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

JOINS = [
    Join("lineitem", "orders", ("l_orderkey",), ("o_orderkey",)),
    Join("orders", "customer", ("o_custkey",), ("c_custkey",)),
    Join("lineitem", "part", ("l_partkey",), ("p_partkey",)),
    Join("lineitem", "supplier", ("l_suppkey",), ("s_suppkey",)),
    Join("customer", "nation", ("c_nationkey",), ("n_nationkey",)),
    Join("nation", "region", ("n_regionkey",), ("r_regionkey",)),
    Join("supplier", "supp_nation", ("s_nationkey",), ("n_nationkey",)),
    Join("lineitem", "pairs", ("l_partkey", "l_suppkey"), ("part", "supp")),
    Join("events", "customer", ("user_id",), ("c_custkey",)),
    Join("documents", "labels", ("doc_id",), ("doc_id",), "left", "both"),
]
USED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")
R2 = lambda e: func("round", e, lit(2))
R6 = lambda e: func("round", e, lit(6))
NET = col("lineitem.l_extendedprice") * (1 - col("lineitem.l_discount"))


def _measure(base: str, aggs, where=None):
    """A measure that honours all groups and filters of the query."""
    return lambda m, q: m.table(base).filter(q.filter_for("*")).filter(where).aggregate(q.groups_for("*"), aggs)


MEASURES = {
    "revenue": _measure("lineitem", [R2(sum_(NET)).alias("revenue")]),
    "quantity": _measure("lineitem", [R2(sum_("lineitem.l_quantity")).alias("quantity")]),
    "lines": _measure("lineitem", [count("lineitem.l_orderkey").alias("lines")]),
    "least_price": _measure("lineitem", [min_("lineitem.l_extendedprice").alias("least_price")]),
    "most_price": _measure("lineitem", [max_("lineitem.l_extendedprice").alias("most_price")]),
    "mean_price": _measure("lineitem", [R2(avg("lineitem.l_extendedprice")).alias("mean_price")]),
    "spread_pop": _measure("lineitem", [R2(stddev_pop("lineitem.l_quantity")).alias("spread_pop")]),
    "spread": _measure("lineitem", [R2(stddev("lineitem.l_quantity")).alias("spread")]),
    "variance_pop": _measure("lineitem", [R2(var_pop("lineitem.l_quantity")).alias("variance_pop")]),
    "variance": _measure("lineitem", [R2(var_samp("lineitem.l_quantity")).alias("variance")]),
    "orders_seen": _measure("lineitem", [count_distinct("lineitem.l_orderkey").alias("orders_seen")]),
    "mean_discount_share": _measure("lineitem", [R6(sum_("lineitem.l_discount") / nullif(sum_("lineitem.l_quantity"), 0)).alias("share")]),
    "returned": _measure("lineitem", [count("lineitem.l_orderkey").alias("returned")], col("lineitem.l_returnflag").eq("R")),
    "order_total": _measure("orders", [R2(sum_("orders.o_totalprice")).alias("order_total")]),
    "order_count": _measure("orders", [count("orders.o_orderkey").alias("order_count")]),
    "all_lines": lambda m, q: m.table("lineitem").aggregate(q.groups_for("*"), [count("lineitem.l_orderkey").alias("all_lines")]),
    "flag_lines": lambda m, q: m.table("lineitem").filter(allow("lineitem.*", q.filters)).aggregate(q.groups_for("*"), [count("lineitem.l_orderkey").alias("flag_lines")]),
    "no_status": lambda m, q: m.table("lineitem").filter(exclude("lineitem.l_linestatus", q.filters)).aggregate(q.groups_for("*"), [count("lineitem.l_orderkey").alias("no_status")]),
    "event_value": _measure("events", [R2(sum_("events.value")).alias("event_value")]),
    "doc_count": _measure("documents", [count("documents.doc_id").alias("doc_count")]),
    "long_docs": _measure("documents", [count("documents.doc_id").alias("long_docs")], col("documents.n_chars") > 1000),
    "labelled": _measure("labels", [sum_("documents.n_chars").alias("labelled_chars")]),
}


@lru_cache(maxsize=8)
def model(spark: SparkSession, sf_dir: str) -> DataModel:
    found = tables.parquet(spark, sf_dir, USED)
    found["supp_nation"] = found["nation"]
    found["pairs"] = found["lineitem"].groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).agg(F.count("*").alias("times"))
    return _with_measures(DataModel(spark, found, JOINS))


def _with_measures(m: DataModel) -> DataModel:
    for name, f in MEASURES.items():
        m.add_measure(name, f)
    return m


ROLLUPS = [
    PreAggregation("by_flag", ("lineitem.l_returnflag",), {"lineitem.l_quantity": ("sum", "count", "min", "max", "mean", "std", "var"), "lineitem.l_extendedprice": ("min", "max", "mean"), "lineitem.l_orderkey": ("count",)}),
    PreAggregation("by_flag_status", ("lineitem.l_returnflag", "lineitem.l_linestatus"), {"lineitem.l_quantity": ("sum", "count", "std"), "lineitem.l_orderkey": ("count",), "lineitem.l_extendedprice": ("min", "max", "mean")}),
    PreAggregation("by_region", ("region.r_name", "lineitem.l_returnflag"), {"lineitem.l_quantity": ("sum",), "lineitem.l_orderkey": ("count",)}),
]


@lru_cache(maxsize=8)
def rollup_model(spark: SparkSession, sf_dir: str) -> DataModel:
    """The model with its rollups written."""
    base = model(spark, sf_dir)
    m = _with_measures(DataModel(spark, base.tables, JOINS, ROLLUPS, scratch(spark, "rollups")))
    m.write_pre_aggs()
    return m


def plain(df: DataFrame) -> DataFrame:
    """Column names without the dot, which other tools take for a table's."""
    return df.toDF(*(c.replace(".", "__") for c in df.columns))


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(query(spark, sf_dir))
    SQL[name] = sql


def agg(name: str, payload: dict, sql: str, of=model) -> None:
    add(name, lambda spark, sf_dir: of(spark, sf_dir).execute(payload), sql)


def chain(name: str, build: Callable[[DataModel], object], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(model(spark, sf_dir)).build()
        return out if isinstance(out, DataFrame) else out.to_df()

    add(name, run, sql)


def _where(column: str, op: str, value) -> dict:
    return {"left": {"col": column}, "op": op, "right": {"lit": value}}


FLAG, STATUS, REGION = "lineitem.l_returnflag", "lineitem.l_linestatus", "region.r_name"
BY_FLAG = "SELECT l_returnflag AS lineitem__l_returnflag, {} FROM lineitem {} GROUP BY 1"
NET_SQL = "round(sum(l_extendedprice * (1 - l_discount)), 2)"
STAR = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"

#: A limit above any table's size, for queries whose subject is not the limit.
EVERY_ROW = 2**31 - 1

# aggregates
SIMPLE = {
    "agg_sum": ("quantity", "round(sum(l_quantity), 2)"), "agg_count": ("lines", "count(l_orderkey)"), "agg_min": ("least_price", "min(l_extendedprice)"),
    "agg_max": ("most_price", "max(l_extendedprice)"), "agg_avg": ("mean_price", "round(avg(l_extendedprice), 2)"), "agg_stddev_pop": ("spread_pop", "round(stddev_pop(l_quantity), 2)"),
    "agg_var_pop": ("variance_pop", "round(var_pop(l_quantity), 2)"), "agg_stddev_sample": ("spread", "round(stddev_samp(l_quantity), 2)"),
    "agg_count_distinct": ("orders_seen", "count(DISTINCT l_orderkey)"),
}
for _name, (_m, _sql) in SIMPLE.items():
    agg(_name, {"measures": [_m], "groups": [FLAG]}, BY_FLAG.format(f"{_sql} AS {_m}", ""))
agg("agg_ratio", {"measures": ["mean_discount_share"], "groups": [FLAG]}, BY_FLAG.format("round(sum(l_discount) / nullif(sum(l_quantity), 0), 6) AS share", ""))
agg("agg_global", {"measures": ["revenue"]}, f"SELECT {NET_SQL} AS revenue FROM lineitem")
agg("agg_two_groups", {"measures": ["revenue"], "groups": [FLAG, STATUS]}, f"SELECT l_returnflag AS lineitem__l_returnflag, l_linestatus AS lineitem__l_linestatus, {NET_SQL} AS revenue FROM lineitem GROUP BY 1, 2")
agg("agg_join_1hop", {"measures": ["revenue"], "groups": ["orders.o_orderpriority"]}, f"SELECT o_orderpriority AS orders__o_orderpriority, {NET_SQL} AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
agg("agg_join_3hop", {"measures": ["revenue", "orders_seen"], "groups": [REGION], "sorts": [["revenue", "desc"]]}, f"SELECT r_name AS region__r_name, {NET_SQL} AS revenue, count(DISTINCT l_orderkey) AS orders_seen FROM {STAR} GROUP BY 1")
agg("agg_join_multikey", {"measures": ["lines"], "groups": ["pairs.times"]}, "SELECT times AS pairs__times, count(l_orderkey) AS lines FROM lineitem LEFT JOIN (SELECT l_partkey AS part, l_suppkey AS supp, count(*) AS times FROM lineitem GROUP BY 1, 2) p ON l_partkey = part AND l_suppkey = supp GROUP BY 1")
agg("agg_bidirectional_edge", {"measures": ["labelled"], "groups": ["documents.lang"]}, "SELECT lang AS documents__lang, CAST(sum(n_chars) AS BIGINT) AS labelled_chars FROM labels LEFT JOIN documents USING (doc_id) GROUP BY 1")


def _inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = DataModel(spark, {t: model(spark, sf_dir).tables[t] for t in ("documents", "labels")}, [Join("documents", "labels", ("doc_id",), ("doc_id",), "inner", "both")])
    m.add_measure("doc_count", MEASURES["doc_count"])
    return m.execute({"measures": ["doc_count"], "groups": ["labels.toxic"]})


add("agg_inner_edge", _inner, "SELECT toxic AS labels__toxic, count(documents.doc_id) AS doc_count FROM documents JOIN labels USING (doc_id) GROUP BY 1")

# filters
FILTERS = {
    "eq": (FLAG, "=", "R", "l_returnflag = 'R'"), "ne": (FLAG, "ne", "R", "l_returnflag <> 'R'"), "gt": ("lineitem.l_quantity", ">", 25, "l_quantity > 25"),
    "gte": ("lineitem.l_quantity", "gte", 25, "l_quantity >= 25"), "lt": ("lineitem.l_quantity", "lt", 13, "l_quantity < 13"),
    "lte": ("lineitem.l_discount", "<=", 0.05, "l_discount <= 0.05"), "in": (FLAG, "in", ["A", "N"], "l_returnflag IN ('A', 'N')"), "not_in": (FLAG, "not_in", ["A"], "l_returnflag NOT IN ('A')"),
}
for _op, (_c, _sign, _v, _sql) in FILTERS.items():
    agg(f"filter_{_op}", {"measures": ["lines"], "groups": [FLAG], "filters": _where(_c, _sign, _v)}, BY_FLAG.format("count(l_orderkey) AS lines", f"WHERE {_sql}"))
agg("filter_col_vs_col", {"measures": ["lines"], "groups": [FLAG], "filters": {"left": {"col": "lineitem.l_discount"}, "op": ">", "right": {"col": "lineitem.l_tax"}}}, BY_FLAG.format("count(l_orderkey) AS lines", "WHERE l_discount > l_tax"))
agg("filter_and_or_nested", {"measures": ["lines"], "groups": [FLAG], "filters": {"and": [{"or": [_where(FLAG, "=", "R"), _where(STATUS, "=", "O")]}, _where("lineitem.l_quantity", "<", 10)]}}, BY_FLAG.format("count(l_orderkey) AS lines", "WHERE (l_returnflag = 'R' OR l_linestatus = 'O') AND l_quantity < 10"))
BOTH = {"and": [_where(FLAG, "=", "R"), _where("part.p_size", ">", 25)]}
agg("filter_allow_prunes", {"measures": ["flag_lines"], "groups": [STATUS], "filters": BOTH}, "SELECT l_linestatus AS lineitem__l_linestatus, count(*) AS flag_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
agg("filter_exclude_prunes", {"measures": ["no_status"], "groups": [FLAG], "filters": {"and": [_where(STATUS, "=", "O"), _where("part.p_size", ">", 25)]}}, "SELECT l_returnflag AS lineitem__l_returnflag, count(*) AS no_status FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY 1")
agg("filter_not_honoured", {"measures": ["all_lines"], "groups": [FLAG], "filters": BOTH}, BY_FLAG.format("count(*) AS all_lines", ""))
agg("filter_unreachable_pruned", {"measures": ["order_total"], "groups": ["orders.o_orderstatus"], "filters": BOTH | {"and": [*BOTH["and"], _where("orders.o_totalprice", ">", 1000)]}}, "SELECT o_orderstatus AS orders__o_orderstatus, round(sum(o_totalprice), 2) AS order_total FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
agg("having_measure", {"measures": ["lines"], "groups": ["supplier.s_name"], "havings": _where("lines", ">", 590), "limit": EVERY_ROW}, "SELECT s_name AS supplier__s_name, count(l_orderkey) AS lines FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(l_orderkey) > 590")
agg("having_group", {"measures": ["lines"], "groups": [FLAG], "havings": _where(FLAG, "!=", "A")}, BY_FLAG.format("count(l_orderkey) AS lines", "") + " HAVING l_returnflag <> 'A'")
agg("having_in", {"measures": ["lines"], "groups": [REGION], "havings": _where(REGION, "in", ["ASIA", "EUROPE"])}, f"SELECT r_name AS region__r_name, count(l_orderkey) AS lines FROM {STAR} GROUP BY 1 HAVING r_name IN ('ASIA', 'EUROPE')")

# sorts and limits
agg("sort_asc", {"measures": ["revenue"], "groups": ["part.p_brand"], "sorts": [["revenue", "asc"]], "limit": 7}, f"SELECT p_brand AS part__p_brand, {NET_SQL} AS revenue FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY revenue LIMIT 7")
agg("sort_desc_nulls_first", {"measures": ["doc_count"], "groups": ["labels.quality", "documents.lang"], "sorts": [["labels.quality", "desc"], ["documents.lang", "asc"]], "limit": 5}, "SELECT quality AS labels__quality, lang AS documents__lang, count(documents.doc_id) AS doc_count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2 ORDER BY 1 DESC NULLS FIRST, 2 NULLS FIRST LIMIT 5")
agg("limit_offset", {"measures": ["order_count"], "groups": ["orders.o_custkey"], "sorts": [["order_count", "desc"], ["orders.o_custkey", "asc"]], "limit": 20, "offset": 10}, "SELECT o_custkey AS orders__o_custkey, count(o_orderkey) AS order_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 10")

# several measures
agg("multi_measure_merged", {"measures": ["revenue", "quantity", "lines"], "groups": [FLAG]}, BY_FLAG.format(f"{NET_SQL} AS revenue, round(sum(l_quantity), 2) AS quantity, count(l_orderkey) AS lines", ""))
agg("multi_measure_full_join", {"measures": ["lines", "order_total", "event_value"], "groups": ["nation.n_name"]}, "SELECT n_name AS nation__n_name, lines, order_total, event_value FROM (SELECT n_name, count(l_orderkey) AS lines FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) FULL JOIN (SELECT n_name, round(sum(o_totalprice), 2) AS order_total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) USING (n_name) FULL JOIN (SELECT n_name, round(sum(value), 2) AS event_value FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) USING (n_name)")
agg("multi_measure_nullkey", {"measures": ["doc_count", "long_docs"], "groups": ["labels.toxic"]}, "SELECT a.toxic AS labels__toxic, doc_count, long_docs FROM (SELECT toxic, count(*) AS doc_count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) a JOIN (SELECT toxic, count(*) AS long_docs FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars > 1000 GROUP BY 1) b ON a.toxic IS NOT DISTINCT FROM b.toxic")
agg("multi_measure_no_groups", {"measures": ["lines", "order_count"]}, "SELECT (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM orders) AS order_count")

# rollups
for _name in ("sum", "count", "min", "max", "avg", "stddev_pop", "var_pop", "stddev_sample"):
    _m, _sql = SIMPLE[f"agg_{_name}"]
    agg(f"preagg_{_name}", {"measures": [_m], "groups": [FLAG]}, BY_FLAG.format(f"{_sql} AS {_m}", ""), rollup_model)
agg("preagg_var_sample", {"measures": ["variance"], "groups": [FLAG]}, BY_FLAG.format("round(var_samp(l_quantity), 2) AS variance", ""), rollup_model)
agg("preagg_filter", {"measures": ["quantity"], "groups": [FLAG], "filters": _where(STATUS, "=", "O")}, BY_FLAG.format("round(sum(l_quantity), 2) AS quantity", "WHERE l_linestatus = 'O'"), rollup_model)
agg("preagg_multi_table", {"measures": ["quantity", "lines"], "groups": [REGION]}, f"SELECT r_name AS region__r_name, round(sum(l_quantity), 2) AS quantity, count(l_orderkey) AS lines FROM {STAR} GROUP BY 1", rollup_model)
agg("preagg_distinct_falls_back", {"measures": ["orders_seen"], "groups": [FLAG]}, BY_FLAG.format("count(DISTINCT l_orderkey) AS orders_seen", ""), rollup_model)
agg("preagg_stale_falls_back", {"measures": ["quantity"], "groups": [FLAG], "pre_agg_valid_secs": 0}, BY_FLAG.format("round(sum(l_quantity), 2) AS quantity", ""), rollup_model)
add("preagg_sql", lambda spark, sf: rollup_model(spark, sf).sql("SELECT lineitem__l_returnflag, round(sum(lineitem__l_quantity__sum), 2) AS quantity FROM pre_agg.by_flag_status GROUP BY 1"), BY_FLAG.format("round(sum(l_quantity), 2) AS quantity", ""))


def _renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rollup_model(spark, sf_dir)
    return m.table("lineitem").with_columns(units=col("lineitem.l_quantity")).aggregate([FLAG], [R2(sum_("units")).alias("units")]).build().to_df()


add("preagg_rename_alias", _renamed, BY_FLAG.format("round(sum(l_quantity), 2) AS units", ""))

# views
VIEW = ["lineitem.l_orderkey", "lineitem.l_linenumber", "lineitem.l_partkey", "lineitem.l_suppkey"]
VIEW_SQL = "l_orderkey AS lineitem__l_orderkey, l_linenumber AS lineitem__l_linenumber, l_partkey AS lineitem__l_partkey, l_suppkey AS lineitem__l_suppkey"
ALL = [[c, "asc"] for c in VIEW]
agg("view_single", {"columns": ["orders.o_orderkey", "orders.o_orderstatus"], "filters": _where("orders.o_totalprice", ">", 490000), "limit": EVERY_ROW}, "SELECT o_orderkey AS orders__o_orderkey, o_orderstatus AS orders__o_orderstatus FROM orders WHERE o_totalprice > 490000")
agg("view_join", {"columns": ["orders.o_orderkey", "customer.c_name", REGION], "sorts": [["orders.o_orderkey", "asc"]], "limit": EVERY_ROW}, "SELECT o_orderkey AS orders__o_orderkey, c_name AS customer__c_name, r_name AS region__r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey ORDER BY 1")
agg("view_filter_join", {"columns": ["orders.o_orderkey", "orders.o_totalprice"], "filters": {"and": [_where(REGION, "=", "ASIA"), _where("orders.o_totalprice", ">", 480000)]}, "limit": EVERY_ROW}, "SELECT o_orderkey AS orders__o_orderkey, o_totalprice AS orders__o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_totalprice > 480000")
agg("view_sort_limit", {"columns": VIEW, "sorts": [[VIEW[0], "desc"], *ALL[1:]], "limit": 100, "offset": 5}, f"SELECT {VIEW_SQL} FROM lineitem ORDER BY 1 DESC, 2, 3, 4 LIMIT 100 OFFSET 5")

# column values
agg("colvals_distinct", {"column": "orders.o_orderpriority"}, 'SELECT DISTINCT o_orderpriority AS orders__o_orderpriority FROM orders')
agg("colvals_range", {"column": "orders.o_totalprice", "mode": "range"}, "SELECT min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
agg("colvals_distinct_preagg", {"column": FLAG}, "SELECT DISTINCT l_returnflag AS lineitem__l_returnflag FROM lineitem", rollup_model)
agg("colvals_range_preagg_key", {"column": FLAG, "mode": "range"}, "SELECT min(l_returnflag) AS min, max(l_returnflag) AS max FROM lineitem", rollup_model)
agg("colvals_range_preagg_component", {"column": "lineitem.l_extendedprice", "mode": "range"}, "SELECT min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem", rollup_model)

# recorded operations
GROSS = col("lineitem.l_extendedprice") * (1 + col("lineitem.l_tax"))
chain("op_with_columns", lambda m: m.table("lineitem").with_columns(gross=GROSS).aggregate([FLAG], [R2(sum_("gross")).alias("gross")]), BY_FLAG.format("round(sum(l_extendedprice * (1 + l_tax)), 2) AS gross", ""))
chain("op_case", lambda m: m.table("lineitem").with_columns(size=case((col("lineitem.l_quantity") < 10, "small"), otherwise="large")).aggregate(["size"], [count().alias("n")]), "SELECT CASE WHEN l_quantity < 10 THEN 'small' ELSE 'large' END AS size, count(*) AS n FROM lineitem GROUP BY 1")
chain("op_filtered_aggregate", lambda m: m.table("lineitem").aggregate([FLAG], [sum_("lineitem.l_linenumber", where=col("lineitem.l_quantity").between(5, 20)).alias("n")]), BY_FLAG.format("CAST(sum(l_linenumber) FILTER (WHERE l_quantity BETWEEN 5 AND 20) AS BIGINT) AS n", ""))
chain("op_like_is_null", lambda m: m.table("documents").filter(col("labels.quality").is_null() & col("documents.source").like("src1%")).aggregate(["documents.lang"], [count().alias("n")]), "SELECT lang AS documents__lang, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND source LIKE 'src1%' GROUP BY 1")
chain("op_drop", lambda m: m.table("nation").drop_columns("nation.n_regionkey"), "SELECT n_nationkey, n_name FROM nation")
chain("op_distinct", lambda m: m.table("customer").drop_columns("customer.c_custkey", "customer.c_name", "customer.c_acctbal", "customer.c_nationkey").distinct(), "SELECT DISTINCT c_mktsegment FROM customer")
chain("op_distinct_on", lambda m: m.table("orders").distinct_on(["orders.o_custkey"], ["orders.o_custkey", "orders.o_orderkey"], [Col("orders.o_custkey"), Col("orders.o_totalprice").desc(), Col("orders.o_orderkey")]), "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
chain("op_union", lambda m: m.table("region").union(m.table("region")).aggregate([REGION], [count().alias("n")]), "SELECT r_name AS region__r_name, count(*) AS n FROM (SELECT * FROM region UNION ALL SELECT * FROM region) GROUP BY 1")
chain("op_union_distinct", lambda m: m.table("region").union_distinct(m.table("region")), "SELECT * FROM region UNION SELECT * FROM region")
chain("op_sort_limit", lambda m: m.table("part").sort(Col("part.p_retailprice").desc(), "part.p_partkey").limit(3, 10), "SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 3")
chain("op_window_rank", lambda m: m.table("supplier").window(func("rank").over(["supplier.s_nationkey"], [Col("supplier.s_acctbal").desc(), Col("supplier.s_suppkey")]).alias("place")), "SELECT *, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier")
chain("op_window_frame", lambda m: m.table("supplier").window(sum_("supplier.s_suppkey").over(["supplier.s_nationkey"], [Col("supplier.s_suppkey")], rows=(-1, 0)).alias("last_two")), "SELECT *, CAST(sum(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_two FROM supplier")
chain("op_window_lag", lambda m: m.table("orders").window(Func("lag", (Col("orders.o_orderkey"), Lit(1))).over(["orders.o_custkey"], [Col("orders.o_orderkey")]).alias("before")).aggregate(["orders.o_custkey"], [count("before").alias("n"), min_("before").alias("first")]), "SELECT o_custkey AS orders__o_custkey, count(b) AS n, min(b) AS first FROM (SELECT o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) GROUP BY 1")


def _keyed(m: DataModel, name: str = "big") -> DataFrame:
    """Orders over 400,000, under another name, so that they can stand beside the orders."""
    return m.tables["orders"].filter("o_totalprice > 400000").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("order")).alias(name)


for _how, _sql in {"left_semi": "c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", "left_anti": "c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"}.items():
    chain(f"op_join_{_how[5:]}", lambda m, how=_how: m.table("customer").join(_keyed(m), how, ["customer.c_custkey"], ["big.key"]).aggregate(["customer.c_mktsegment"], [count().alias("n")]), f"SELECT c_mktsegment AS customer__c_mktsegment, count(*) AS n FROM customer WHERE {_sql} GROUP BY 1")
for _how in ("inner", "left", "right", "full"):
    chain(f"op_join_{_how}", lambda m, how=_how: m.table("customer").join(_keyed(m), how, ["customer.c_custkey"], ["big.key"]).aggregate(["customer.c_mktsegment"], [count("big.order").alias("n"), count().alias("rows")]), f'SELECT c_mktsegment AS customer__c_mktsegment, count(o_orderkey) AS n, count(*) AS "rows" FROM customer {_how.upper()} JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey GROUP BY 1')
chain("op_join_right_semi", lambda m: m.table("customer").filter(col("customer.c_acctbal") > 5000).join(_keyed(m), "right_semi", ["customer.c_custkey"], ["big.key"]), 'SELECT o_custkey AS key, o_orderkey AS "order" FROM orders WHERE o_totalprice > 400000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)')
chain("op_join_right_anti", lambda m: m.table("customer").filter(col("customer.c_acctbal") > 5000).join(_keyed(m), "right_anti", ["customer.c_custkey"], ["big.key"]), 'SELECT o_custkey AS key, o_orderkey AS "order" FROM orders WHERE o_totalprice > 400000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)')
chain("op_join_mark", lambda m: m.table("customer").join(_keyed(m), "left_mark", ["customer.c_custkey"], ["big.key"]).aggregate(["mark"], [count().alias("n")]), "SELECT c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS mark, count(*) AS n FROM customer GROUP BY 1")
chain("op_join_theta", lambda m: m.table("nation").join(m.tables["region"].alias("other"), "inner", where=col("nation.n_regionkey") < col("other.r_regionkey")).aggregate(["nation.n_name"], [count().alias("n")]), "SELECT n_name AS nation__n_name, count(*) AS n FROM nation JOIN region ON n_regionkey < r_regionkey GROUP BY 1")
add("sql_passthrough", lambda spark, sf: model(spark, sf).sql("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)"), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
add("sql_information_schema", lambda spark, sf: rollup_model(spark, sf).sql("SELECT table_name FROM information_schema.tables WHERE table_schema = 'pre_agg'"), "SELECT unnest(['by_flag', 'by_flag_status', 'by_region']) AS table_name")

# values and kinds of a measured column that the tables don't have

NULL_SPREAD = [sum_("held.n"), stddev("held.n"), var_samp("held.n"), stddev_pop("held.n"), var_pop("held.n")]


@lru_cache(maxsize=8)
def _with_nulls(spark: SparkSession, sf_dir: str) -> DataModel:
    """Lines whose quantity is null for one flag, and a rollup of them."""
    lines = model(spark, sf_dir).tables["lineitem"]
    held = lines.select(F.col("l_returnflag").alias("flag"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("n"))
    m = DataModel(spark, {"held": held}, [], [PreAggregation("held_by_flag", ("held.flag",), {"held.n": ("sum", "std", "var")})], scratch(spark, "rollups"))
    m.add_measure("spread", lambda dm, q: dm.table("held").aggregate(q.groups_for("*"), [R6(e).alias(f"s{i}") for i, e in enumerate(NULL_SPREAD)]))
    m.write_pre_aggs()
    return m


_N = "CASE WHEN l_returnflag <> 'R' THEN l_quantity END"
agg("preagg_stddev_nulls", {"measures": ["spread"], "groups": ["held.flag"]}, f"SELECT l_returnflag AS held__flag, {', '.join(f'round({f}({_N}), 6) AS s{i}' for i, f in enumerate(('sum', 'stddev_samp', 'var_samp', 'stddev_pop', 'var_pop')))} FROM lineitem GROUP BY 1", _with_nulls)


@lru_cache(maxsize=8)
def _without_rollup(spark: SparkSession, sf_dir: str) -> DataModel:
    """A model whose only rollup was written and is gone."""
    m = DataModel(spark, {"orders": model(spark, sf_dir).tables["orders"]}, [], [PreAggregation("by_status", ("orders.o_orderstatus",), {"orders.o_totalprice": ("min", "max")})], scratch(spark, "rollups"))
    m.write_pre_aggs()
    m.store.files.delete(m.store.current["by_status"].path)
    return m


agg("colvals_preagg_gone", {"column": "orders.o_orderstatus"}, "SELECT DISTINCT o_orderstatus AS orders__o_orderstatus FROM orders", _without_rollup)
agg("colvals_range_preagg_gone", {"column": "orders.o_totalprice", "mode": "range"}, "SELECT min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders", _without_rollup)
chain("op_join_mark_where", lambda m: m.table("customer").join(_keyed(m), "left_mark", ["customer.c_custkey"], ["big.key"], where=col("big.order") > col("customer.c_custkey") * 5).aggregate(["mark"], [count().alias("n")]), "SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000 AND o_orderkey > c_custkey * 5) AS mark, count(*) AS n FROM customer GROUP BY 1")
chain("op_distinct_aggregates", lambda m: m.table("lineitem").aggregate([FLAG], [Agg(f, col("lineitem.l_linenumber"), distinct=True).alias(f"{f}_of") for f in ("count", "sum", "min", "max", "avg")]), BY_FLAG.format("count(DISTINCT l_linenumber) AS count_of, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS sum_of, min(l_linenumber) AS min_of, max(l_linenumber) AS max_of, avg(DISTINCT l_linenumber) AS avg_of", ""))
chain("op_cast", lambda m: m.table("orders").with_columns(whole=col("orders.o_totalprice").cast("bigint")).aggregate(["orders.o_orderstatus"], [sum_("whole").alias("whole")]), "SELECT o_orderstatus AS orders__o_orderstatus, CAST(sum(CAST(trunc(o_totalprice) AS BIGINT)) AS BIGINT) AS whole FROM orders GROUP BY 1")
chain("op_median", lambda m: m.table("orders").aggregate(["orders.o_orderpriority"], [Agg("median", col("orders.o_custkey")).alias("middle")]), "SELECT o_orderpriority AS orders__o_orderpriority, median(o_custkey) AS middle FROM orders GROUP BY 1")
chain("func_strings", lambda m: m.table("part").with_columns(word=func("upper", func("substring", col("part.p_name"), lit(1), lit(3))), size=func("length", func("concat", col("part.p_brand"), lit("-"), func("lower", col("part.p_type"))))).aggregate(["word"], [sum_("size").alias("size")]), "SELECT upper(substr(p_name, 1, 3)) AS word, CAST(sum(length(p_brand || '-' || lower(p_type))) AS BIGINT) AS size FROM part GROUP BY 1")
chain("func_dates", lambda m: m.table("orders").with_columns(year=func("year", col("orders.o_orderdate")), month=func("date_trunc", lit("month"), col("orders.o_orderdate"))).aggregate(["year"], [count_distinct("month").alias("months"), count().alias("n")]), "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT date_trunc('month', o_orderdate)) AS months, count(*) AS n FROM orders GROUP BY 1")
chain("func_arrays_and_maps", lambda m: m.table("part").with_columns(words=func("size", func("array_distinct", func("split", col("part.p_name"), lit(" ")))), kind=func("element_at", func("create_map", lit("b"), col("part.p_brand")), lit("b"))).aggregate(["kind"], [sum_("words").alias("words")]), "SELECT p_brand AS kind, CAST(sum(len(list_distinct(string_split(p_name, ' ')))) AS BIGINT) AS words FROM part GROUP BY 1")
for _set, _rest in (("INTERSECT", ""), ("EXCEPT", "")):
    _statement = f"SELECT n_nationkey AS k FROM nation {_set} SELECT c_nationkey FROM customer WHERE c_acctbal > 9900"
    add(f"sql_{_set.lower()}", lambda spark, sf, s=_statement: model(spark, sf).sql(s), _statement)


def _from(kind: str, **options) -> Query:
    """The nations, written as files of one kind and read as a table of a model."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, nations = scratch(spark, f"nations_{kind}"), model(spark, sf_dir).tables["nation"]
        nations.write.format(kind).options(**options).save(path)
        m = DataModel(spark, {"nation": tables.source(spark, kind, path, **options, **({"inferSchema": "true"} if kind == "csv" else {})), "region": model(spark, sf_dir).tables["region"]}, [Join("nation", "region", ("n_regionkey",), ("r_regionkey",))])
        return m.table("nation").aggregate([REGION], [count("nation.n_name").alias("n"), min_("nation.n_nationkey").alias("first")]).build().to_df()

    return run


for _kind, _options in (("csv", {"header": "true"}), ("json", {}), ("orc", {})):
    add(f"source_{_kind}", _from(_kind, **_options), f"SELECT r_name AS region__r_name, count(n_name) AS n, CAST(min(n_nationkey) AS {'BIGINT' if _kind == 'json' else 'INTEGER'}) AS first FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = DataModel(spark, {"kinds": tables.memory(spark, [("O", "open"), ("F", "filled")], "k string, name string"), "orders": model(spark, sf_dir).tables["orders"]}, [Join("orders", "kinds", ("o_orderstatus",), ("k",))])
    return m.table("orders").aggregate(["kinds.name"], [count().alias("n")]).build().to_df()


add("source_memory", _memory, "SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS kinds__name, count(*) AS n FROM orders GROUP BY 1")


FLAGSHIP = {"measures": ["revenue", "orders_seen"], "groups": [REGION], "havings": _where("revenue", ">", 0), "sorts": [["revenue", "desc"]]}
agg("flagship", FLAGSHIP, SQL["agg_join_3hop"])

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "model", "rollup_model"]
