import pytest

from quarry import QueryError, TableColumn, allow, exclude
from quarry.functions.columns import Pattern
from quarry.functions.expr import Col, InList, Lit, Op, aggregates, avg, col, columns, count, count_distinct, nullif, outside_aggregates, sum_
from quarry.functions.filters import filter_columns, filter_tree, prune

OPEN = {"left": {"col": "orders.o_orderstatus"}, "op": "=", "right": {"lit": "O"}}
LARGE_KEY = {"left": {"col": "orders.o_custkey"}, "op": ">", "right": {"lit": 700}}
CHEAP = {"left": {"col": "lineitem.l_extendedprice"}, "op": "<=", "right": {"col": "orders.o_totalprice"}}


def test_trees():
    assert filter_tree({"and": [OPEN, LARGE_KEY]}) == Op("and", Op("=", Col("orders.o_orderstatus"), Lit("O")), Op(">", Col("orders.o_custkey"), Lit(700)))
    assert filter_tree({"left": {"col": "a.b"}, "op": "not_in", "right": {"lit": [1, 2]}}) == InList(Col("a.b"), (Lit(1), Lit(2)), True)
    assert filter_tree({"left": {"col": "a.b"}, "op": "in", "right": {"col": "a.c"}}) == InList(Col("a.b"), (Col("a.c"),))
    assert filter_tree(None) is filter_tree({}) is filter_tree({"and": []}) is filter_tree({"or": [{"and": []}]}) is None
    assert filter_columns({"or": [OPEN, {"and": [CHEAP, LARGE_KEY]}]}) == ["orders.o_orderstatus", "lineitem.l_extendedprice", "orders.o_totalprice", "orders.o_custkey"]


@pytest.mark.parametrize("word,sign", [("eq", "="), ("ne", "!="), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")])
def test_words_are_signs(word, sign):
    assert filter_tree(OPEN | {"op": word}) == filter_tree(OPEN | {"op": sign})


@pytest.mark.parametrize("bad", [{"left": {"col": "a.b"}}, OPEN | {"op": "like"}, OPEN | {"right": {"lit": None}}, OPEN | {"right": {"lit": {}}}, OPEN | {"right": {"lit": [1]}}, {"xor": []}, OPEN | {"right": {}}, {"and": OPEN}])
def test_malformed_filters_are_errors(bad):
    with pytest.raises(QueryError):
        filter_tree(bad)


def test_prune():
    tree = filter_tree({"and": [OPEN, {"or": [CHEAP, LARGE_KEY]}]})
    assert prune(tree, lambda c: c.startswith("orders.")) == filter_tree({"and": [OPEN, LARGE_KEY]})
    assert prune(tree, lambda c: c == "orders.o_orderstatus") == filter_tree(OPEN)
    assert prune(tree, lambda c: False) is None


def test_allow_and_exclude_columns():
    context = ["orders.o_orderstatus", "lineitem.l_tax", "orders.o_custkey", "orders.o_orderstatus", "bare"]
    assert allow("orders.*", context).names == ("orders.o_custkey", "orders.o_orderstatus")
    assert allow("*", context).names == ("lineitem.l_tax", "orders.o_custkey", "orders.o_orderstatus")
    assert exclude("orders.o_custkey", context, include=["a.b"]).names == ("a.b", "lineitem.l_tax", "orders.o_orderstatus")
    assert allow(["lineitem.l_tax", "orders.o_custkey"], context).names == ("lineitem.l_tax", "orders.o_custkey")
    assert exclude("*", context).names == ()
    assert Pattern.of("*.foo").matches("a.b")
    for bad in ("orders", "a.b.c", "", "a-b.c"):
        with pytest.raises(QueryError):
            allow(bad, context)
    with pytest.raises(QueryError):
        allow("*", context, include=["bare"])


def test_allow_and_exclude_filters():
    both = {"and": [OPEN, CHEAP]}
    assert allow("orders.*", both).predicate == filter_tree(OPEN)
    assert exclude("lineitem.*", both).predicate == filter_tree(OPEN)
    assert allow("nowhere.*", both).predicate is None and allow("*", {}).predicate is None


def test_walks():
    e = (sum_("t.a") / nullif(count("t.b"), 0) + avg(col("t.c") * 2)).alias("x")
    assert columns(e) == ["t.a", "t.b", "t.c"]
    assert [a.fn for a in aggregates(e)] == ["sum", "count", "avg"]
    assert outside_aggregates(e + col("t.d")) == ["t.d"]
    assert count_distinct("t.a") != count("t.a")


def test_table_column():
    assert str(TableColumn.of("a.b_1")) == "a.b_1"
    for bad in ("a", "a.", ".b", "a.b.c", "a b.c"):
        with pytest.raises(QueryError):
            TableColumn.of(bad)
