import pytest

from quarry import Join, JoinGraph, QueryError


def edge(a, b, direction="rightonleft", how="left"):
    return Join(a, b, ("k",), (f"{b}.k",), how, direction)


def test_paths():
    g = JoinGraph([edge("orders", "items"), edge("items", "products"), edge("orders", "customers")])
    assert [j.right for j in g.find_path("orders", "products")] == ["items", "products"]
    assert g.find_path("orders", "orders") == () and g.find_path("products", "orders") is None
    assert [j.right for j in g.joins_for("orders", ["customers", "items", "products"])] == ["customers", "items", "products"]
    assert g.find_reachable_base(["customers", "orders"]) == "orders"
    with pytest.raises(QueryError, match="no single base table can reach all tables"):
        g.find_reachable_base(["customers", "products"])
    assert g.tables == ["customers", "items", "orders", "products"]


def test_both_directions_swap_keys():
    g = JoinGraph([Join("a", "b", ("x", "y"), ("u", "v"), "inner", "both")])
    (back,) = g.find_path("b", "a")
    assert (back.left, back.left_on, back.right_on, back.how) == ("b", ("b.u", "b.v"), ("a.x", "a.y"), "inner")


def test_cycles():
    with pytest.raises(QueryError, match="Cycle of length >= 3"):
        JoinGraph([edge("a", "b", "both"), edge("b", "c", "both"), edge("c", "a", "both")])
    with pytest.raises(QueryError, match="Cycle"):
        JoinGraph([edge("b", "c"), edge("c", "d"), edge("d", "b"), edge("a", "b")])
    diamond = JoinGraph([edge("a", "b"), edge("a", "c"), edge("b", "d"), edge("c", "d")])
    assert [j.right for j in diamond.find_path("a", "d")] == ["b", "d"]


def test_bad_joins():
    for bad in ({"how": "full"}, {"direction": "up"}, {"left_on": ()}, {"right_on": ("a", "b")}):
        with pytest.raises(QueryError):
            Join(**{"left": "a", "right": "b", "left_on": ("k",), "right_on": ("k",)} | bad)
    assert Join.from_dict({"left": "a", "right": "b", "left_on": ["k"], "right_on": ["b.k"], "how": "left", "direction": "both"}).left_on == ("a.k",)
