"""Emphasis that a translation lost, added or kept."""

from leafmill.operators import gates


def test_emphasis_parity(spark, rows):
    block = "book_id string, pos int, id string, type string, level int, text string, target string, page int"
    texts = [("a *b* c", "a b c"), ("a b", "a **b**"), ("*a* `x`", "*b* `x`"), ("3 * 4", "3 * 4"), (r"a \*b\*", "*a*"), ("*a*", ""), (None, "*a*"), ("`x*y*z`", "`x*y*z`"), ("*ab*[[fn:fn0001]]", "*ab[[fn:fn0001]]*"), ("*`x`*", "`x`")]
    data = [("x", n, f"b{n}", "paragraph", None, s, t, 1) for n, (s, t) in enumerate(texts)]
    found = gates.parity_gate(spark.createDataFrame(data, block)).where("code = 'emphasis-parity'")
    assert rows(found.select("severity", "unit", "detail")) == [("warning", "b0", "(0, 1, 0) -> (0, 0, 0)"), ("warning", "b1", "(0, 0, 0) -> (1, 0, 0)"), ("warning", "b4", "(0, 0, 0) -> (0, 1, 0)")]
