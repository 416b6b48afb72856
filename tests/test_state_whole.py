"""Deep chains of parents."""

from leafmill.operators import state


def test_deep_chain_is_no_cycle(spark, rows):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(200)] + [("x", "y"), ("y", "x"), ("z", "n000")]
    assert rows(state.parent_cycles(spark.createDataFrame(chain, "id string, parent string"))) == [("x",), ("y",)]
    around = [(f"c{i:03}", f"c{(i + 1) % 150:03}") for i in range(150)]
    assert len(rows(state.parent_cycles(spark.createDataFrame(chain + around, "id string, parent string")))) == 152
    assert rows(state.parent_cycles(spark.createDataFrame(chain[:200], "id string, parent string"))) == []
