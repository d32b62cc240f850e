from tributary.operators.review import apply_review


def test_exact_then_nearest_once(spark):
    flags = spark.createDataFrame(
        [(1, "gap", "P1", 0.0, 0.0), (2, "gap", None, 10.0, 0.0), (3, "gap", None, 10.5, 0.0), (4, "gap", None, None, None), (5, "slope", None, 10.0, 0.0)],
        "flag_id long, flag_type string, pipe_id string, x double, y double",
    )
    d = spark.createDataFrame(
        [(0, "gap", "P1", None, None, "keep"), (1, "gap", "P1", None, None, "resolved"), (2, "gap", None, 10.4, 0.0, "dismiss"), (3, "gap", None, 90.0, 0.0, "keep"), (4, "gap", None, None, None, "keep")],
        "ord long, flag_type string, pipe_id string, x double, y double, decision string",
    )
    got = {r.flag_id: (r.status, r.decision_ord) for r in apply_review(flags, d, 2.0).collect()}
    assert got == {1: ("resolved", 1), 2: ("dismiss", 2), 3: ("open", None), 4: ("open", None), 5: ("open", None)}
