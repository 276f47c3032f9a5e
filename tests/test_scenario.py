"""What-if scenarios: golden table for base 44, baseline rate .46."""

from flipwise.operators import scenario as SC

GOLDEN = {10: (29, 1508, 211400), 15: (25, 1300, 182000), 20: (21, 1092, 152600),
          25: (17, 884, 123900), 30: (13, 676, 94500), 35: (9, 468, 65800),
          40: (5, 260, 36400), 45: (1, 52, 7000)}


def test_capacity_golden(spark):
    base = spark.createDataFrame([(0.46,)], "baseline_rate double")
    got = {r["target_pct"]: (r["extra_per_week"], r["extra_per_year"], r["revenue"])
           for r in SC.capacity_scenarios(base).collect()}
    assert got == GOLDEN


def test_waterfall_steps(spark):
    base = spark.createDataFrame([(0.46,)], "baseline_rate double")
    w = SC.capacity_waterfall(SC.capacity_scenarios(base, targets=[20])).orderBy("step").collect()
    assert [(r["measure"], r["value"]) for r in w] == [("absolute", 44), ("relative", 21), ("total", 65)]
    assert w[1]["label"] == "Reduce flip to 20%"


def test_no_negative_capacity(spark):
    base = spark.createDataFrame([(0.10,)], "baseline_rate double")
    assert all(r["extra_per_week"] == 0 for r in SC.capacity_scenarios(base).collect())
