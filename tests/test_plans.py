"""What queries keep in memory: joins whose sides grow with the tables are not broadcast."""

from heatloom.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_perturb_needs_no_join(spark):
    """The value without noise travels in its row: no copy of the table goes to every task."""
    optimized, physical = plan(registry.queries()["perturb"](spark, SF))
    assert "Join" not in optimized and "Broadcast" not in physical


def test_idw_sends_hours_alone_to_every_task(spark):
    """Stations, readings, cells and their weights are many: only the hours' means are broadcast."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        _, physical = plan(registry.queries()["idw"](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert physical.count("BroadcastExchange") == 1 and "BroadcastHashJoin" not in physical
