"""Plans of fitted operators stay small: what is read several times is written."""

from podium.llm import toxicity


def test_backoff_plan_grows_by_as_much_with_each_order(spark):
    grams = spark.createDataFrame([(i * 7919 % (1 << 32), 1 + i % 3) for i in range(200)], "gram long, left long")

    def scans(order):
        plan = toxicity.shared_backoff(grams, order)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Aggregate")

    assert scans(4) - scans(3) == scans(3) - scans(2) == 1
