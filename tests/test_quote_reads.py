"""Batch quoting reads its lines for the distinct texts and for the answer, not once per step."""

from folioquery.operators import quotes


def test_lines_are_read_once_in_the_answer(spark):
    cat = spark.createDataFrame([(1, "Riego goteo", "7", "d"), (2, "Mantenimiento Pro", "8", "d")],
                                "cat_ord long, servicio string, precio_usd string, plazo_entrega string")
    lines = spark.createDataFrame([(1, 0, "RIEGO"), (2, 0, "riego goteo ya"), (3, 0, "nada"), (3, 0, "nada"), (4, 1, None)],
                                  "quote_id long, line int, requested string").cache()
    priced = quotes.quote_lines(lines, cat)
    assert priced._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1
    assert sorted(((r.quote_id, r.service) for r in priced.collect()), key=str) == [
        (1, "Riego goteo"), (2, "Riego goteo"), (3, None), (3, None), (4, None)]
    wanted = spark.createDataFrame([(1, 2, "Pro"), (2, 1, "oro"), (3, 0, None), (4, 1, None)], "quote_id long, months int, plan string").cache()
    plans = quotes.maintenance_lines(wanted, cat)
    assert plans._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1
    assert sorted((r.quote_id, r.plan_service, r.cost) for r in plans.collect()) == [
        (1, "Mantenimiento Pro", 16.0), (2, None, None), (4, "Mantenimiento Pro", 8.0)]
