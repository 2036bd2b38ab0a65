"""Values are put in their written form once each, and only where there is one to put."""

from incognita.operators.replace import looked_up


def test_written_form_is_worked_out_once(spark):
    kind = "doc_id long, frag_id long, prio int, start int, end int, typ string, family string, key string, old string"
    found = spark.createDataFrame([(1, 0, 9, 0, 18, "phone", "phone", "7011234567", "+7 (701) 123-45-67"), (1, 1, 3, 0, 20, "iban", "iban", "KZ86125KZT0000000001", "kz86125kzt0000000001"), (1, 2, 9, 0, 11, "phone", "phone", "7010000000", "87010000000")], kind)
    mapping = spark.createDataFrame([("phone", "phone", "7011234567", "7017654321"), ("phone", "phone", "7010000000", "7010000000")], "typ string, family string, key string, fake string")
    out = looked_up(found, mapping, restore=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    # A filter on the new value would be pushed below it and work it out again.
    assert "generate explode(" in plan and "isnotnull(new" not in plan
    # An IBAN in small letters that has no stand-in is none in capitals.
    assert [(r.frag_id, r.new) for r in out.collect()] == [(0, "+7 (701) 765-43-21")]
    back = looked_up(found, mapping, restore=True)
    assert back.collect() == []
