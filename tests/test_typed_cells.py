from incognita.operators.replace import MAPPING
from incognita.plans import jobs


def test_cells_of_people_and_organisations(spark, tmp_path):
    """Names alone in typed columns are replaced, also where text names them, and come back."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    cells = [
        ("Ромашка", "org"), ("ТОО Василёк", "org"), ("Итого", "org"), ("Иванов", "person"), ("Петров Сергей", "person"),
        ("Анна Сидорова", "person"), ("СМИРНОВ А.Б.", "person"), ("нет", "person"), ("Отчёт", None), ("Звоните Иванову", None),
    ]
    fragments = spark.createDataFrame([(1, i, text, hint) for i, (text, hint) in enumerate(cells)], "doc_id long, frag_id long, text string, hint string")
    known = jobs.learn(fragments, spark.createDataFrame([], MAPPING), "secret")
    copies = jobs.obfuscate(fragments, known).checkpoint()
    new = {r.text: r.new_text for r in copies.collect()}
    for told, name in (("Ромашка",) * 2, ("ТОО Василёк", "Василёк"), ("Иванов",) * 2, ("Петров Сергей", "Петров"), ("Петров Сергей", "Сергей"), ("Анна Сидорова", "Сидорова"), ("Анна Сидорова", "Анна"), ("СМИРНОВ А.Б.", "СМИРНОВ"), ("Звоните Иванову", "Иванову")):
        assert name not in new[told]
    assert all(new[same] == same for same in ("Итого", "нет", "Отчёт"))
    back = jobs.restore(copies.selectExpr("doc_id", "frag_id", "new_text as text", "hint"), known)
    assert sorted(r.new_text for r in back.collect()) == sorted(new)
