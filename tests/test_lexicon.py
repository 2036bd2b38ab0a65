"""Common words beside initials: what the veto takes, what it leaves, and what that does to precision."""

from pyspark.sql import functions as F

from incognita import cluster
from incognita.functions import morphology as mo
from incognita.operators import lexicon, names
from incognita.operators.replace import MAPPING
from incognita.plans import jobs

PEOPLE = ["Иванов", "Ким", "Гофман", "Петренко", "Чайковский", "Юнг", "Ли", "Вишневская"]
THINGS = ["Отчёт", "Приложение", "Протокол", "Договор", "Вестник", "Накладная", "Акт", "Смета"]
SMALL = ["к отчёту приложен протокол, отчёт готов", "в приложение и приложение внесён договор", "договор, акт и смета", "акт, смета и протокол", "вестник и вестник, накладная и накладная", "иванов и иванов пишут с маленькой"]


def fragments(spark, texts):
    cluster.prepare(spark)
    return spark.createDataFrame([(0, i, t, None) for i, t in enumerate(texts)], "doc_id long, frag_id long, text string, hint string").checkpoint()


def mentioned(spark, rows, words=None):
    parts = names.parsed(names.mentions(rows).select("mention").distinct()).checkpoint()
    return {r.sur for r in parts.collect()}, {r.sur for r in lexicon.veto(parts, rows, words).collect()}


def test_precision_before_and_after(spark):
    rows = fragments(spark, [f"Смотри: {w} А. Б., см." for w in PEOPLE + THINGS] + SMALL)
    before, after = mentioned(spark, rows)
    assert before == {*PEOPLE, *THINGS} and after == set(PEOPLE)


def test_cases_of_common_words(spark):
    """Протокола, Сметы, Актом: the texts write the words small in other cases."""
    rows = fragments(spark, ["нет Протокола А. Б.", "нет Сметы В. Г.", "вместе с Актом Д. Е.", "нет Кима Ж. З.", *SMALL])
    assert mentioned(spark, rows)[1] == {"Кима"}


def test_full_names_and_cells_stay(spark):
    rows = fragments(spark, ["Акт Иван Петрович", *SMALL, None, ""])
    assert mentioned(spark, rows)[1] == {"Акт"}


def test_once_is_not_common_and_a_dictionary_counts(spark):
    rows = fragments(spark, ["Лист А. Б.", "каждый лист"])
    assert mentioned(spark, rows)[1] == {"Лист"}
    assert mentioned(spark, rows, spark.createDataFrame([("лист", 1)], "word string, small long"))[1] == set()
    assert mentioned(spark, fragments(spark, [None, ""]))[1] == set()


def test_hyphens_and_initials_are_no_small_words(spark):
    rows = fragments(spark, ["лист-ок п.лист Лист ЛИСТ лист. лист2"])
    assert {r.word: r.small for r in lexicon.small_counts(rows).collect()}["лист"] == 1


def test_surname_endings(spark):
    words = {"Иванов": True, "Ивановым": True, "Сидорин": True, "Чайковского": True, "Шевченко": True, "Черных": True, "Толстая": False, "Отчёт": False, "Протоколом": False, "Ким": False, "Вишневскую": True}
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in rows.select("w", mo.is_surname_like(F.col("w")).alias("s")).collect()} == words


def test_jobs_leave_common_words_alone(spark):
    texts = ["Смотри Отчёт А. Б.", "Согласовал Ким А. Б.", *SMALL]
    rows = fragments(spark, texts)
    known = jobs.learn(rows, spark.createDataFrame([], MAPPING), "s")
    copies = jobs.obfuscate(rows, known).checkpoint()
    told = {r.frag_id: r.new_text for r in copies.collect()}
    assert told[0] == texts[0] and "Ким" not in told[1] and [told[i + 2] for i in range(len(SMALL))] == SMALL
    left = jobs.check(copies.select("doc_id", "frag_id", F.col("new_text").alias("text"), "hint"), known)
    assert left.count() == 0


def test_all_parts_of_long_names_are_declined(spark):
    name = "-".join(["Иванов"] * 14)
    got = spark.range(1).select(mo.decline_surname(F.lit(name), F.lit("m"))).first()[0]
    assert got[1] == "-".join(["Иванова"] * 14)


def test_words_are_summed_before_they_meet_those_asked(spark):
    """A frequent word is not sent row by row to the one task that has it, where the words asked are too many to be sent to all tasks."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([("лист и лист",), ("отчёт, лист",), (None,)], "text string")
        counts = lexicon.small_counts(rows, spark.createDataFrame([("лист",), ("отчет",), ("акт",)], "word string"))
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        texts = plan[plan.index("LeftSemi") :]
        assert texts.index("Aggregate") < texts.index("regexp_extract_all")
        assert {r.word: r.small for r in counts.collect()} == {"лист": 3, "отчет": 1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
