from pyspark.sql import functions as F

from incognita.operators import paths


def test_components_are_replaced_once_and_paths_stay_apart(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    swap = {"Иванов": "Орлов", "Петров": "Орлов", "Ким": "а/б"}
    seen = []

    def replaced(fragments):
        seen.extend(r.text for r in fragments.collect())
        table = F.map_from_arrays(F.array(*map(F.lit, swap)), F.array(*map(F.lit, swap.values())))
        return fragments.withColumn("new_text", F.coalesce(F.element_at(table, F.col("text")), "text"))

    given = ["дела/Иванов/акт.txt", "дела/Петров/акт.txt", "дела/Орлов/акт (2).txt", "дела/Орлов/акт.txt", "Ким.csv", "/a//Иванов", ".Иванов", "Иванов.", "", None, "Ким.csv"]
    found = {r.path: r.new_path for r in paths.map_paths(spark.createDataFrame([(p,) for p in given], "path string"), replaced).collect()}
    assert found == {
        "дела/Иванов/акт.txt": "дела/Орлов/акт.txt", "дела/Орлов/акт.txt": "дела/Орлов/акт (3).txt", "дела/Петров/акт.txt": "дела/Орлов/акт (4).txt", "дела/Орлов/акт (2).txt": "дела/Орлов/акт (2).txt",
        "Ким.csv": "а-б.csv", "/a//Иванов": "/a//Орлов", ".Иванов": ".Иванов", "Иванов.": "Орлов.", "": "", None: None,
    }
    assert len(seen) == len(set(seen)) and "" not in seen


def test_no_paths(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert paths.number_clashes(spark.createDataFrame([], "path string, new_path string")).isEmpty()
