"""Files as fragments, and a stream against the batch job."""

import io
import zipfile

from pyspark.sql import functions as F

from incognita.operators.replace import MAPPING
from incognita.plans import jobs
from incognita.sources import files
from incognita.streaming import incremental


def _zip(path, parts):
    with zipfile.ZipFile(path, "w") as out:
        for name, body in parts.items():
            out.writestr(name, body)


def make_folder(tmp_path):
    folder = tmp_path / "in box"
    folder.mkdir()
    (folder / "a.txt").write_bytes("Иванов И.И.\nвторая".encode("cp1251"))
    (folder / "b.csv").write_bytes("﻿Отчёт;;\r\nКонтрагент;БИН;Сумма\r\nТОО «АБ»;123456789012;87011234567\r\n".encode())
    (folder / "~$b.csv").write_text("x")
    (folder / ".hidden").write_text("x")
    (folder / "c.pdf").write_bytes(b"%PDF")
    (folder / "broken.docx").write_bytes(b"no zip")
    word = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Ро</w:t></w:r><w:r><w:t>машка</w:t><w:tab/><w:t>два</w:t></w:r></w:p><w:p/></w:body></w:document>'
    _zip(folder / "d.docx", {"word/document.xml": word})
    sheet = '<worksheet><sheetData><row r="3"><c r="B3" t="s"><v>0</v></c><c r="C3"><v>850101300017</v></c><c r="AA3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    _zip(folder / "e.xlsx", {"xl/sharedStrings.xml": "<sst><si><r><t>Общ</t></r><r><t>ий</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    return str(folder)


def test_files_become_fragments(spark, tmp_path):
    found = files.read_fragments(files.scan(spark, make_folder(tmp_path)))
    rows = {(r.path.rsplit("/", 1)[1], r.row, r.col): (r.text, r.error) for r in found.collect()}
    assert rows[("a.txt", 0, 0)] == ("Иванов И.И.", None)
    assert rows[("b.csv", 2, 1)] == ("123456789012", None)
    assert rows[("d.docx", 0, 0)][0] == "Ромашка" and rows[("d.docx", 0, 1)][0] == "два"
    assert rows[("e.xlsx", 2, 1)][0] == "Общий" and rows[("e.xlsx", 2, 26)][0] == "in" and rows[("e.xlsx", 2, 2)][0] == "850101300017"
    assert "unsupported" in rows[("c.pdf", None, None)][1] and "BadZipFile" in rows[("broken.docx", None, None)][1]
    assert not any(name.startswith(("~", ".")) for name, _, _ in rows)


def test_hints_come_from_the_header_row(spark, tmp_path):
    cells = files.with_hints(files.read_fragments(files.scan(spark, make_folder(tmp_path))).filter("path like '%b.csv'"))
    rows = {(r.row, r.col): (r.hint, r.header) for r in cells.collect()}
    assert rows[(2, 0)] == ("org", "Контрагент") and rows[(2, 1)] == ("bin", "БИН") and rows[(2, 2)] == (None, "Сумма") and rows[(1, 1)] == (None, None)


def test_numbers_in_cells(spark):
    rows = spark.createDataFrame([("123",), ("123.0",), ("8.5E+11",), ("1.5",), ("x",), ("8.50101300017E11",)], "v string")
    assert [r.n for r in rows.select(files.numeric_text(F.col("v")).alias("n")).collect()] == ["123", "123", "850000000000", None, None, "850101300017"]


def test_stream_equals_batch(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    rows = [(i, 0, f"тел. +7 (701) 123-45-{i % 7:02d}, user{i % 5}@firma.kz, ТОО «Ромашка{i % 3}»", None) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, frag_id long, text string, hint string")
    source, state, out = f"{tmp_path}/source", f"{tmp_path}/state", f"{tmp_path}/out"
    frame.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    incremental.start(stream, state, out, f"{tmp_path}/checkpoint", "k").awaitTermination(600)
    mapping = incremental.read_mapping(spark, state).checkpoint()
    assert mapping.groupBy("family", "key").count().filter("count > 1").isEmpty() and mapping.groupBy("family", "fake").count().filter("count > 1").isEmpty()
    streamed = sorted(tuple(r) for r in spark.read.parquet(out).select("doc_id", "text").collect())
    known = jobs.learn(frame, mapping, "k", people=incremental.read_people(spark, state))
    whole = sorted(tuple(r) for r in jobs.obfuscate(frame, known).select("doc_id", F.col("new_text").alias("text")).collect())
    assert streamed == whole and not any("+7 (701) 123" in t or "Ромашка" in t for _, t in streamed)
    assert known.mapping.count() == mapping.count() and set(mapping.columns) == {c.split()[0] for c in MAPPING.split(", ")}


def test_stream_learns_people_and_tells_what_to_redo(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    kind = "doc_id long, frag_id long, text string, hint string"
    batches = [[(1, 0, "Звоните Иванову завтра", None), (2, 0, "ничего", None)], [(3, 0, "Принят Иванов Сергей Петрович.", None)], [(4, 0, "Передано Иванову С.П.", None)]]
    state, out = f"{tmp_path}/state", f"{tmp_path}/out"
    incremental.begin(spark, state, out)
    for batch, rows in enumerate(batches):
        incremental.process_batch(spark.createDataFrame(rows, kind), batch, state, out, "k")
        incremental.process_batch(spark.createDataFrame(rows, kind), batch, state, out, "k")
    copies = {r.doc_id: r.text for r in spark.read.parquet(out).collect()}
    people = incremental.read_people(spark, state).collect()
    assert len(people) == 1 and people[0].sur == "Иванов" and people[0].patr == "Петрович"
    assert copies[1] == "Звоните Иванову завтра" and "Иванов" not in copies[3] + copies[4] and copies[3].split()[1][:4] == copies[4].split()[1][:4]
    again = {r.doc_id: r.new_text for r in incremental.redo(spark.createDataFrame(sum(batches, []), kind), state, "k").collect()}
    assert set(again) == {1} and "Иванов" not in again[1] and again[1].split()[1][:4] == copies[4].split()[1][:4]


def test_decode():
    assert files.decode(io.BytesIO("да".encode("cp1251")).read()) == "да"
