"""Files in and out."""

import json
import zipfile
from datetime import datetime

import pytest

from cohortia.sources import files
from cohortia.sources.spss import SavFile, Variable, metadata, write_sav
from cohortia.streaming import inbox


def test_sav_round_trip(spark, tmp_path):
    path = str(tmp_path / "x.sav")
    variables = [Variable("edad_en_anios", 0, "¿Edad?"), Variable("sexo", 0, "Sexo", {"1": "Mujer", "2": "Varón"}), Variable("comentario", 20, "Otro")]
    rows = [(30, 1, "así es"), (None, 2.5, None), (41.0, None, "x" * 20)]
    assert write_sav(path, variables, iter(rows)) == 3
    files.register(spark)
    df = spark.read.format("sav_wide").load(path=path)
    assert df.columns == ["edad_en_anios", "sexo", "comentario"]
    assert [tuple(r) for r in df.collect()] == [("30", "1", "así es"), (None, "2.5", None), ("41", None, "x" * 20)]
    assert metadata(path)[1] == {"codigo": "sexo", "texto": "Sexo", "tipo": "numero", "opciones": {"1": "Mujer", "2": "Varón"}}
    with pytest.raises(ValueError):
        (tmp_path / "bad.sav").write_bytes(b"no such file")
        SavFile(str(tmp_path / "bad.sav"))


def workbook(path, rows):
    cells = lambda r, n: "".join(f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + k)}{n}"><v>{v}</v></c>' for k, v in enumerate(r) if v is not None)
    sheet = "".join(f'<row r="{n}">{cells(r, n)}</row>' for n, r in enumerate(rows, 1))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="uno" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")


def test_wide_spreadsheet(spark, tmp_path):
    path = str(tmp_path / "x.xlsx")
    workbook(path, [["id", "P1", None, "P2"], ["a", 1.0, "z", 2.5], [None, " ", "z", None], ["b", None, None, "si"]])
    files.register(spark)
    df = spark.read.format("xlsx_wide").load(path=path)
    assert df.columns == ["id", "P1", "P2"]
    assert [tuple(r) for r in df.collect()] == [("a", "1", "2.5"), ("b", None, "si")]


def test_wide_csv_and_ranking_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,P1,\na,1,z\n,,z\nb,"x, y",\n')
    assert [tuple(r) for r in files.wide_csv(spark, str(tmp_path / "x.csv")).collect()] == [("a", "1"), ("b", "x, y")]
    ranking = spark.createDataFrame([("a", 0.5), ("b", 0.4)], "p string, puntaje double")
    evidence = spark.createDataFrame([("a", "e1", "c1", "uno", 2), ("a", "e1", "c2", "dos", 1)], "p string, estudio string, codigo string, texto string, o int")
    from pyspark.sql import functions as F

    got = {r["p"]: r["evidencia"] for r in files.ranking_lines(ranking, evidence, "p", F.col("o")).collect()}
    assert got == {"a": "[e1 · c2] dos | [e1 · c1] uno", "b": None}


def test_codes_of_options(spark):
    answers = spark.createDataFrame([("a", "q", "no"), ("a", "m", "x"), ("a", "m", "y"), ("b", "q", "?")], "k string, c string, v string")
    got = {r["k"]: (r["q"], r["m_1"], r["m_2"]) for r in files.options_to_columns(answers, "k", "c", "v", {"q": ["si", "no"], "m": ["x", "y"]}, {"m"}).collect()}
    assert got == {"a": (2, 1, 1), "b": (None, None, None)}


def test_inbox_keeps_each_notice_once_and_the_latest_status(spark, tmp_path):
    source, table, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    source.mkdir()

    def deliver(name, notices):
        (source / name).write_text("".join(json.dumps({"cuerpo": b if isinstance(b, str) else json.dumps(b), "recibido_en": f"2024-01-01T0{n}:00:00"}) + "\n" for n, b in enumerate(notices)))

    one = {"mensaje": "m1", "estado": "sent", "en": "2024-01-01 00:00:00"}
    deliver("1.json", [one, one, {"mensaje": "m1", "estado": "read", "en": "2024-01-01 02:00:00"}, "no json"])
    inbox.run_inbox(spark, str(source), table, checkpoint).awaitTermination()
    deliver("2.json", [{"mensaje": "m1", "estado": "delivered", "en": "2024-01-01 01:00:00"}, {"mensaje": "m2", "estado": "sent", "en": "2024-01-01 01:00:00"}])
    inbox.run_inbox(spark, str(source), table, checkpoint).awaitTermination()
    got = {r["mensaje"]: r["estado"] for r in inbox.latest(inbox.current_statuses(spark, table)).collect()}
    assert got == {"m1": "read", "m2": "sent"}
    assert sorted((r["mensaje"], r["estado"]) for r in inbox.current_statuses(spark, table).collect()) == [("m1", "delivered"), ("m1", "read"), ("m1", "sent"), ("m2", "sent")]
    assert [r["cuerpo"] for r in inbox.failed_notices(spark, table).collect()] == ["no json"]
    for k, (n, hour) in enumerate([("m1", 5), ("m1", 6), ("m1", 7)]):  # versions that newer ones have replaced are deleted
        deliver(f"{3 + k}.json", [{"mensaje": n, "estado": "read", "en": f"2024-01-01 0{hour}:00:00"}])
        inbox.run_inbox(spark, str(source), table, checkpoint).awaitTermination()
    assert {(r["mensaje"], r["estado"]): r["en"].hour for r in inbox.current_statuses(spark, table).collect()}["m1", "read"] == 7
    parts = inbox._written(spark, table)
    assert max(sum(p in own for own in parts.values()) for p in {p for own in parts.values() for p in own}) == 2
    stored = inbox.parsed(spark.createDataFrame([("no json", datetime(2024, 1, 1)), (json.dumps(one), datetime(2024, 1, 1))], "cuerpo string, recibido_en timestamp"))
    assert sorted(r["estado_aviso"] for r in stored.collect()) == ["fallido", "procesado"]
    assert inbox.reprocessed(stored).count() == 1


def test_calls_in_windows_of_days(spark):
    stream = spark.createDataFrame([("a", datetime(2024, 1, 1, 3)), ("a", datetime(2024, 1, 1, 9)), ("a", datetime(2024, 2, 1)), ("a", datetime(2024, 6, 1)), ("b", datetime(2024, 1, 5))], "persona string, en timestamp")
    days = inbox.calls_by_day(stream)
    assert sorted((r["persona"], str(r["hasta"]), r["llamados"]) for r in inbox.calls_in_window(days).collect()) == [("a", "2024-01-01", 2), ("a", "2024-02-01", 3), ("a", "2024-06-01", 1), ("b", "2024-01-05", 1)]


def test_batches_and_late_changes(spark):
    df = spark.createDataFrame([(k,) for k in range(10)], "v int")
    assert sorted((r["v"], r["lote"]) for r in inbox.numbered(df, 4, ["v"]).collect()) == [(v, v // 4) for v in range(10)]
    old = spark.createDataFrame([("a", 5), ("a", 9)], "k string, t int")
    assert [r["t"] for r in inbox.late_changes(old, spark.createDataFrame([("a", 7), ("a", 12), ("b", 1)], "k string, t int"), ["k"], "t").collect()] == [7]
