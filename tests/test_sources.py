"""Archives, delimiters, rows with too many or too few fields, integrity, sinks, schema documents."""

from __future__ import annotations

import datetime as dt
import zipfile
from pathlib import Path

import pytest

from caseloom.quality import report, schema_docs
from caseloom.sources import ingest, sinks


def test_ingest(spark, tmp_path):
    text = "1\ta\t\"x \"\"y\"\"\"\n2\tb\n3\tc\td\te\n"
    with zipfile.ZipFile(tmp_path / "COMPLAINTS_1.zip", "w") as z:
        z.writestr("one.txt", text)
        z.writestr("readme.md", "no")
    found = ingest.find_archives(str(tmp_path), ["complaint"])
    df, manifest = ingest.ingest_archives(spark, found, str(tmp_path / "work"), ["id", "v", "w"])
    assert [(r["id"], r["w"], r["source_zip"], r["source_file"]) for r in df.orderBy("id").collect()] == [("1", 'x "y"', "COMPLAINTS_1.zip", "one.txt"), ("2", None, "COMPLAINTS_1.zip", "one.txt")]
    assert manifest[0]["delimiter"] == "\t"
    with pytest.raises(ValueError, match="no archive"):
        ingest.ingest_archives(spark, [], str(tmp_path), ["id"])


def test_member_outside_the_target(tmp_path):
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError, match="outside"):
        ingest.extract_archive(tmp_path / "bad.zip", tmp_path / "t")


@pytest.mark.parametrize(("text", "sep"), [("a|b|c\n", "|"), ("\n\na,b\n", ","), ("abc\nx|y\n", "|"), ("abc", "\t"), ("a\tb|c", "\t"), ("", "\t")])
def test_delimiter(tmp_path, text, sep):
    path = tmp_path / "t.txt"
    path.write_text(text)
    assert ingest.detect_delimiter(path) == sep


def test_encoding(tmp_path):
    (tmp_path / "l").write_bytes("é".encode("latin-1"))
    (tmp_path / "u").write_bytes("é".encode())
    assert (ingest.detect_encoding(tmp_path / "l"), ingest.detect_encoding(tmp_path / "u")) == ("ISO-8859-1", "UTF-8")


def test_integrity(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n)
    hashes = ingest.file_hashes(spark, str(tmp_path))
    wanted = spark.createDataFrame([("a", ingest.sha256_of(tmp_path / "a")), ("b", "0"), ("d", "1")], "file_name string, sha256 string")
    assert {(r["file_name"], r["state"]) for r in ingest.integrity(wanted, hashes).collect()} == {("b", "changed"), ("c", "extra"), ("d", "missing")}


def test_light_typing(spark):
    df = spark.createDataFrame([(" ", "20200102", "x", "2019.0"), ("a", "bad", "y", None)], "t string, date_received string, incident_kind string, model_year string")
    out = ingest.light_typing(df)
    assert dict(out.dtypes) == {"t": "string", "date_received": "date", "incident_kind": "string", "model_year": "int"}
    assert out.first()["t"] is None and out.first()["date_received"] == dt.date(2020, 1, 2)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"')], "i int, s string")
    for name in ("t.csv", "t.parquet", "t.json"):
        path = sinks.write_frame(df, str(tmp_path / name))
        assert ingest.load_frame(spark, path).first()["s"] == 'a,"b"'
    sinks.write_json({"a": float("nan"), "d": dt.date(2020, 1, 1), "p": Path("x"), "t": (1, 2)}, str(tmp_path / "m.json"))
    assert sinks.load_json(str(tmp_path / "m.json")) == {"a": None, "d": "2020-01-01", "p": "x", "t": [1, 2]}
    with pytest.raises(ValueError, match="lacks a.b"):
        sinks.require_fields({"a": {}}, ["a.b"])
    assert sinks.replace_between("x<s>old<e>y", "<s>", "<e>", "new") == "x<s>\nnew\n<e>y"


DOC = """FIELDS
1  CMPLID      CHAR(9)   UNIQUE NUMBER
                         CONTINUED
2  CRASH       CHAR(1)   'Y' OR 'N'
3  FAILDATE    CHAR(8)   DATE OF INCIDENT (YYYYMMDD)
4  DRIVE_TRAIN CHAR(4)   DRIVE TRAIN TYPE [AWD,4WD,FWD,RWD]
5  CMPL_TYPE   CHAR(4)   SOURCE OF COMPLAINT CODE:
                         CAG  =CONSUMER ACTION GROUP
                         EVOQ =HOTLINE
6  MILES       NUMBER(7) MILEAGE"""


def test_schema_document():
    specs = {s.name: s for s in schema_docs.parse_schema(DOC)}
    assert list(specs) == ["cmplid", "crash", "faildate", "drive_train", "cmpl_type", "miles"]
    assert specs["crash"].is_yes_no and specs["faildate"].is_date and specs["drive_train"].codes == ["AWD", "4WD", "FWD", "RWD"] and specs["cmpl_type"].codes == ["CAG", "EVOQ"]
    assert schema_docs.allowed_values(specs["crash"]) == ["N", "Y"] and schema_docs.allowed_values(specs["miles"]) is None
    assert schema_docs.spark_schema(list(specs.values()))["miles"].metadata["size"] == 7
    assert schema_docs.detect_schema(["cmplid", "crash", "miles"], {"complaints": list(specs)}) == "complaints"
    assert schema_docs.detect_schema(["zzz"], {"complaints": list(specs)}) is None
    with pytest.raises(ValueError):
        schema_docs.parse_schema("nothing")


def test_rows_of_other_length(spark, tmp_path):
    """Short rows are padded; long ones are skipped even if their first surplus field is empty; quoted delimiters do not count."""
    path = tmp_path / "rows.txt"
    path.write_text('1\t2\n3\n5\t6\t\tx\n7\t8\t9\n"a\tb"\t"c ""d"""\n5\t6\t\n\tz\n')
    rows = ingest.read_delimited(spark, str(path), ["a", "b"], "\t", "UTF-8")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("1", "2"), ("3", None), ("a\tb", 'c "d"'), (None, "z")], key=str)
    assert rows.select("b").count() == 4 and rows.count() == 4


def test_duplicate_rows_tells_nulls_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("b", "b"), ("b", "b"), (None, None)], "x string, y string")
    assert tuple(report.duplicate_rows(df).first()) == (1, 5)


def test_column_audit_of_long_values(spark):
    df = spark.createDataFrame([("x" * 500,), ("x" * 500,), ("1" * 40,), (None,)], "t string")
    assert tuple(report.column_audit(df).first()) == ("t", 4, 1, 0.25, 2, round(1 / 3, 6))
