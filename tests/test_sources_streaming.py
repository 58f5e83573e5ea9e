import io
import zipfile

from pyspark.sql import functions as F

from palimpsest.operators import harvest, surrogates
from palimpsest.sources import files
from palimpsest.streaming import redact

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOC = f"<w:document {W}><w:body><w:p><w:r><w:t>Ja</w:t></w:r><w:r><w:t>ne</w:t><w:tab/><w:t>Roe</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>SSN</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>900</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"


def docx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", DOC)
        z.writestr("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.docx").write_bytes(docx())
    (tmp_path / "a/broken.docx").write_bytes(b"no zip")
    (tmp_path / "y.txt").write_text("plain é")
    (tmp_path / "m.eml").write_text("From: a@example.com\nSubject: hi\n\nbody\n")
    (tmp_path / "z.bin").write_bytes(b"\0")
    (tmp_path / "~$x.docx").write_bytes(b"")
    found = files.gather(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.supported for r in found.collect()} == {"x.docx": True, "broken.docx": True, "y.txt": True, "m.eml": True, "z.bin": False}
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.texts(found).collect()}
    assert got["x.docx"].split("\n")[0] == "Jane Roe" and "Head" in got["x.docx"] and got["broken.docx"] == "" and got["y.txt"] == "plain é" and "From: a@example.com" in got["m.eml"]
    assert files.docx_cells(docx()) == [(0, 0, 0, "SSN"), (0, 0, 1, "900")]
    assert files.rtf_text(rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par W\'e9}") == "Hello\nWé"


def test_names_of_files(spark):
    df = spark.createDataFrame([("/a/Jane_Roe stmt.pdf",), ("/a/ok.pdf",), ("/b/JaneRoe.pdf",), ("/a/OK.pdf",)], "path string")
    got = {r.path: r["name"] for r in files.scrub_names(df, ["Jane Roe"]).collect()}
    assert got == {"/a/Jane_Roe stmt.pdf": "document_01.pdf", "/b/JaneRoe.pdf": "document_02.pdf", "/a/OK.pdf": "OK.pdf", "/a/ok.pdf": "ok_2.pdf"}


def test_sheet_and_key(spark, tmp_path):
    df = spark.createDataFrame([('{"parties":[{"role":"owner","names":["Jane Roe"],"ssn":["123-45-6789"],"accounts":[{"number":"1234"}]}]}',), ("broken",)], "json string")
    assert {tuple(r) for r in files.party_sheet(df).collect()} == {("owner", "name", "Jane Roe"), ("owner", "ssn", "123-45-6789"), ("owner", "account", "1234")}
    m = spark.createDataFrame([("person", "=Jane", 1)], "category string, canonical string, occurrences int")
    files.write_mapping(m, str(tmp_path / "m"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "m/csv")).first()["canonical"] == "'=Jane"
    e = files.encrypt(m, "canonical", "pw", b"salt", 1000)
    assert e.first()["canonical"] != "=Jane" and files.decrypt(e, "canonical", "pw", b"salt", 1000).first()["canonical"] == "=Jane"


def test_surrogates(spark):
    names = ["Jane Roe", "John Roe", "Mary Larsen", "Albeth Almont"]
    made = surrogates.assign(names, b"s")
    assert made == surrogates.assign(names, b"s") and len(set(made.values())) == 4
    assert made["Jane Roe"].split()[1] == made["John Roe"].split()[1] != made["Mary Larsen"].split()[1]
    assert not {w for n in made.values() for w in n.split()} & {w for n in names for w in n.split()}
    df = spark.createDataFrame([("c1", n) for n in names] + [("c2", "Jane Roe"), ("c2", None)], "set_id string, name string")
    assert surrogates.surrogates(df, b"s").count() == 5
    assert list(surrogates.match_all(["Jane Roe met Mary Larsen"], made)) == [f"{made['Jane Roe']} met {made['Mary Larsen']}"]


def test_harvest(spark):
    text = "JANE Q ROE,\nPetitioner\nJudge Anna Keller presiding. Zelle payment to Peter Novak. He resides in Salt Lake City."
    df = spark.createDataFrame([(1, text), (2, None), (3, "Zelle payment to Peter Novak")], "doc_id long, text string")
    out = harvest.best_evidence(harvest.harvest(df))
    got = {(r.kind, r.value): r.documents for r in out.collect()}
    assert got[("counterparty", "Peter Novak")] == 2 and ("official", "Anna Keller") in got and ("place", "Salt Lake City") in got
    known = spark.createDataFrame([("peter novak",)], "value string")
    assert not [r for r in harvest.best_evidence(harvest.harvest(df), known).collect() if r.value == "Peter Novak"]
    assert harvest.harvest(df, lambda v: [False] * len(v)).count() == 0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "mail a@example.com", "2024-01-01 00:01:00"), (2, "b@example.com and a@example.com", "2024-01-01 00:07:00")], "doc_id long, text string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = redact.redact_stream(stream, ("email",)).writeStream.format("memory").queryName("redacted").start()
    q.processAllAvailable()
    q.stop()
    assert {r.text for r in spark.table("redacted").collect()} == {"mail [EMAIL]", "[EMAIL] and [EMAIL]"}
    q = redact.keep_registry(stream, str(tmp_path / "reg"), ("email",)).start()
    q.processAllAvailable()
    q.stop()
    assert {r.canonical: r.occurrences for r in redact.read_registry(spark, str(tmp_path / "reg")).collect()} == {"a@example.com": 2, "b@example.com": 1}
    q = redact.count_findings(stream, ("email",), "ts").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.findings for r in spark.table("counted").collect()) == [1, 2]
