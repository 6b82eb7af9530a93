import json

from pyspark.sql import functions as F

from waypost import sinks
from waypost.operators import views
from waypost.sources import documents, locations

CSV = "Loc No.,Location Name,Address,City/Town,State/Province,Postal Code,Latitude,Department\n1,Oak Clinic,\"12 Oak St, Suite 5\",Plano,texas,03060,,Billing\n2,Elm,9 Western Ave,Waco,TX,76701,x,\n"


def test_load(spark, tmp_path):
    (tmp_path / "l.csv").write_text(CSV)
    got = locations.load_locations(spark, "csv", path=str(tmp_path / "l.csv")).orderBy("ref_ord").collect()
    assert [r["id"] for r in got] == ["1", "2"] and got[0]["address1"] == "12 Oak St" and got[0]["address2"] == "Suite 5"
    assert got[0]["state"] == "TX" and got[0]["postal_code"] == "03060" and got[0]["latitude"] == 0.0 and got[0]["department"] == "Billing"
    assert got[1]["address1"] == "9 Western Ave" and got[1]["latitude"] is None and got[1]["department"] is None and got[1]["country"] == "US"
    lenient = locations.from_rows(spark.createDataFrame([("", "A", "x")], "NAME string, facility_name string, ADDR1 string"), lenient=True).first()
    assert lenient["name"] == "A" and lenient["address1"] == "x"
    assert locations.health(spark.range(1))["ok"]


MAIL = b"From: A B <a@example.org>\r\nTo: c@example.org\r\nSubject: Hi\r\nDate: Mon, 01 Jan 2024 10:00:00 +0000\r\nMessage-ID: <1@x>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=z\r\n\r\n--z\r\nContent-Type: text/plain\r\n\r\nbody\r\n--z\r\nContent-Type: application/pdf; name=a.pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nQUJD\r\n--z--\r\n"


def test_documents(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(MAIL)
    (tmp_path / "b.TXT").write_text("text")
    (tmp_path / "c.doc").write_text("no")
    got = {r["file"].rsplit("/", 1)[1]: r["text"] for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["b.TXT"] == "text" and got["a.eml"].startswith("Hi\nbody") and len(got) == 2
    m = documents.parsed_emails(documents.list_files(spark, str(tmp_path))).first()
    assert m["subject"] == "Hi" and m["attachments"][0]["filename"] == "a.pdf" and bytes(m["attachments"][0]["content"]) == b"ABC"
    assert documents.parse_email(None) is None
    r = documents.lookup_request(spark.createDataFrame([('{"name":"x","state":"tx","postal":"75001-1"}',)], "body string")).first()
    assert (r["name"], r["state"], r["postal_code"]) == ("x", "TX", "75001")


def test_views_and_sinks(spark):
    rows = [(1, "A", "X", "TX", 1.0, 2.0), (2, "", "X", "TX", 0.0, 2.0), (3, "B", "Y", "OK", None, None)]
    df = spark.createDataFrame(rows, "ref_ord long, name string, city string, state string, latitude double, longitude double")
    assert [tuple(r)[:2] for r in views.by_state(df).collect()] == [("TX", 2), ("OK", 1)]
    assert tuple(views.coverage(df).first()) == (3, 2, 1, 66.7, 33.3) and views.coverage(df.limit(0)).first()["pct_names"] is None
    assert views.by_city(df, 1).first()["city_state"] == "X, TX" and views.in_place(df, "tx").count() == 2
    assert df.select(views.table_line().alias("t")).first()["t"].endswith("1.0000, 2.0000")
    doc = F.struct(*[F.lit(v).cast("string").alias(c) for c, v in (("name", "n"), ("address1", "a"), ("address2", None), ("city", "c"), ("state", "S"), ("postal_code", "1"))])
    res = spark.range(2).select(F.lit("f").alias("file"), F.lit("1\n2\n3\n4").alias("block"), F.col("id").alias("ord"), doc.alias("doc"), F.lit("NEW").alias("status"), *[F.lit(None).cast("string").alias(c) for c in ("mr8_id", "scores", "diffs", "explanation", "record")])
    assert sinks.new_items(res).count() == 1
    j = json.loads(sinks.json_lines(res).first()["value"])
    assert j["block"] == "1 2 3" and j["match"]["mr8_id"] is None
