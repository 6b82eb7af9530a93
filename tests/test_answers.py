import pytest
from pyspark.sql import functions as F

from waypost.operators import answers, match

REFS = [(1, "1", "Oak Clinic", "200 Oak Ave", None, "Plano", "TX", "75023", "OAK", None, None), (2, "2", "Elm Hospital", "1 Elm Rd", None, "Waco", "TX", "76701", None, None, None)]
COLS = "ref_ord long, id string, name string, address1 string, address2 string, city string, state string, postal_code string, search_key string, department string, warning string"
TEXT = "Oak Clinic\n200 Oak Ave\nPlano, TX 75023\n\nElm Hospital\n1 Elm Rd\nWaco, TX 76701\n\nZoo\n9 Elm Rd\nWaco, TX 76701\n"


def test_documents_to_answers(spark):
    refs = spark.createDataFrame(REFS, COLS)
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "no block")], "doc_id long, text string").withColumn("of", F.lit(1)).withColumn("status", F.lit("x"))
    text = {r["block_ord"]: r for r in answers.reconciled_documents(docs, refs).collect()}
    assert [text[i]["status"] for i in sorted(text)] == ["EXACT", "EXACT", "NEW"] and {r["doc_id"] for r in text.values()} == {1}
    assert [text[i]["search_key"] for i in sorted(text)] == ["OAK", "elm hospital|1 elm rd|waco|tx|76701", None]
    file = answers.reconciled_documents(docs, refs, "file").collect()
    assert {r["block_ord"]: r["search_key"] for r in file} == {0: "OAK", 1: "elm hospital|1 elm rd|waco|tx|76701"}  # the zoo isn't medical
    assert answers.reconciled_documents(docs.limit(0), refs).count() == 0
    with pytest.raises(ValueError):
        answers.document_blocks(docs, "mail")


def test_exactness_and_lines(spark):
    refs = spark.createDataFrame(REFS, COLS)
    docs = spark.createDataFrame([(1, "OAK clinic", "200 oak avenue", None, "Plano", "TX", "75023", None), (2, "Elm House", "1 Elm Rd", None, "Waco", "TX", "76701", None), (3, None, None, None, None, None, None, None)], "doc_id long, name string, address1 string, address2 string, city string, state string, postal_code string, department string")
    got = {r["doc_id"]: (r["name_exact"], r["address_exact"]) for r in answers.exactness(match.reconciled(docs, refs)).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, False)}
    df = spark.createDataFrame([("Oak", True, "K"), ("Elm", False, None)], "n string, f boolean, k string")
    assert [r["x"] for r in df.select(answers.chat_line(F.col("n"), F.col("f"), F.col("k")).alias("x")).collect()] == ["Oak — FOUND — K", "Elm — RESEARCH REQUIRED"]


def test_texts_are_read_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, TEXT)], "doc_id long, text string").write.parquet(path)
    out = answers.reconciled_documents(spark.read.parquet(path), spark.createDataFrame(REFS, COLS), "file")
    assert out.count() == 2 and not [f for f in out.inputFiles() if "/docs/" in f]
