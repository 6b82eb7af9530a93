"""From documents to answers: blocks in texts, their canonical addresses, the matching records and search keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.functions import text as T
from waypost.operators import blocks, match
from waypost.session import staged


def document_blocks(docs: DataFrame, kind: str = "text", text: str = "text") -> DataFrame:
    """(doc_id, block_ord, block): the blocks of each document that are looked up.

    kind 'text': its candidate blocks; 'file': its facilities or, where it has none, its candidate blocks, and of these the medical ones.
    """
    if kind not in ("text", "file"):
        raise ValueError(f"no kind of document {kind!r}")
    cols = ["doc_id", "block_ord", "block"]
    candidates = blocks.candidate_blocks(docs, text).select(cols)
    if kind == "text":
        return candidates
    facilities = blocks.structured_blocks(docs, text).select(cols)
    rest = candidates.join(facilities.select("doc_id").distinct(), "doc_id", "left_anti").select(cols)
    return facilities.unionByName(rest).filter(blocks.is_medical(F.col("block")))


def reconciled_documents(docs: DataFrame, refs: DataFrame, kind: str = "text", text: str = "text") -> DataFrame:
    """(doc_id, block_ord, name_ord, status, mr8_id, search_key, explanation): an answer for each name of each block of the documents.

    doc_id must be unique. Documents without blocks have no answers; null and empty texts have none.
    """
    found = document_blocks(docs, kind, text).select("doc_id", "block_ord", T.normalize_block(F.col("block")).alias("p")).select("doc_id", "block_ord", "p.*")
    parts = found.withColumns({"of": F.col("doc_id"), "doc_id": F.concat_ws("#", F.col("doc_id").cast("string"), F.col("block_ord").cast("string"))})
    each = staged(match.by_name(parts), "answers")  # read three times; the texts once
    out = match.reconciled(each, refs).select("doc_id", "status", "mr8_id", match.search_key(F.col("record"), F.col("status"), kind).alias("search_key"), "explanation")
    return each.select("doc_id", F.col("of"), "block_ord", "name_ord").join(out, "doc_id").drop("doc_id").withColumnRenamed("of", "doc_id")


def exactness(results: DataFrame) -> DataFrame:
    """results of reconciled() with name_exact and address_exact: whether the document's own name and full address are the record's."""
    full = lambda c: T.trim_all(T.expand_abbreviations(T.full_address(c["address1"], c["address2"], c["city"], c["state"], c["postal_code"])))
    doc, rec = F.col("doc"), F.col("record")
    same = lambda c: F.coalesce(rec.isNotNull() & c, F.lit(False))
    return results.withColumns({"name_exact": same(T.is_name_exact(doc["name"], rec["name"])), "address_exact": same((full(doc) != "") & (full(doc) == full(rec)))})


def chat_line(name: Column, found: Column, key: Column) -> Column:
    """One answer in words."""
    return F.concat_ws(" — ", name, F.when(found, F.concat_ws(" — ", F.lit("FOUND"), key)).otherwise("RESEARCH REQUIRED"))
