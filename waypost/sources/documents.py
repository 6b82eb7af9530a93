"""Documents from files: plain text, e-mail, and what a PDF reader gives if one is installed."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("pdf", "eml", "msg", "txt")
EMAIL = (
    "message_id string, sender string, recipients array<string>, cc array<string>, subject string, sent_at timestamp, in_reply_to string, refs array<string>, text string, html string, "
    "extracted_text string, attachments array<struct<filename:string,content_type:string,content:binary,content_id:string,size:bigint>>"
)


def parse_email(raw: bytes | None) -> dict | None:
    """The parts of one message; null for null and for bytes that can't be read."""
    if raw is None:
        return None
    try:
        m = email.message_from_bytes(bytes(raw), policy=email.policy.default)
        text = html = None
        attached = []
        for p in m.walk():
            if p.is_multipart():
                continue
            kind, name = p.get_content_type(), p.get_filename()
            if name or p.get_content_disposition() == "attachment" or not kind.startswith("text/"):
                body = p.get_payload(decode=True) or b""
                attached.append((name, kind, body, p.get("Content-ID"), len(body)))
            elif kind == "text/html" and html is None:
                html = str(p.get_content())
            elif kind == "text/plain" and text is None:
                text = str(p.get_content())
        several = lambda h: [str(a) for a in m[h].addresses] if m[h] else []
        try:
            sent = parsedate_to_datetime(str(m["Date"])).replace(tzinfo=None) if m["Date"] else None
        except (TypeError, ValueError):
            sent = None
        subject = str(m["Subject"]) if m["Subject"] else None
        return {
            "message_id": m["Message-ID"] and str(m["Message-ID"]), "sender": m["From"] and str(m["From"]), "recipients": several("To"), "cc": several("Cc"), "subject": subject,
            "sent_at": sent, "in_reply_to": m["In-Reply-To"] and str(m["In-Reply-To"]), "refs": str(m["References"]).split() if m["References"] else [], "text": text, "html": html,
            "extracted_text": "\n".join(x for x in (subject, text, html) if x), "attachments": attached,
        }
    except Exception:  # a damaged message gives nothing, as a reader must go on
        return None


def read_pdf(raw: bytes | None) -> str:
    """The text of a PDF through pypdf; '' where that isn't installed or fails."""
    try:
        import io

        from pypdf import PdfReader

        return "\n\f".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(bytes(raw))).pages)
    except Exception:
        return ""


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, extension, content) of the readable files in a folder, without its subfolders, or of one file."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return df.select(F.col("path").alias("file"), ext.alias("extension"), "content").filter(ext.isin(*EXTENSIONS))


def parsed_emails(files: DataFrame) -> DataFrame:
    """file and the EMAIL columns of each .eml file."""
    names = [c.split()[0] for c in EMAIL.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, m) for f, raw in zip(b["file"], b["content"]) if (m := parse_email(raw))]
            yield pd.DataFrame([(f, *[m[n] for n in names]) for f, m in rows], columns=["file", *names])

    return files.filter("extension = 'eml'").select("file", "content").mapInPandas(run, f"file string, {EMAIL}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of each readable file: text as UTF-8, mails as subject, text and html, PDFs if a reader is there, .msg as ''."""
    files = list_files(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, ext, raw in zip(b["file"], b["extension"], b["content"]):
                if ext == "eml":
                    out.append((f, (parse_email(raw) or {}).get("extracted_text", "")))
                elif ext == "pdf":
                    out.append((f, read_pdf(raw)))
                else:
                    out.append((f, "" if ext == "msg" else bytes(raw).decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["file", "text"])

    return files.mapInPandas(run, "file string, text string")


def from_text(spark: SparkSession, text: str, name: str = "<stdin>") -> DataFrame:
    return spark.createDataFrame([(name, text)], "file string, text string")


def lookup_request(df: DataFrame, body: str = "body") -> DataFrame:
    """The fields of JSON lookup bodies: text, or name, address1, address2, city, state, postal_code (or postal), department."""
    s = F.from_json(F.col(body), "text string, name string, address1 string, address2 string, city string, state string, postal_code string, postal string, department string")
    r = df.withColumn("_r", s)
    keep = ("text", "name", "address1", "address2", "city", "department")
    return r.select(*df.columns, *[F.col(f"_r.{c}").alias(c) for c in keep], F.upper("_r.state").alias("state"), F.substring(F.coalesce("_r.postal_code", "_r.postal"), 1, 5).alias("postal_code"))
