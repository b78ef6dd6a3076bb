"""Exports of notes and of records."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.notes import as_csv_row, as_text, paragraphs

#: Options under which Spark's CSV is the same bytes as pandas writes.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
STYLES = ("Normal", "Title", "Heading1", "ListBullet")


def write_text(notes: DataFrame, path: str, one_each: bool = False) -> None:
    """Each transcript's notes as one text: rows of transcript_id, name and content, as many files as there are tasks.

    one_each writes a folder for each transcript instead, for few of them.
    """
    text = as_text(F.col("summary"), F.col("action_items"), F.col("text"))
    if one_each:
        notes.select("transcript_id", text.alias("value")).write.partitionBy("transcript_id").option("lineSep", "\n").text(path)
    else:
        name = F.concat(F.col("transcript_id").cast("string"), F.lit(".txt"))
        notes.select("transcript_id", name.alias("name"), text.alias("content")).write.parquet(path)


def write_csv(notes: DataFrame, path: str) -> None:
    as_csv_row(notes).drop("transcript_id").write.options(**CSV_OPTIONS).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", False).json(path)


def append_turns(turns: DataFrame, path: str) -> None:
    """Chat turns after those that are stored."""
    turns.select("transcript_id", "seq", "role", "content").write.mode("append").parquet(path)


def reset(rows: DataFrame, path: str) -> None:
    """Stored records replaced by these; an empty frame clears them and keeps the schema."""
    rows.write.mode("overwrite").parquet(path)


def docx(lines: list[dict]) -> bytes:
    """A word-processor file of (style, text) paragraphs, the same bytes for the same lines."""
    body = "".join(
        f'<w:p><w:pPr><w:pStyle w:val="{x["style"]}"/></w:pPr><w:r>'
        + "<w:br/>".join(f'<w:t xml:space="preserve">{escape("".join(c for c in t if c >= " " or c == chr(9)))}</w:t>' for t in (x["text"] or "").split("\n"))
        + "</w:r></w:p>"
        for x in lines
    )
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{s}"><w:name w:val="{s}"/></w:style>' for s in STYLES)
    parts = {
        "[Content_Types].xml": f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>',
        "_rels/.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>',
        "word/styles.xml": f'{HEAD}<w:styles xmlns:w="{WORD}">{styles}</w:styles>',
        "word/document.xml": f'{HEAD}<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def as_docx(notes: DataFrame) -> DataFrame:
    """transcript_id and content, the bytes of the notes as a word-processor file."""
    lines = paragraphs(F.col("summary"), F.col("action_items"), F.col("text")).alias("lines")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [docx(x) for x in batch.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("transcript_id"), pa.array(files, pa.binary())], ["transcript_id", "content"])

    kind = notes.schema["transcript_id"].dataType.simpleString()
    return notes.select("transcript_id", lines).mapInArrow(build, f"transcript_id {kind}, content binary")
