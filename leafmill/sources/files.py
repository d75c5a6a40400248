"""Files as rows: discovery without reading content, and text extraction by format in parallel.

A file that cannot be extracted becomes a row with status ``failed`` and a reason; it never fails the job.
PDF, XLS, images and OCR need libraries that are not part of this project and are reported as such.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .filters import Rules, ignored, size_reason, skip_reason

TEXT_SUFFIXES = frozenset("txt md markdown rst log csv tsv json jsonl xml html htm yaml yml toml ini cfg conf py js ts tsx jsx java c h cpp hpp cs go rs rb php sh sql css scala kt r".split())
UNSUPPORTED = {"pdf": "PDF needs a library that is not installed", "xls": "XLS needs a library that is not installed"}
#: Images whose headers are read; drawings (svg) are text.
IMAGES = tuple(x for x in tx.VISUAL_SUFFIXES if x != "svg")


#: Folders from which on the tasks list what is below them; fewer are opened on the driver, for their folders alone.
FOLDERS = 64


def _hidden(name: str) -> bool:
    """Names that Spark's own listing leaves out."""
    return not name.startswith(("_metadata", "_common_metadata")) and (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name))


def _entries(folder: str) -> tuple[list[str], list[os.DirEntry]]:
    """Folders and files in a local folder."""
    folders, files = [], []
    with os.scandir(folder or "/") as found:
        for e in found:
            if not _hidden(e.name):
                if e.is_dir():
                    folders.append(f"{folder}/{e.name}")
                else:
                    files.append(e)
    return folders, files


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """``relative_path, path, size, mtime`` of the files below a local or mounted folder, listed by tasks; the driver holds names of folders alone."""
    folders, todo = [root], []
    while folders and len(folders) + len(todo) < FOLDERS:
        below = []
        for folder in folders:
            inner, files = _entries(folder)
            below += inner
            todo += [(folder, False)] if files else []
        folders = below
    todo += [(folder, True) for folder in folders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stack = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            while stack:
                folder, deep = stack.pop()
                inner, files = _entries(folder)
                stack += [(x, True) for x in inner] if deep else []
                rows = []
                for e in files:
                    try:
                        at = e.stat()
                    except FileNotFoundError:  # gone meanwhile, or a link to nothing
                        continue
                    path = f"{folder}/{e.name}".encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                    rows.append((path[len(root) + 1 :], path, at.st_size, at.st_mtime_ns // 1_000_000 / 1000))
                for k in range(0, len(rows), 10_000):
                    columns = zip(*rows[k : k + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.float64()))], names=["relative_path", "path", "size", "mtime"])

    return spark.createDataFrame(todo, "folder string, deep boolean").mapInArrow(run, "relative_path string, path string, size bigint, mtime double")


def discover(spark: SparkSession, root: str, rules: Rules = Rules(), max_mb: float = 50.0) -> DataFrame:
    """``relative_path, path, size, mtime, reason`` of the files below ``root``; no content is read.

    A local or mounted folder is listed by tasks, any other by Spark on the driver.
    """
    base = root.rstrip("/") + "/"
    plain = re.sub(r"^[a-z]+:/*", "/", base) if ":" in base else base
    if base.startswith("file:") or not re.match(r"[a-z0-9]+:", base):
        found = _listed(spark, os.path.abspath(plain).rstrip("/"))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "length", "modificationTime")
        rel = F.element_at(F.split(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), re.escape(plain), 2), 2)
        found = files.select(rel.alias("relative_path"), "path", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))
    path = F.col("relative_path")
    return found.where(~ignored(path)).withColumn("reason", F.coalesce(skip_reason(path, rules), size_reason(F.col("size"), max_mb)))


# Small extraction helpers, one file at a time --------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def normalize(text: str) -> str:
    """No NUL characters, trimmed; a JSON object or array is printed with an indent of two."""
    text = text.replace("\0", "").strip()
    if text[:1] in "{[" and text[-1:] in "}]":
        try:
            return json.dumps(json.loads(text), indent=2)
        except ValueError:
            pass
    return text


def decode(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


_EMBED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"
#: Images of a document at most (a fixed value).
DOCX_IMAGES = 12


def docx_document(content: bytes) -> tuple[str, list[dict]]:
    """Paragraphs in order, table rows as ``a | b``, and the images: each with its file and the text that it stands at."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = set(z.namelist())
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))} if "word/_rels/document.xml.rels" in names else {}
    inner = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out, assets = [], []
    for e in body if body is not None else ():
        if e.tag == f"{_W}tbl":
            out += [" | ".join(c for c in map(inner, row.iter(f"{_W}tc")) if c) for row in e.iter(f"{_W}tr")]
        elif e.tag == f"{_W}p":
            out.append(inner(e))
        for image in (links.get(x.get(_EMBED)) for x in e.iter() if x.get(_EMBED)):
            if image and "media/" in image and len(assets) < DOCX_IMAGES:
                anchor = next((x for x in reversed(out) if x), "")
                assets.append({"kind": "docx-image", "page": None, "label": anchor[:80] or image.rpartition("/")[2], "media": f"word/{image.lstrip('/').removeprefix('word/')}", "anchor": anchor})
    return "\n".join(x for x in out if x), assets


def docx_text(content: bytes) -> str:
    return docx_document(content)[0]


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)")
_RTF_SKIP = frozenset("fonttbl colortbl stylesheet info pict object header footer themedata datastore".split())


def rtf_text(content: bytes) -> str:
    """Text of an RTF file: control words drop out, skipped groups with them, ``\\par`` is a line."""
    out, skip, stack = [], False, []
    for hexa, uni, word, _, sign, brace, plain in _RTF.findall(content.decode("latin-1")):
        if brace == "{":
            stack.append(skip)
        elif brace:
            skip = stack.pop() if stack else False
        elif word in _RTF_SKIP or sign == "*":
            skip = True
        elif not skip:
            out.append(bytes.fromhex(hexa).decode("cp1252", "replace") if hexa else chr(int(uni) % 65536) if uni else "\n" if word in ("par", "line") else "\t" if word == "tab" else plain or (sign if sign in "\\{}" else ""))
    return "".join(out).strip()


def printable_runs(content: bytes, most: int = 500) -> str:
    """Readable runs of an unknown binary format, distinct, in order."""
    run = r"[\w][\w\s,.\-:/\\]{6,}"
    found = re.findall(run, content.decode("utf-16-le", "ignore")) + re.findall(run, content.decode("latin-1"))
    return "\n".join(list(dict.fromkeys(x.strip() for x in found))[:most])


def looks_like_text(content: bytes) -> bool:
    """No NUL byte and over 75 % printable in the first 4,096 bytes."""
    head = content[:4096]
    return bool(head) and 0 not in head and sum(b >= 32 or b in (9, 10, 13) for b in head) > 0.75 * len(head)


def csv_lines(content: bytes) -> str:
    import csv

    rows = csv.reader(io.StringIO(decode(content)))
    return "\n".join(line for r in rows if (line := " | ".join(c.strip() for c in r if c.strip())))


def extract(path: str, content: bytes) -> tuple[str, str]:
    """Text and parser of one file; raises ValueError with the reason if there is none."""
    suffix = path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    if suffix in UNSUPPORTED:
        raise ValueError(UNSUPPORTED[suffix])
    if suffix in ("docx", "docm") or (suffix == "doc" and content[:2] == b"PK"):
        return docx_text(content), "docx"
    if suffix == "rtf" or (suffix == "doc" and content[:5] == b"{\\rtf"):
        return rtf_text(content), "rtf"
    if suffix == "doc":
        return printable_runs(content), "doc"
    if suffix == "csv":
        return csv_lines(content), "csv"
    if suffix in ("xlsx", "xlsm"):
        from .workbook import workbook_text

        return workbook_text(content), "spreadsheet"
    if suffix in TEXT_SUFFIXES or looks_like_text(content):
        return normalize(decode(content)), "text"
    raise ValueError("Unknown binary format")


#: Rows of extraction: what a file's text is cut into by its format (else null), its tables and its visual assets.
CHUNKS = "array<struct<text:string,chunk_type:string,sheet_name:string,row_number:int>>"
STRUCTURE = "struct<sheet_count:int,row_count:int,sheet_names:array<string>,column_hints:array<string>,sheets:array<struct<name:string,row_count:int,column_count:int,header_hints:array<string>>>>"
ASSETS = "array<struct<kind:string,page:int,label:string,media:string,anchor:string>>"
EXTRACTED = f"relative_path string, status string, parser string, text string, content_hash string, error_reason string, chunks {CHUNKS}, structure {STRUCTURE}, assets {ASSETS}"


def content_of(path: str) -> bytes:
    """A file's bytes, by path or address."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path)) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)
    with system.open_input_stream(at) as f:
        return f.read()


def document(path: str, content: bytes) -> dict:
    """What ``extract`` gives, with chunks, structure and assets where the format has them."""
    suffix = path.rpartition(".")[2].lower()
    if suffix in ("xlsx", "xlsm"):
        from .workbook import workbook_document

        text, chunks, structure = workbook_document(content)
        return {"text": text, "parser": "spreadsheet", "chunks": chunks, "structure": structure}
    if suffix in ("docx", "docm") or (suffix == "doc" and content[:2] == b"PK"):
        text, assets = docx_document(content)
        return {"text": text, "parser": "docx", "assets": assets or None}
    if suffix in IMAGES:
        from .assets import image_document

        text, assets = image_document(path.replace("\\", "/").rpartition("/")[2], content)
        return {"text": text, "parser": "image", "assets": assets}
    text, parser = extract(path, content)
    return {"text": text, "parser": parser}


def extracted(spark: SparkSession, files: DataFrame) -> DataFrame:
    """EXTRACTED rows of discovered files that no rule skips.

    The list of files stays a table: its rows are dealt to tasks by estimated cost (``ingest.cost_batches``), and a task opens
    its files one after the other. No path passes through the driver.
    """
    from pyspark.sql import types as T

    from ..operators import ingest

    costed = files.where("reason IS NULL").select("relative_path", "path", "size", ingest.cost(tx.extension(F.col("relative_path")), F.col("size")).alias("cost"))
    # a number of its own, since adaptive execution would put all of these short rows into one task
    total = costed.agg(F.sum("cost")).first()[0] or 0.0
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(total / TASK_SECONDS))
    dealt = ingest.cost_batches(costed, max(0.05, min(TASK_SECONDS, total / tasks / 64))).repartition(tasks, "shard", "batch")
    schema = T._parse_datatype_string(EXTRACTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        rows, held = [], 0
        for batch in batches:
            for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = dict.fromkeys(arrow.names) | {"relative_path": name}
                try:
                    content = content_of(path)
                    row["content_hash"] = hashlib.sha256(content).hexdigest()
                    row |= document(path, content)
                    row |= {"status": "indexed"} if row["text"].strip() else {"status": "failed", "text": None, "error_reason": "No text found"}
                except Exception as e:  # any broken file is a failed row, with its reason
                    row |= {"status": "failed", "error_reason": str(e)[:300] or type(e).__name__}
                rows.append(row)
                held += len(row["text"] or "")
                if held >= BATCH or len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return dealt.select("relative_path", "path").mapInArrow(run, schema)


#: Characters of a batch of texts.
BATCH = 1 << 20
#: Estimated seconds of a task's files.
TASK_SECONDS = 10.0
