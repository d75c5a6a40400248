"""Visual assets: what an image's first bytes tell, and the bytes of assets, opened by their place in a file or archive.

Pixels are neither decoded nor resized, and there is no text recognition: these need libraries that are not installed.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats and their types.
MIME = {"PNG": "image/png", "JPEG": "image/jpeg", "GIF": "image/gif", "BMP": "image/bmp", "WEBP": "image/webp", "TIFF": "image/tiff"}
RESOLVED = "kind string, relative_path string, page int, media string, format string, mime string, width int, height int, size long, sha256 string, content binary, error string"


def _gif_frames(content: bytes) -> int:
    at = 13 + (3 << (content[10] & 7) + 1 if content[10] & 0x80 else 0)
    frames = 0
    while at < len(content) and content[at] in (0x21, 0x2C):
        if content[at] == 0x2C:
            frames += 1
            at += 10 + (3 << (content[at + 9] & 7) + 1 if content[at + 9] & 0x80 else 0) + 1
        else:
            at += 2
        while at < len(content) and content[at]:  # blocks of a length each, to an empty one
            at += content[at] + 1
        at += 1
    return max(1, frames)


def _jpeg_size(content: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 <= len(content):
        if content[at] != 0xFF:
            raise ValueError("broken JPEG")
        kind = content[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:  # fill and markers without a length
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header
            height, width = struct.unpack(">HH", content[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    raise ValueError("broken JPEG")


def _tiff_size(content: bytes) -> tuple[int, int, int]:
    order = "<" if content[:2] == b"II" else ">"
    (at,), sizes, pages = struct.unpack(order + "I", content[4:8]), {}, 0
    seen: set[int] = set()
    while at and at not in seen and at + 2 <= len(content):
        seen.add(at)
        (n,) = struct.unpack(order + "H", content[at : at + 2])
        for k in range(n if not pages else 0):
            tag, kind, _, value = struct.unpack(order + "HHI4s", content[at + 2 + 12 * k : at + 14 + 12 * k])
            if tag in (256, 257):
                sizes[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
        pages += 1
        (at,) = struct.unpack(order + "I", content[at + 2 + 12 * n : at + 6 + 12 * n])
    return sizes[256], sizes[257], pages


def image_header(content: bytes) -> tuple[str, int, int, int]:
    """Format, width, height and number of frames of an image, from its headers; ValueError where it is none of the known formats or broken."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n" and content[12:16] == b"IHDR":
            return "PNG", *struct.unpack(">II", content[16:24]), 1
        if content[:2] == b"\xff\xd8":
            return "JPEG", *_jpeg_size(content), 1
        if content[:6] in (b"GIF87a", b"GIF89a"):
            return "GIF", *struct.unpack("<HH", content[6:10]), _gif_frames(content)
        if content[:2] == b"BM" and len(content) >= 26:
            width, height = struct.unpack("<ii", content[18:26])
            return "BMP", width, abs(height), 1
        if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            if content[12:16] == b"VP8X":
                return "WEBP", 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little"), max(1, content.count(b"ANMF"))
            if content[12:16] == b"VP8L":
                bits = int.from_bytes(content[21:25], "little")
                return "WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), 1
            width, height = struct.unpack("<HH", content[26:30])
            return "WEBP", width & 0x3FFF, height & 0x3FFF, 1
        if content[:4] in (b"II*\0", b"MM\0*"):
            return "TIFF", *_tiff_size(content)
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError("The image is broken") from e
    raise ValueError("Not an image of a known format")


def image_document(name: str, content: bytes) -> tuple[str, list[dict]]:
    """An image as a document: what its headers say, and itself as its asset."""
    kind, width, height, frames = image_header(content)
    head = f"# Visual asset: {name}"
    lines = [head, f"Format: {kind}", f"Size: {width}x{height}", *([f"Frames: {frames}"] if frames > 1 else []), "", "No OCR text detected."]
    return "\n".join(lines), [{"kind": "image-file", "page": None, "label": name, "media": None, "anchor": head}]


def resolve(spark: SparkSession, root: str, assets: DataFrame, most: int | None = None) -> DataFrame:
    """The bytes of ``assets`` (kind, relative_path, page, media, in the order of ``nth`` if there is such a column) below ``root``: one row for
    each distinct asset with its format, size and hash, the first ``most`` of them.

    Equal contents have equal hashes. What cannot be opened has a reason in ``error`` and no content: files outside of the root,
    members that are no media of their archive, broken images, and assets of pages, which need a library that is not installed.
    """
    key = ["kind", "relative_path", "page", "media"]
    order = ["nth"] if "nth" in assets.columns else key
    distinct = assets.groupBy(*key).agg(F.min("nth").alias("nth")) if "nth" in assets.columns else assets.select(*key).distinct()
    wanted = distinct.orderBy(*order).limit(most) if most is not None else distinct
    base, columns = root.rstrip("/"), T._parse_datatype_string(RESOLVED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyspark.sql.pandas.types import to_arrow_schema

        from .files import content_of
        from .workbook import contained

        schema = to_arrow_schema(columns)
        for batch in batches:
            for kind, path, page, media in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict.fromkeys(schema.names) | {"kind": kind, "relative_path": path, "page": page, "media": media}
                try:
                    if ".." in (path or "").replace("\\", "/").split("/"):
                        raise ValueError(f"{path} is not inside the folder")
                    local = not re.match(r"[a-z0-9]+:", base)
                    content = content_of(contained(base, path) if local else f"{base}/{path}")
                    if kind == "docx-image":
                        if not (media or "").startswith("word/media/"):
                            raise ValueError(f"{media} is no image of the document")
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            content = z.read(media)
                    elif kind != "image-file":
                        raise ValueError(f"Assets of kind {kind} need a library that is not installed")
                    name, width, height, _ = image_header(content)
                    row |= {"format": name, "mime": MIME[name], "width": width, "height": height, "size": len(content), "sha256": hashlib.sha256(content).hexdigest(), "content": content}
                except Exception as e:  # an asset that cannot be opened is a row with its reason
                    row["error"] = str(e)[:300] or type(e).__name__
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return wanted.select(*key).repartition(n, *key).mapInArrow(run, RESOLVED)
