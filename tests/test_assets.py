"""Visual assets: image headers, images as documents, and assets opened by their place."""

import hashlib
import struct
import zipfile
import zlib

import pytest

from leafmill.plans.index import Index
from leafmill.sources import assets


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1) * height)) + chunk(b"IEND", b"")


JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xfe\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 30, 40) + b"\x01\x01\x11\0\xff\xd9"
GIF = b"GIF89a" + struct.pack("<HH", 7, 5) + b"\x80\0\0" + b"\0" * 6 + (b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHH", 0, 0, 7, 5) + b"\0" + b"\x02\x02\x44\x01\0") * 3 + b"\x3b"
BMP = b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 9, -8) + b"\0" * 8
WEBP = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
TIFF = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 12, 0) + struct.pack("<HHII", 257, 4, 1, 11) + struct.pack("<I", 0)


def test_headers():
    got = [assets.image_header(x) for x in (png(3, 4), JPEG, GIF, BMP, WEBP, TIFF)]
    assert got == [("PNG", 3, 4, 1), ("JPEG", 40, 30, 1), ("GIF", 7, 5, 3), ("BMP", 9, 8, 1), ("WEBP", 100, 50, 1), ("TIFF", 12, 11, 1)]
    for broken in (b"", b"text", JPEG[:20], b"\xff\xd8\0\0\0\0\0\0\0\0\0\0", b"II*\0" + struct.pack("<I", 8), GIF[:8]):
        with pytest.raises(ValueError):
            assets.image_header(broken)


def docx(path, image):
    w, r = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = f'<w:p><w:r><w:t>The picture below shows growth</w:t></w:r></w:p><w:p><w:r><x r:embed="rId1"/></w:r></w:p><w:p><w:r><x r:embed="rId1"/></w:r></w:p>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:r="{r}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="media/image1.png"/></Relationships>')
        z.writestr("word/media/image1.png", image)


def test_assets_of_an_index(spark, tmp_path):
    root, image = tmp_path / "root", png(20, 10)
    root.mkdir()
    docx(root / "report.docx", image)
    (root / "same.png").write_bytes(image)
    (root / "photo.jpg").write_bytes(JPEG)
    (root / "broken.gif").write_bytes(b"GIF")
    index = Index(spark, str(root), str(tmp_path / "index"))
    stats = index.build()
    assert (stats["added"], stats["failed"]) == (4, 1)
    assert index.search("visual asset", 10).where("relative_path = 'photo.jpg'").first().text == "# Visual asset: photo.jpg\nFormat: JPEG\nSize: 40x30\n\nNo OCR text detected."
    got = {r.relative_path: r for r in index.visual_assets().collect()}
    assert set(got) == {"report.docx", "same.png", "photo.jpg"} and all(r.error is None for r in got.values())
    r = got["report.docx"]
    assert (r.media, r.mime, r.width, r.height, r.size, bytes(r.content), r.sha256) == ("word/media/image1.png", "image/png", 20, 10, len(image), image, hashlib.sha256(image).hexdigest())
    assert got["same.png"].sha256 == r.sha256 != got["photo.jpg"].sha256
    assert index.visual_assets(["photo.jpg"]).count() == 1 and index.visual_assets(most=2).count() == 2


def test_assets_that_cannot_be_opened(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (tmp_path / "secret.png").write_bytes(png(1, 1))
    docx(root / "d.docx", b"no image")
    rows = [("image-file", "../secret.png", None, None), ("docx-image", "d.docx", None, "word/document.xml"), ("docx-image", "d.docx", None, "word/media/image1.png"), ("pdf-page", "d.docx", 1, None), ("image-file", "none.png", None, None)]
    df = spark.createDataFrame(rows, "kind string, relative_path string, page int, media string")
    got = assets.resolve(spark, str(root), df.union(df)).collect()
    assert len(got) == 5 and all(r.error and r.content is None and r.sha256 is None for r in got)
    assert "not inside" in {r.relative_path: r.error for r in got}["../secret.png"]
