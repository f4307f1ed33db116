"""Format detection by content; a file's name only breaks ties."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Formats as extension: (MIME type, family, label); leading bytes; names of files and types in ZIP containers.
FORMATS = {
    "pdf": ("application/pdf", "pdf", "PDF"),
    "png": ("image/png", "image", "PNG image"),
    "jpg": ("image/jpeg", "image", "JPEG image"),
    "gif": ("image/gif", "image", "GIF image"),
    "tiff": ("image/tiff", "image", "TIFF image"),
    "bmp": ("image/bmp", "image", "BMP image"),
    "webp": ("image/webp", "image", "WebP image"),
    "rtf": ("application/rtf", "office", "Rich Text"),
    "doc": ("application/msword", "office", "Word 97-2003"),
    "xls": ("application/vnd.ms-excel", "office", "Excel 97-2003"),
    "ppt": ("application/vnd.ms-powerpoint", "office", "PowerPoint 97-2003"),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "office", "Word document"),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "office", "Excel workbook"),
    "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "office", "PowerPoint deck"),
    "odt": ("application/vnd.oasis.opendocument.text", "office", "OpenDocument Text"),
    "ods": ("application/vnd.oasis.opendocument.spreadsheet", "office", "OpenDocument Sheet"),
    "odp": ("application/vnd.oasis.opendocument.presentation", "office", "OpenDocument Slides"),
    "html": ("text/html", "web", "HTML page"),
    "md": ("text/markdown", "flow", "Markdown"),
    "txt": ("text/plain", "flow", "Plain text"),
    "csv": ("text/csv", "flow", "CSV"),
    "tsv": ("text/tab-separated-values", "flow", "TSV"),
    "json": ("application/json", "flow", "JSON"),
    "xml": ("application/xml", "flow", "XML"),
}
SAME_AS = {"jpeg": "jpg", "tif": "tiff", "htm": "html", "markdown": "md", "text": "txt", "log": "txt"}
LEADING = [("25504446 2D", "pdf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpg"), ("474946383761", "gif"), ("474946383961", "gif"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("424D", "bmp"), ("7B5C727466", "rtf")]
OLE2, ZIP = "D0CF11E0A1B11AE1", "504B0304"
ZIP_FOLDERS = [("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")]
NOT_BY_NAME = ("gif", "odt", "ods", "odp")  # found by content alone
HTML_STARTS = ["<!doctype html", "<html", "<?xml-stylesheet", "<head"]
HTML_PROBE, TEXT_PROBE, CONTROL_SHARE = 1024, 8192, 0.02


def _starts(content: Column, hexed: str) -> Column:
    raw = bytes.fromhex(hexed.replace(" ", ""))
    return F.substring(content, 1, len(raw)) == F.lit(bytearray(raw))


def extension(filename: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"(?s)\.([^.]*)$", 1))


def looks_like_html(content: Column) -> Column:
    head = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, HTML_PROBE), "ISO-8859-1"), r"^[ \t\n\r\x0b\f]+", ""))
    found = F.lit(False)
    for start in HTML_STARTS:
        found = found | head.startswith(start)
    return found


def looks_like_text(content: Column) -> Column:
    """UTF-8 without NUL and with few control characters; a character that the probe cuts off does no harm."""
    probe = F.substring(content, 1, TEXT_PROBE)
    whole = F.lit(False)
    for cut in range(4):  # a cut character has at most three bytes here
        part = F.substring(probe, F.lit(1), F.length(probe) - cut)
        whole = whole | (F.is_valid_utf8(part.cast("string")) & ((F.length(content) > TEXT_PROBE) | F.lit(cut == 0)))
    text = F.make_valid_utf8(probe.cast("string"))
    control = F.regexp_count(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    return ~text.contains("\0") & whole & (control / F.greatest(F.length(text), F.lit(1)) < CONTROL_SHARE)


@pandas_udf(T.StringType())
def zip_kind(content: pd.Series, ext: pd.Series) -> pd.Series:
    """The extension that a ZIP container's members show; else a known one of its name; else null."""
    declared = {FORMATS[e][0]: e for e in ("odt", "ods", "odp")}

    def kind(raw: bytes, ext: str) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                names = z.namelist()
                mime = z.read("mimetype").decode("ascii", "ignore").strip() if "mimetype" in names else ""
        except (zipfile.BadZipFile, KeyError, OSError):
            return None
        if mime in declared:
            return declared[mime]
        for folder, found in ZIP_FOLDERS:
            if any(n.startswith(folder) for n in names):
                return found
        ext = SAME_AS.get(ext, ext)
        return ext if ext in FORMATS and ext not in NOT_BY_NAME else None

    return pd.Series([kind(c, e) for c, e in zip(content, ext, strict=True)], dtype=object)


def detect(files: DataFrame, content: str = "content", filename: str = "filename", containers: bool = True) -> DataFrame:
    """files with mime, family, extension, label and error (null if a format was found).

    containers: look into ZIP containers, for which the rows go through Python; without, they have an error.
    """
    c, ext = F.col(content), extension(F.col(filename))
    same = F.create_map(*[F.lit(x) for pair in SAME_AS.items() for x in pair])
    ext = F.coalesce(same[ext], ext)
    flow = [e for e, (_, family, _) in FORMATS.items() if family == "flow"]
    found = F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(None))
    for hexed, e in LEADING:
        found = found.when(_starts(c, hexed), F.lit(e))
    found = found.when(_starts(c, "52494646") & (F.substring(c, 9, 4) == F.lit(bytearray(b"WEBP"))), F.lit("webp"))
    found = found.when(_starts(c, ZIP), F.col("_zip"))
    found = found.when(_starts(c, OLE2), F.when(ext.isin("doc", "xls", "ppt"), ext))
    found = found.when(looks_like_html(c), F.lit("html"))
    found = found.when(looks_like_text(c), F.when(ext.isin(flow), ext).otherwise(F.lit("txt")))
    names = ["mime", "family", "extension", "label", "error"]
    files = files.drop(*names, "_zip", "_ext")
    zipped = zip_kind(F.when(_starts(c, ZIP), c).otherwise(F.lit(bytearray(b""))), ext) if containers else F.lit(None).cast("string")
    out = files.withColumn("_zip", zipped).withColumn("_ext", found)
    info = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(*[F.lit(v).alias(n) for v, n in zip(x, ("mime", "family", "label"), strict=True)]) for pair in FORMATS.items() for x in pair])
    e = F.col("_ext")
    error = F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "empty file").when(e.isNotNull(), F.lit(None)).when(_starts(c, ZIP), "unknown ZIP container").when(_starts(c, OLE2), "OLE2 container without a known extension").otherwise("unknown content")
    out = out.withColumn("_info", info[e])
    return out.select(*files.columns, F.col("_info.mime").alias("mime"), F.col("_info.family").alias("family"), e.alias("extension"), F.col("_info.label").alias("label"), error.alias("error"))


def provenance_mode(family: Column) -> Column:
    """flow documents are located by characters, all others by page and box."""
    return F.when(family == "flow", "flow").when(family.isNotNull(), "paged")


def needs_conversion(family: Column) -> Column:
    return family.isin("office", "web")


def always_ocr(family: Column) -> Column:
    return family == "image"
