"""Text files to located blocks: lines, paragraphs, Markdown, CSV.

A block has kind, text, char_start, char_end (code points, half open) and section_path, and
its text is what the file holds there (a CSV block's text also begins with the header line).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import BLANK, is_blank, strip

CSV_ROWS = 40
LINE_END = r"(?<=[\n\x0b\x0c\x1c-\x1e\x85  ])|(?<=\r)(?!\n)"
BLOCKS = "array<struct<kind:string,text:string,char_start:int,char_end:int,section_path:array<string>>>"
# How Markdown's line starts look, by the format. Within a line, W is white space.
ENDS = "\n\r\x0b\x0c\x1c-\x1e\x85  "
W = rf"[^\S{ENDS}]"
REST, END = rf"[^{ENDS}]*", rf"(?:\r\n|[{ENDS}]|\Z)"
LINE = rf"(?:[^{ENDS}]+{END}|\r\n|[{ENDS}])"
FENCE, HEADING, EMPTY, ROW, ITEM = rf"{W}*(?:```|~~~)", rf"#{{1,6}}{W}", rf"{W}*(?:[{ENDS}]|(?<=\s)\Z)", rf"{W}*\|", rf"{W}*(?:[-*+]|\d+[.)]){W}"
#: A Markdown text is a row of these, each of whole lines: what a block is, is said by its first line, and by how far it goes.
GRAMMAR = re.compile(
    rf"(?P<code>{W}*(```|~~~){REST}{END}(?:(?!{W}*\2){LINE})*(?:{W}*\2{REST}{END})?)"
    rf"|(?P<heading>{HEADING}{REST}{END})"
    rf"|(?P<blank>(?:{W}*(?:\r\n|[{ENDS}])|{W}+\Z))"
    rf"|(?P<table>(?:(?={ROW}){LINE})+)"
    rf"|(?P<list>(?:(?={ITEM}){LINE})+)"
    rf"|(?P<paragraph>(?:(?!{FENCE}|{HEADING}|{EMPTY}|{ROW}|{ITEM}|{W}+\Z){LINE})+)"
)
TITLE = re.compile(rf"(#+){W}*(.*?){W}*#*{W}*", re.DOTALL)


def line_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df without text, with line_no, line (terminator included), char_start and char_end; df's other columns name a text."""
    parts = F.filter(F.split(F.col(text), LINE_END), lambda s: s != "")
    keys = [c for c in df.columns if c != text]
    rows = df.select(*keys, F.posexplode(parts).alias("line_no", "line"))
    end = F.sum(F.length("line")).over(Window.partitionBy(*keys).orderBy("line_no"))
    return rows.select(*keys, "line_no", "line", (end - F.length("line")).cast("int").alias("char_start"), end.cast("int").alias("char_end"))


def _trimmed(text: Column, start: Column) -> Column:
    """struct(text, char_start, char_end) of a piece that is trimmed at both ends."""
    left = F.length(text) - F.length(F.regexp_replace(text, rf"(?U)^{BLANK}+", ""))
    inside = strip(text)
    return F.struct(inside.alias("text"), (start + left).cast("int").alias("char_start"), (start + left + F.length(inside)).cast("int").alias("char_end"))


def plain_blocks(text: Column) -> Column:
    """Paragraphs between blank lines, as an array of blocks; JVM only."""
    # the separator stays with the piece before it, so that lengths give the offsets
    pieces = F.regexp_extract_all(text, F.lit(r"(?s).+?(?:\n(?:[ \t\r\x0b\x0c]*\n)+|\z)"), F.lit(0))
    placed = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,char_start:int,char_end:int>>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], F.array(_trimmed(p, acc["at"]))).alias("out")),
    )["out"]
    return F.transform(
        F.filter(placed, lambda b: b["text"] != ""),
        lambda b: F.struct(F.lit("paragraph").alias("kind"), b["text"].alias("text"), b["char_start"].alias("char_start"), b["char_end"].alias("char_end"), F.array().cast("array<string>").alias("section_path")),
    )


def _lines(text: str) -> list[tuple[int, str]]:
    at, out = 0, []
    for line in text.splitlines(keepends=True):
        out.append((at, line))
        at += len(line)
    return out


def markdown(text: str) -> list[dict]:
    """Blocks of a Markdown text: headings, fenced code, lists, tables, paragraphs, with the headings above them."""
    out, above = [], [None] * 6  # the last heading of each level that is still open
    for m in GRAMMAR.finditer(text):
        kind, inside = m.lastgroup, m[0].strip()
        if kind == "heading":
            marks, title = TITLE.fullmatch(inside).groups()
            above[len(marks) - 1 :] = [title.strip(), *[None] * (6 - len(marks))]
        if inside:
            start = m.start() + m[0].index(inside)
            out.append({"kind": "paragraph" if kind == "code" else kind, "text": inside, "char_start": start, "char_end": start + len(inside), "section_path": [t for t in above if t is not None]})
    return out


def delimited(text: str, rows: int = CSV_ROWS) -> list[dict]:
    """Groups of a CSV's or TSV's lines, each with the header line before it."""
    lines = [(at, line) for at, line in _lines(text)]
    if not lines:
        return []
    header, out = lines[0][1].strip(), []
    body = [(at, line) for at, line in lines[1:] if line.strip()]
    for k in range(0, len(body), rows):
        group = body[k : k + rows]
        start, end = group[0][0], group[-1][0] + len(group[-1][1])
        inside = text[start:end].rstrip()
        out.append({"kind": "table", "text": f"{header}\n{''.join(line for _, line in group).rstrip()}", "char_start": start, "char_end": start + len(inside), "section_path": []})
    return out


def split_flow(df: DataFrame, text: str = "text", ext: str = "extension", rows: int = CSV_ROWS) -> DataFrame:
    """df without text, with reading_order and a block's columns: a row for each block of each file.

    Markdown and delimited files are read line by line in Python, a file at a time; all
    others are split in the JVM. Blank files have no block.
    """
    keys = [c for c in df.columns if c != text]
    structured = F.lower(F.col(ext)).isin("md", "markdown", "csv", "tsv")
    at, kind_at = df.columns.index(text), df.columns.index(ext)
    some = df.where(structured & ~is_blank(F.col(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("section_path", pa.list_(pa.string()))]))
        for b in batches:
            found = [markdown(t) if e.lower() in ("md", "markdown") else delimited(t, rows) for t, e in zip(b.column(at).to_pylist(), b.column(kind_at).to_pylist(), strict=True)]
            yield pa.record_batch([*(c for i, c in enumerate(b.columns) if i != at), pa.array(found, shape)], names=[*(n for n in b.schema.names if n != text), "blocks"])

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != text)
    left = some.mapInArrow(run, f"{fields}, blocks {BLOCKS}")
    right = df.where(~F.coalesce(structured, F.lit(False)) & ~is_blank(F.col(text))).select(*keys, plain_blocks(F.col(text)).cast(BLOCKS).alias("blocks"))
    both = left.unionByName(right)
    return both.select(*keys, F.posexplode("blocks").alias("reading_order", "b")).select(*keys, "reading_order", "b.*")
