"""Table functions that SQL can call: ``SELECT * FROM split_flow(TABLE(files), 'text', 'extension')``.

They are polymorphic: the result has the columns of the table that is passed in, but for the
text, and those of what the function makes. ``PARTITION BY`` and ``ORDER BY`` may follow the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from folioscope.operators import split

_INT, _TEXT = T.IntegerType(), T.StringType()
_BLOCK = [T.StructField(n, t) for n, t in (("reading_order", _INT), ("kind", _TEXT), ("text", _TEXT), ("char_start", _INT), ("char_end", _INT), ("section_path", T.ArrayType(_TEXT)))]
_PIECE = re.compile(r".+?(?:\n(?:[ \t\r\x0b\x0c]*\n)+|\Z)", re.DOTALL)


def _result(table: AnalyzeArgument, column: AnalyzeArgument, more: list[T.StructField]) -> AnalyzeResult:
    """The table's columns without the named one, then more."""
    if not table.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    if column.value not in table.dataType.names:
        raise ValueError(f"the table has no column {column.value!r}; it has {', '.join(table.dataType.names)}")
    return AnalyzeResult(T.StructType([*(f for f in table.dataType.fields if f.name != column.value), *more]))


def plain(text: str) -> list[dict]:
    """Paragraphs between blank lines."""
    out = []
    for m in _PIECE.finditer(text):
        if inside := m[0].strip():
            start = m.start() + m[0].index(inside)
            out.append({"kind": "paragraph", "text": inside, "char_start": start, "char_end": start + len(inside), "section_path": []})
    return out


@udtf
class SplitFlow:
    """split_flow(TABLE(files), text column, extension column): a row for each block of each file, as the DataFrame function has it."""

    @staticmethod
    def analyze(table: AnalyzeArgument, text: AnalyzeArgument, extension: AnalyzeArgument) -> AnalyzeResult:
        if extension.value not in table.dataType.names:
            raise ValueError(f"the table has no column {extension.value!r}")
        return _result(table, text, _BLOCK)

    def eval(self, row: Row, text: str, extension: str) -> Iterator[tuple]:
        body, ext = row[text], (row[extension] or "").lower()
        if body is None or not body.strip():
            return
        made = split.markdown(body) if ext in ("md", "markdown") else split.delimited(body) if ext in ("csv", "tsv") else plain(body)
        keys = [v for n, v in zip(row.__fields__, row, strict=True) if n != text]
        for n, b in enumerate(made):
            yield (*keys, n, b["kind"], b["text"], b["char_start"], b["char_end"], b["section_path"])


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    spark.udtf.register("split_flow", SplitFlow)
