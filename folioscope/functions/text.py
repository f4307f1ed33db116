"""Text expressions: trimming, token counts, sentences, the text-layer gate, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word (letters, numbers, underscore) or one sign; the classes agree with Python's on accents, superscripts and separators.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f]"
BLANK = r"[\s\x1c-\x1f]"
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"
TOKENS_PER_PIECE = 1.3
# Fixed value: the end of a sentence: white space after . ! or ?, perhaps closed by a quote or bracket, before a capital, quote or bracket.
SENTENCE_END = r"""(?:(?<=[.!?])|(?<=[.!?]["')\]]))\s+(?=[A-Z("'])"""

# Fixed values of the text-layer gate: limits and factors.
GATE_THRESHOLD = 0.72
GLYPH_CODE = r"\(cid:\d+\)"
GLYPH_CODE_LIMIT, GLYPH_CODE_FACTOR = 0.02, 3.0
REPLACEMENT = "�"
REPLACEMENT_LIMIT, REPLACEMENT_FACTOR = 0.005, 10.0
DENSITY_LIMIT, DENSITY_FLOOR = 0.35, 0.15
SHAPE_LIMIT, SHAPE_LEAST_WORDS = 0.65, 8


def strip(text: Column) -> Column:
    """text without white space at either end, in the Unicode sense."""
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(NOT_BLANK)  # ends at the first other character, and makes no text


def approx_tokens(text: Column) -> Column:
    """About how many model tokens a text has; 0 for a blank one, else 1 or more."""
    pieces = F.regexp_count(text, F.lit(TOKEN)) * F.lit(TOKENS_PER_PIECE)
    return F.when(is_blank(text), F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(pieces).cast("int")))


def sentences(text: Column) -> Column:
    """Array of a text's sentences, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def word_shape(text: Column) -> Column:
    """Share of runs of two or more ASCII letters that hold a vowel (y counts); 1 with few runs."""
    runs = F.regexp_count(text, F.lit("[A-Za-z]{2,}"))
    voiced = F.regexp_count(text, F.lit("(?<![A-Za-z])(?=[A-Za-z]{2})[A-Za-z]*?[aeiouyAEIOUY][A-Za-z]*"))
    return F.when(runs < SHAPE_LEAST_WORDS, F.lit(1.0)).otherwise(voiced / runs)


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.transform(F.array(value), use)[0]


def _shown(x: Column, digits: int) -> Column:
    """A number with so many decimals; a half that a double holds exactly goes to the even digit."""
    ties = x * 2.0 ** (digits + 1)
    return F.format_string(f"%.{digits}f", F.when(ties == F.floor(ties), F.bround(x, digits)).otherwise(x))


def text_gate(text: Column, width: Column, height: Column, threshold: float = GATE_THRESHOLD) -> Column:
    """struct(confidence, needs_ocr, reasons): how far a page's text layer can be trusted.

    Signals multiply: glyph codes, replacement characters, few characters for the page's
    area, and runs without vowels. A page without a positive size is an error.
    """
    text = F.coalesce(text, F.lit(""))
    total = F.nullif(F.length(text), F.lit(0))
    signals = F.struct(
        F.length(strip(text)).alias("inside"),
        ((F.length(text) - F.length(F.regexp_replace(text, GLYPH_CODE, ""))) / total).alias("glyphs"),
        ((F.length(text) - F.length(F.replace(text, F.lit(REPLACEMENT), F.lit("")))) / total).alias("broken"),
        (F.length(strip(text)) / F.nullif(width * height / 1000.0, F.lit(0.0))).alias("density"),
        word_shape(text).alias("shape"),
    )
    factor = lambda on, value: F.when(on, value).otherwise(F.lit(1.0))
    floor0 = lambda x: F.greatest(F.lit(0.0), x)

    def judged(s: Column) -> Column:
        glyphs, broken, density, shape = s["glyphs"], s["broken"], s["density"], s["shape"]
        confidence = (
            factor(glyphs > GLYPH_CODE_LIMIT, floor0(1.0 - glyphs * GLYPH_CODE_FACTOR))
            * factor(broken > REPLACEMENT_LIMIT, floor0(1.0 - broken * REPLACEMENT_FACTOR))
            * factor(density < DENSITY_LIMIT, F.greatest(F.lit(DENSITY_FLOOR), density / DENSITY_LIMIT))
            * factor(shape < SHAPE_LIMIT, shape)
        )
        confidence = F.when(s["inside"] == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), floor0(confidence)))
        reasons = F.array_compact(
            F.array(
                F.when(glyphs > GLYPH_CODE_LIMIT, F.concat(F.lit("cid_glyphs="), _shown(glyphs * 100.0, 0), F.lit("%"))),
                F.when(broken > REPLACEMENT_LIMIT, F.concat(F.lit("replacement_chars="), _shown(broken * 100.0, 1), F.lit("%"))),
                F.when(density < DENSITY_LIMIT, F.concat(F.lit("sparse_text density="), _shown(density, 2))),
                F.when(shape < SHAPE_LIMIT, F.concat(F.lit("unwordlike_text="), _shown(shape, 2))),
            )
        )
        reasons = F.when(s["inside"] == 0, F.array(F.lit("empty_text_layer"))).otherwise(reasons)
        return F.struct(confidence.alias("confidence"), (confidence < threshold).alias("needs_ocr"), reasons.alias("reasons"))

    kind = "struct<confidence:double,needs_ocr:boolean,reasons:array<string>>"
    return F.coalesce(F.when((width > 0) & (height > 0), _once(signals, judged)), F.raise_error(F.lit("a page's size must be positive")).cast(kind))


def locating_prefix(company: Column, form: Column, year: Column, name: Column, section_path: Column, page: Column) -> Column:
    """The line that tells where a chunk comes from."""
    has = lambda c: c.isNotNull() & (c != "")
    formed = F.when(has(form), F.concat_ws(" ", form, F.when(year > 0, year.cast("string"))))
    who = F.concat_ws(" ", F.when(has(company), company), formed)
    who = F.when(who != "", who).when(has(name), name).otherwise(F.lit("document"))
    where = F.array_join(F.coalesce(section_path, F.array().cast("array<string>")), " > ")
    return F.concat(
        F.lit("From "), who, F.when(where != "", F.concat(F.lit(", section "), where)).otherwise(F.lit("")),
        F.when(page > 0, F.concat(F.lit(", page "), page.cast("string"))).otherwise(F.lit("")), F.lit("."),
    )


def embedding_text(prefix: Column, text: Column) -> Column:
    """What is embedded for a chunk: its prefix, if it has one, an empty line, its text."""
    return F.when(prefix.isNotNull() & (prefix != ""), F.concat(prefix, F.lit("\n\n"), text)).otherwise(text)


def marker_split(text: Column) -> Column:
    """A text's parts at citation markers like [3]; the markers are parts of their own."""
    return F.filter(F.split(text, r"(?<=\[\d{1,2}\])|(?=\[\d{1,2}\])"), lambda s: s != "")


def highlight_window(text: Column, start: Column, end: Column, around: int = 2000) -> Column:
    """struct(before, marked, after) of an excerpt around the characters start to end."""
    lo = F.greatest(F.lit(0), start - around)
    return F.struct(
        F.substring(text, lo + 1, start - lo).alias("before"),
        F.substring(text, start + 1, end - start).alias("marked"),
        F.substring(text, end + 1, F.lit(around)).alias("after"),
    )
