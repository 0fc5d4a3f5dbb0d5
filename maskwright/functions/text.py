"""Column builders on text: exact spans, positions, masks, entropy, checks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
_MARK, _OTHER = "\u0001", "\u0002"


#: Parts that are put together at a time, an even number, and characters of a piece of an index.
STEP, PIECE = 128, 1024


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def match_spans(text: Column, pattern: str, replacement: str = f"{_MARK}$0{_MARK}", most: int | None = None) -> Column:
    """All matches (of very many, ``most`` and some more) as half-open code-point spans, in one regular-expression pass.

    Matches are put between marks, the text is split at them, and every second part is a match; starts are sums of the
    lengths before, taken STEP parts at a time, so that the cost follows the text and not the square of its matches. A
    mark in the text itself counts as another control character, in the span's value too (``sliced`` gives the text's own).
    ``replacement`` may mark a group.
    """
    none = F.array().cast(SPAN)

    def step(a, part):
        end = a["at"] + F.length(part)
        span = F.struct(a["at"].alias("start"), end.alias("end"), part.alias("value"))
        return F.struct(end.alias("at"), (~a["hit"]).alias("hit"), F.when(a["hit"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    def chunk(a, c):
        ends = F.aggregate(c, F.struct(a["at"].alias("at"), F.lit(False).alias("hit"), none.alias("out")), step)
        return let(ends, lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    def spans(parts):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / STEP).cast("int")), lambda i: F.slice(parts, i * STEP + 1, F.lit(STEP)))
        return F.flatten(F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), chunk, lambda a: a["out"]))

    parts = F.split(F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, replacement), _MARK, -1)
    if most is not None:
        parts = F.slice(parts, 1, 2 * most + STEP)
    return F.when(F.coalesce(text, F.lit("")).rlike(pattern), let(parts, spans)).otherwise(none)


def index(text: Column) -> Column:
    """The text in pieces of PIECE code points, each with the line feeds before it and the place of the last of them (-1: none).

    Made once for a text, it gives slices, lines and columns at the cost of a piece, wherever in the text they are.
    """
    pieces = F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("lines"), F.lit(-1).alias("last"), F.array().cast("array<struct<piece:string,lines:int,last:int>>").alias("out"))

    def step(a, p):
        feeds = F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))
        last = F.when(F.contains(p, F.lit("\n")), a["at"] + F.length(p) - F.length(F.substring_index(p, "\n", -1)) - 1).otherwise(a["last"])
        out = F.concat(a["out"], F.array(F.struct(p.alias("piece"), a["lines"].alias("lines"), a["last"].alias("last"))))
        return F.struct((a["at"] + F.length(p)).alias("at"), (a["lines"] + feeds).alias("lines"), last.alias("last"), out.alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def _piece(at: Column) -> Column:
    return F.floor(at / PIECE).cast("int")


def sliced(index: Column, start: Column, end: Column) -> Column:
    """The code points of an indexed text from start to end; less where the text ends before."""
    first, last = _piece(start), _piece(F.greatest(end - 1, start))
    many = F.array_join(F.transform(F.slice(index, first + 1, last - first + 1), lambda x: x["piece"]), "")
    part = F.when(first == last, F.get(index, first)["piece"]).otherwise(many)
    return F.coalesce(F.substring(part, start - first * PIECE + 1, end - start), F.lit(""))


def place(index: Column, start: Column) -> Column:
    """(line, column) of a code point of an indexed text, both from 1."""

    def placed(x):
        line = x["lines"] + F.length(x["before"]) - F.length(F.replace(x["before"], F.lit("\n"), F.lit(""))) + 1
        column = F.when(F.contains(x["before"], F.lit("\n")), F.length(F.substring_index(x["before"], "\n", -1)) + 1).otherwise(start - x["last"])
        return F.struct(line.cast("int").alias("line"), column.cast("int").alias("column"))

    before = lambda x: F.substring(x["piece"], F.lit(1), start - _piece(start) * PIECE).alias("before")
    return let(F.get(index, _piece(start)), lambda x: let(F.struct(before(x), x["lines"].alias("lines"), x["last"].alias("last")), placed))


def location(segments: Column, offset: Column) -> Column:
    """Label of the last segment that starts at or before the offset, else the first one's; null without segments."""
    before = F.filter(segments, lambda s: s["start"] <= offset)
    return F.when(F.size(segments) > 0, F.coalesce(F.element_at(before, -1)["label"], F.get(segments, F.lit(0))["label"]))


#: The border of a word of ASCII letters, digits and _; Java's own \b counts letters of all scripts, with or without (?U).
_WORD = "[0-9A-Za-z_]"
_BORDER = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
#: What simple case folding adds to ASCII letters.
_FOLDED = {"k": "\\x{212a}", "s": "\\x{17f}"}


def re2_pattern(pattern: str) -> str:
    """A Java pattern that finds what RE2 (DuckDB) finds by this one of ASCII characters, its U flag apart: borders, digits, words and
    spaces of ASCII, and (?i) by simple case folding, which joins k and s with one letter each beyond ASCII."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)|", pattern)
    fold = "i" in (flags[1] or "")
    out, inside = [], None  # inside: the start in out of the class that is open
    for part in re.findall(r"\\x\{[0-9a-fA-F]+\}|\\.|\(\?[:=!<]*|\[\^?\]?|.", pattern[flags.end() :], re.S):
        own = chr(int(part[3:-1], 16)) if part.startswith("\\x{") else part
        if not own.isascii():
            raise ValueError(f"beyond ASCII: {pattern}")
        if inside is None and part[0] == "[":
            inside = len(out)
        elif inside is not None and part == "]":
            known = re.compile("".join(out[inside:]) + "]", re.I)
            negated = out[inside].startswith("[^")
            part = "".join(x for c, x in _FOLDED.items() if fold and (known.match(c) is None) == negated) + part
            inside = None
        elif part == "\\b":
            part = _BORDER
        elif part == "\\s":
            part = "\\t\\n\\f\\r " if inside is not None else "[\\t\\n\\f\\r ]"
        elif fold and inside is None and own.lower() in _FOLDED:
            part = f"[{own}{_FOLDED[own.lower()]}]"
        out.append(part)
    kept = "".join(f for f in flags[1] or "" if f not in "uU")
    return (f"(?{kept})" if kept else "") + "".join(out)


def literal_pattern(value: str) -> str:
    """A case-insensitive pattern for a literal."""
    return "(?iu)" + "".join(f"\\x{{{ord(c):x}}}" for c in value)


def strip_quotes(span: Column) -> Column:
    """A span without the equal quotes around its value."""
    v = span["value"]
    quoted = (F.length(v) >= 2) & F.left(v, F.lit(1)).isin("'", '"') & (F.left(v, F.lit(1)) == F.right(v, F.lit(1)))
    inner = F.struct((span["start"] + 1).alias("start"), (span["end"] - 1).alias("end"), F.expr("''").alias("value"))
    return F.when(quoted, inner.withField("value", F.substring(v, F.lit(2), F.length(v) - 2))).otherwise(span)


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(value)
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.when(n > 0, -F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))).otherwise(F.lit(0.0))


def luhn(value: Column) -> Column:
    """At least 12 digits, other characters apart, with a right check digit."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.length(digits) >= 12, F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def preview(value: Column) -> Column:
    """First and last two characters around stars, 32 at most; all stars up to four."""
    n = F.length(value)
    stars = F.repeat(F.lit("*"), F.least(n - 4, F.lit(28)))
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), stars, F.right(value, F.lit(2))))


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 16)


def safe(mask: Column, value: Column) -> Column:
    """The mask, or marks of another kind where the value itself would survive in it."""
    n = F.length(value)
    full = F.repeat(F.lit("*"), n)
    whole = F.when((n > 0) & F.contains(F.lower(full), F.lower(value)), F.repeat(F.lit("#"), n)).otherwise(full)
    return F.when(mask.isNull() | F.contains(F.lower(mask), F.lower(value)), whole).otherwise(mask)
