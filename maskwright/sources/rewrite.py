"""Office and ODF files with values replaced: the archive is rebuilt, and all bytes but the replaced ones stay as they are.

A file is read as ``extract`` reads it, but each piece of text keeps the bytes that it comes from. A span that replaces text in several
pieces puts its own text into the first of them and takes the covered part out of the others. The result is read again and must
give the text that was meant; a value that is still in a part, attribute or field that nobody sees is an error too. So a file is either
rewritten whole or refused.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape, unescape

import pandas as pd
from pyspark.sql import DataFrame

from . import extract as X

FORMATS = ("docx", "xlsx", "pptx", "odt", "ods", "odp")
#: Attributes of a spreadsheet cell that say its value a second time.
_CELL_VALUES = ("value", "date-value", "time-value", "boolean-value", "string-value", "currency", "formula", "value-type")
_TAG = re.compile(rb"<(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>")


@dataclass
class Node:
    """An element with the places of its bytes."""

    tag: str
    attrs: dict[str, str]
    start: int
    end: int = 0
    children: list = field(default_factory=list)  # Node, or Text

    @property
    def kind(self) -> str:
        return self.tag.rpartition(":")[2]

    def attr(self, name: str) -> str | None:
        return next((v for k, v in self.attrs.items() if k.rpartition(":")[2] == name), None)

    def nodes(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.nodes()


@dataclass
class Text:
    value: str
    start: int
    end: int = 0


class Part:
    """One XML member and the changes to its bytes."""

    def __init__(self, name: str, raw: bytes):
        if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
            raise X.Refused("unsafe_xml", "XML with a document type")
        if re.match(rb"(\xff\xfe|\xfe\xff|.{0,60}encoding=[\"'](?!utf-8|us-ascii))", raw[:100], re.I | re.S):
            raise X.Refused("corrupt_document", "XML that isn't UTF-8")
        self.name, self.raw, self.changes = name, raw, []
        parser, stack = expat.ParserCreate(), [Node("", {}, 0)]
        parser.buffer_text = False

        def close() -> None:
            last = stack[-1].children[-1] if stack[-1].children else None
            if isinstance(last, Text) and not last.end:
                last.end = parser.CurrentByteIndex

        def opened(tag, attrs) -> None:
            close()
            node = Node(tag, attrs, parser.CurrentByteIndex)
            stack[-1].children.append(node)
            stack.append(node)

        def closed(tag) -> None:
            close()
            node, at = stack.pop(), parser.CurrentByteIndex
            opening = self.tag_end(node)
            node.end = opening if raw[opening - 2 : opening] == b"/>" else raw.index(b">", at) + 1

        def data(value) -> None:
            last = stack[-1].children[-1] if stack[-1].children else None
            if isinstance(last, Text) and not last.end:
                last.value += value
            else:
                stack[-1].children.append(Text(value, parser.CurrentByteIndex))

        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = opened, closed, data
        parser.CommentHandler = parser.ProcessingInstructionHandler = lambda *_: close()
        try:
            parser.Parse(raw, True)
        except expat.ExpatError as e:
            raise X.Refused("corrupt_document", "XML that can't be parsed") from e
        self.root = next(c for c in stack[0].children if isinstance(c, Node))

    def tag_end(self, node: Node) -> int:
        """The place behind the start tag."""
        return _TAG.match(self.raw, node.start).end()

    def replace(self, start: int, end: int, new: bytes) -> None:
        self.changes.append((start, end, new))

    def tag(self, node: Node, attrs: dict[str, str]) -> None:
        """The node's start tag with other attributes."""
        end = self.tag_end(node)
        close = "/>" if self.raw[end - 2 : end] == b"/>" else ">"
        self.replace(node.start, end, ("<" + " ".join([node.tag, *(f'{k}="{escape(v, {chr(34): "&quot;", chr(10): "&#10;"})}"' for k, v in attrs.items())]) + close).encode())

    def bytes(self) -> bytes:
        out, at = [], 0
        for start, end, new in sorted(self.changes, key=lambda c: (c[0], -c[1])):
            if start < at:
                continue  # inside what is replaced already
            out += [self.raw[at:start], new]
            at = end
        return b"".join([*out, self.raw[at:]])


@dataclass
class Run:
    """Text of one place: of a text node, or (fixed) of an element that stands for it."""

    value: str
    part: Part
    start: int
    end: int
    fixed: bool = False
    cell: Node | None = None


def _runs(part: Part, p: Node, text: tuple[str, ...] | None, stop: tuple[str, ...], marks: dict[str, str], cell: Node | None = None) -> list[Run]:
    """Runs of a paragraph. ``text`` names elements whose text counts; None: all text does."""
    out: list[Run] = []

    def walk(node: Node, counts: bool) -> None:
        if counts and text is not None and not any(isinstance(c, Text) for c in node.children):
            return
        for c in node.children:
            if isinstance(c, Text):
                if counts:
                    out.append(Run(c.value, part, c.start, c.end, cell=cell))
            elif c.kind in marks or (text is None and c.kind == "s"):
                value = " " * int(c.attr("c") or 1) if c.kind == "s" and text is None else marks[c.kind]
                out.append(Run(value, part, c.start, c.end, True, cell))
            elif c.kind not in stop:
                walk(c, text is None or c.kind in text)

    walk(p, text is None)
    return out


class Document:
    """The parts of a file that hold text, and the runs of its paragraphs in the order of ``extract``."""

    def __init__(self, kind: str, raw: bytes):
        self.kind, self.raw = kind, raw
        self.zip = X.open_zip(raw, X.Budget())
        self.parts: dict[str, Part] = {}
        self.paragraphs: list[list[Run]] = []
        self.cells: list[tuple[Node, int]] = []  # cells of shared strings
        getattr(self, f"_{kind}")()

    def part(self, name: str) -> Part | None:
        if name not in self.parts:
            raw = X.member(self.zip, name)
            if raw is None:
                return None
            self.parts[name] = Part(name, raw)
        return self.parts[name]

    def _paragraphs(self, name: str, kinds: tuple[str, ...], **how) -> None:
        part = self.part(name)
        if part is not None:
            self.paragraphs += [_runs(part, p, **how) for p in part.root.nodes() if p.kind in kinds]

    def _docx(self) -> None:
        names = ["word/document.xml", *X.numbered(self.zip, r"word/header(\d*)\.xml"), *X.numbered(self.zip, r"word/footer(\d*)\.xml"), "word/footnotes.xml", "word/endnotes.xml", "word/comments.xml"]
        for name in names:
            self._paragraphs(name, ("p",), text=("t", "delText"), stop=("p",), marks={"tab": "\t", "br": "\n", "cr": "\n"})

    def _pptx(self) -> None:
        for name in X.numbered(self.zip, r"ppt/slides/slide(\d+)\.xml"):
            n = re.search(r"(\d+)", name.rpartition("/")[2])[1]
            for part in (name, f"ppt/notesSlides/notesSlide{n}.xml"):
                self._paragraphs(part, ("p",), text=("t",), stop=("p",), marks={"br": "\n", "tab": "\t"})

    def _odf(self, part: Part, p: Node, cell: Node | None = None) -> list[Run]:
        return _runs(part, p, None, ("p", "h"), {"tab": "\t", "line-break": "\n"}, cell)

    def _odt(self) -> None:
        for name in ("content.xml", "styles.xml"):
            part = self.part(name)
            if part is not None:
                self.paragraphs += [self._odf(part, p) for p in part.root.nodes() if p.kind in ("p", "h")]

    def _odp(self) -> None:
        part = self.part("content.xml")
        for page in (n for n in part.root.nodes() if n.kind == "page"):
            noted = {id(p) for notes in page.nodes() if notes.kind == "notes" for p in notes.nodes()}
            own = [p for p in page.nodes() if p.kind in ("p", "h")]
            self.paragraphs += [self._odf(part, p) for p in own if id(p) not in noted] + [self._odf(part, p) for p in own if id(p) in noted]

    def _ods(self) -> None:
        part = self.part("content.xml")
        for cell in (c for t in part.root.nodes() if t.kind == "table" for r in t.nodes() if r.kind == "table-row" for c in r.children if isinstance(c, Node) and c.kind in ("table-cell", "covered-table-cell")):
            runs: list[Run] = []
            for p in (p for p in cell.nodes() if p.kind in ("p", "h")):
                if runs:
                    runs.append(Run("\n", part, p.start, p.start, True, cell))
                runs += self._odf(part, p, cell) or [Run("", part, p.start, p.start, True, cell)]
            if any(r.value for r in runs):
                self.paragraphs.append(runs)

    def _xlsx(self) -> None:
        shared = self.part("xl/sharedStrings.xml")
        self.strings = [si for si in shared.root.children if isinstance(si, Node) and si.kind == "si"] if shared else []
        plain = lambda n: "".join(c.value for t in n.nodes() if t.kind == "t" for c in t.children if isinstance(c, Text))
        book, rels = self.part("xl/workbook.xml"), self.part("xl/_rels/workbook.xml.rels")
        sheets: list[str] = []
        if book and rels:
            targets = {r.attr("Id"): r.attr("Target") or "" for r in rels.root.nodes()}
            for s in (n for n in book.root.nodes() if n.kind == "sheet"):
                t = targets.get(s.attr("id"), "")
                sheets.append(t.lstrip("/") if t.startswith("/") else f"xl/{t}")
        if not sheets or any(n not in self.zip.namelist() for n in sheets):
            sheets = X.numbered(self.zip, r"xl/worksheets/sheet(\d+)\.xml")
        for name in sheets:
            part = self.part(name)
            for c in (n for n in part.root.nodes() if n.kind == "c"):
                v = next((n for n in c.children if isinstance(n, Node) and n.kind == "v"), None)
                value = "".join(x.value for x in v.children if isinstance(x, Text)) if v else ""
                if c.attr("t") == "inlineStr":
                    self.paragraphs.append([Run(x.value, part, x.start, x.end) for t in c.nodes() if t.kind == "t" for x in t.children if isinstance(x, Text)])
                    continue
                if c.attr("t") == "s":
                    k = int(value) if value.isdigit() and int(value) < len(self.strings) else -1
                    self.cells.append((c, k))
                    value = plain(self.strings[k]) if k >= 0 else ""
                self.paragraphs.append([Run(value, part, c.start, c.end, cell=c)])

    def text(self) -> str:
        return "\n".join(t for t in ("".join(r.value for r in p) for p in self.paragraphs) if t.strip())

    def rewritten(self, spans: list[tuple[int, int, str]]) -> bytes:
        text, at, touched = self.text(), 0, set()
        spans = sorted(spans)
        values = {text[a:z] for a, z, _ in spans if z - a >= 4}
        for p in self.paragraphs:
            if not "".join(r.value for r in p).strip():
                continue
            for r in p:
                end = at + len(r.value)
                own = [(a, z, new) for a, z, new in spans if a < end and z > at]
                if own:
                    self._change(r, at, own)
                    touched.add(id(p))
                at = end
            at += 1
        if self.kind == "docx":
            self._flatten(touched)
        if self.kind == "xlsx":
            self._orphans()
        self._scrub(values)
        return self._rebuilt(values)

    def _change(self, r: Run, at: int, spans: list[tuple[int, int, str]]) -> None:
        out, done = [], 0
        for a, z, new in spans:
            a0, z0 = max(a - at, 0), min(z - at, len(r.value))
            out += [r.value[done:a0], new if a >= at else ""]
            done = z0
        out.append(r.value[done:])
        new = "".join(out)
        if r.fixed:
            if new and new != r.value:
                raise X.Refused("not_rewritable", "a span ends inside an element that stands for text")
            if not new:
                r.part.replace(r.start, r.end, b"")
        elif r.cell is not None and self.kind == "xlsx":
            c, pre = r.cell, r.cell.tag.rpartition(":")[0]
            pre = pre + ":" if pre else ""
            attrs = "".join(f' {k}="{escape(v)}"' for k, v in c.attrs.items() if k not in ("t", "cm", "vm"))
            r.part.replace(c.start, c.end, f'<{c.tag}{attrs} t="inlineStr"><{pre}is><{pre}t xml:space="preserve">{escape(new)}</{pre}t></{pre}is></{c.tag}>'.encode())
            c.attrs["t"] = "changed"
        else:
            r.part.replace(r.start, r.end, escape(new).encode())
            if r.cell is not None:
                kept = {k: v for k, v in r.cell.attrs.items() if k.rpartition(":")[2] not in _CELL_VALUES}
                office = next((k.rpartition(":")[0] for k in r.cell.attrs if k.endswith(":value-type")), None)
                r.part.tag(r.cell, kept | ({f"{office}:value-type": "string"} if office else {}))

    def _flatten(self, touched: set[int]) -> None:
        """Fields of the touched paragraphs keep what they show and lose their instructions."""
        places = {(r.part.name, r.start) for p in self.paragraphs if id(p) in touched for r in p}
        for part in self.parts.values():
            for p in (n for n in part.root.nodes() if n.kind == "p"):
                if not any((part.name, c.start) in places for t in p.nodes() for c in t.children if isinstance(c, Text)):
                    continue
                marks = [n for n in p.nodes() if n.kind == "fldChar"]
                kinds = [n.attr("fldCharType") for n in marks]
                if kinds.count("begin") != kinds.count("end"):
                    raise X.Refused("not_rewritable", "a field goes beyond its paragraph")
                for n in p.nodes():
                    if n.kind in ("fldChar", "instrText", "delInstrText"):
                        part.replace(n.start, n.end, b"")
                    elif n.kind == "fldSimple":
                        part.replace(n.start, part.tag_end(n), b"")
                        part.replace(part.raw.rindex(b"</", 0, n.end), n.end, b"")

    def _orphans(self) -> None:
        """Shared strings that only changed cells had are emptied."""
        used = {k for c, k in self.cells if c.attrs.get("t") == "s"}
        for k in {k for c, k in self.cells if c.attrs.get("t") == "changed"} - used:
            for t in self.strings[k].nodes() if k >= 0 else ():
                for x in t.children:
                    if isinstance(x, Text):
                        self.parts["xl/sharedStrings.xml"].replace(x.start, x.end, b"")

    def _scrub(self, values: set[str]) -> None:
        """Attributes that say a replaced value again have marks in its place."""
        for part in self.parts.values():
            tagged = {s for s, _, _ in part.changes}
            for n in part.root.nodes():
                if n.start not in tagged and any(v in x for v in values for x in n.attrs.values()):
                    attrs = dict(n.attrs)
                    for v in sorted(values, key=len, reverse=True):
                        attrs = {k: x.replace(v, "*" * len(v)) for k, x in attrs.items()}
                    part.tag(n, attrs)

    def _rebuilt(self, values: set[str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for info in self.zip.infolist():
                part = self.parts.get(info.filename)
                raw = part.bytes() if part is not None and part.changes else self.zip.read(info)
                if part is None and info.filename.endswith((".xml", ".rels")):
                    seen = unescape(raw.decode("utf-8", "replace"), {"&quot;": '"', "&apos;": "'"})
                    if any(v in seen for v in values):
                        raise X.Refused("not_rewritable", "a part without text of its own holds a replaced value")
                z.writestr(info, raw, info.compress_type)
        return out.getvalue()


def rewrite(path: str, raw: bytes, spans: list[tuple[int, int, str]]) -> bytes:
    """The file with the spans of its text replaced. Raises Refused where that isn't possible or the result isn't what was meant."""
    kind = path.lower().rpartition(".")[2]
    if kind not in FORMATS or not raw.startswith(X.ZIP):
        raise X.Refused("not_rewritable", "a format that isn't rewritten")
    document = Document(kind, raw)
    text = document.text()
    if text != X.read(path, raw, len(raw) + 1)[2]:
        raise X.Refused("not_rewritable", "the text's places can't be told")
    spans = sorted(spans)
    if any(a < 0 or z > len(text) or a >= z for a, z, _ in spans) or any(b[0] < a[1] for a, b in zip(spans, spans[1:])):
        raise X.Refused("not_rewritable", "spans overlap or lie outside the text")
    out = document.rewritten(spans)
    want, at = [], 0
    for a, z, new in spans:
        want += [text[at:a], new]
        at = z
    if X.read(path, out, len(out) + 1)[2] != "".join([*want, text[at:]]):
        raise X.Refused("not_rewritable", "the rewritten file doesn't read as it should")
    return out


def rewritten(files: DataFrame) -> DataFrame:
    """(path, output, code, reason) of (path, content, spans): each file whole, or why not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, spans in zip(b["path"], b["content"], b["spans"]):
                try:
                    rows.append((path, rewrite(path, bytes(content), [(int(s["start"]), int(s["end"]), s["text"]) for s in spans]), None, None))
                except X.Refused as e:
                    rows.append((path, None, e.code, e.reason))
            yield pd.DataFrame(rows, columns=["path", "output", "code", "reason"])

    return files.select("path", "content", "spans").mapInPandas(run, "path string, output binary, code string, reason string")
