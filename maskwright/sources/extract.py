"""Text of plain and structured files, with labelled segments. Pure Python on one file's bytes, used inside mapInPandas."""

from __future__ import annotations

import codecs
import email
import email.policy
import io
import re
import signal
import threading
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from xml.etree import ElementTree as ET

# Limits and signatures that results must share.
SNIFF, PRINTABLE_SHARE = 8000, 0.90
MOST_MEMBERS, MOST_MEMBER, MOST_TOTAL, MOST_RATIO, MOST_DEPTH, MOST_TEXT = 10_000, 10_000_000, 50_000_000, 200, 3, 50_000_000
BOMS = ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
HEADERS = ("From", "To", "Cc", "Bcc", "Reply-To", "Subject")
IMAGES = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF87a", b"GIF89a", b"BM", b"II*\x00", b"MM\x00*")
OLE, ZIP, PDF = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"PK\x03\x04", b"%PDF-"


class Refused(Exception):
    """A file that has no text for us: (code, reason)."""

    def __init__(self, code: str, reason: str):
        super().__init__(reason)
        self.code, self.reason = code, reason


def decode(raw: bytes) -> tuple[str, str, bytes]:
    """(text, codec, byte order mark): by mark, else UTF-8, else Windows-1252 if nearly all of it prints."""
    for bom, codec in BOMS:
        if raw.startswith(bom):
            try:
                return raw[len(bom) :].decode(codec), codec, bom
            except UnicodeDecodeError as e:
                raise Refused("unsupported_encoding", f"not {codec}") from e
    if b"\0" in raw[:SNIFF]:
        raise Refused("binary_file", unsupported(raw) or "it has zero bytes")
    try:
        return raw.decode("utf-8"), "utf-8", b""
    except UnicodeDecodeError:
        try:
            text = raw.decode("cp1252")
        except UnicodeDecodeError as e:
            raise Refused("unsupported_encoding", "no known encoding") from e
        head = text[:SNIFF]
        if sum(c.isprintable() or c in "\t\r\n" for c in head) < PRINTABLE_SHARE * len(head):
            raise Refused("unsupported_encoding", "too few characters print") from None
        return text, "cp1252", b""


def unsupported(raw: bytes) -> str | None:
    if raw.startswith(OLE):
        return "an Outlook message or a legacy office file"
    if raw.startswith(IMAGES):
        return "an image"
    return "an archive of an unknown kind" if raw.startswith(ZIP) else None


class Budget:
    """Bytes that an archive and those inside it may still unpack to."""

    def __init__(self, most: int = MOST_TOTAL):
        self.left = most


def open_zip(raw: bytes, budget: Budget) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise Refused("corrupt_archive", "not a readable archive") from e
    infos, names = z.infolist(), set()
    if len(infos) > MOST_MEMBERS:
        raise Refused("archive_limit", "too many members")
    total = 0
    for i in infos:
        parts = i.filename.replace("\\", "/").split("/")
        if i.flag_bits & 1:
            raise Refused("encrypted", "an encrypted member")
        if i.filename.startswith(("/", "\\")) or ".." in parts or re.match(r"^[A-Za-z]:", i.filename):
            raise Refused("unsafe_archive", "a member's path leaves the archive")
        if i.filename.casefold() in names:
            raise Refused("unsafe_archive", "members' paths repeat")
        names.add(i.filename.casefold())
        if i.file_size > MOST_MEMBER or i.file_size > MOST_RATIO * max(1, i.compress_size):
            raise Refused("archive_limit", "a member unpacks to too much")
        total += i.file_size
    if total > budget.left:
        raise Refused("archive_limit", "the members unpack to too much")
    budget.left -= total
    return z


def member(z: zipfile.ZipFile, name: str) -> bytes | None:
    try:
        with z.open(name) as f:
            out = f.read(MOST_MEMBER + 1)
    except KeyError:
        return None
    except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError) as e:
        raise Refused("corrupt_archive", "a damaged member") from e
    if len(out) > MOST_MEMBER:
        raise Refused("archive_limit", "a member unpacks to too much")
    return out


def xml(raw: bytes | None) -> ET.Element | None:
    if raw is None:
        return None
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise Refused("unsafe_xml", "XML with a document type")
    try:
        return ET.fromstring(raw)
    except ET.ParseError as e:
        raise Refused("corrupt_document", "XML that can't be parsed") from e


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1] or 0), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


Segment = tuple[str, str]  # label, text


def _own_text(p: ET.Element, stop: tuple[str, ...], text: tuple[str, ...], tab: dict[str, str]) -> str:
    """Text of an element without that of inner elements of the kinds ``stop``."""
    out: list[str] = []
    todo = [(c, False) for c in reversed(list(p))]
    while todo:
        e, _ = todo.pop()
        kind = local(e)
        if kind in stop:
            continue
        if kind in text:
            out.append(e.text or "")
        elif kind in tab:
            out.append(tab[kind])
        todo += [(c, False) for c in reversed(list(e))]
    return "".join(out)


def docx(z: zipfile.ZipFile) -> list[Segment]:
    parts = ["word/document.xml", *numbered(z, r"word/header(\d*)\.xml"), *numbered(z, r"word/footer(\d*)\.xml"), "word/footnotes.xml", "word/endnotes.xml", "word/comments.xml"]
    out: list[Segment] = []
    for part in parts:
        root = xml(member(z, part))
        if root is None:
            if part == "word/document.xml":
                raise Refused("corrupt_document", "no document part")
            continue
        boxed = {id(p) for box in root.iter() if local(box) == "txbxContent" for p in box.iter() if local(p) == "p"}
        where = "" if part == "word/document.xml" else f"{part.rpartition('/')[2].removesuffix('.xml')} "
        for n, p in enumerate((e for e in root.iter() if local(e) == "p"), 1):
            out.append((f"{where}paragraph {n}" + " (text box)" * (id(p) in boxed), _own_text(p, ("p",), ("t", "delText"), {"tab": "\t", "br": "\n", "cr": "\n"})))
    return out


def pptx(z: zipfile.ZipFile) -> list[Segment]:
    out: list[Segment] = []
    for name in numbered(z, r"ppt/slides/slide(\d+)\.xml"):
        n = re.search(r"(\d+)", name.rpartition("/")[2])[1]
        for label, part in ((f"slide {n}", name), (f"slide {n} notes", f"ppt/notesSlides/notesSlide{n}.xml")):
            root = xml(member(z, part))
            if root is not None:
                out += [(label, _own_text(p, ("p",), ("t",), {"br": "\n", "tab": "\t"})) for p in root.iter() if local(p) == "p"]
    return out


def column_letters(n: int) -> str:
    """A for 0, Z for 25, AA for 26."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx(z: zipfile.ZipFile) -> list[Segment]:
    shared = xml(member(z, "xl/sharedStrings.xml"))
    strings = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in shared if local(si) == "si"] if shared is not None else []
    book, rels = xml(member(z, "xl/workbook.xml")), xml(member(z, "xl/_rels/workbook.xml.rels"))
    sheets: list[tuple[str, str]] = []
    if book is not None and rels is not None:
        targets = {r.get("Id"): r.get("Target", "") for r in rels}
        for s in (e for e in book.iter() if local(e) == "sheet"):
            target = targets.get(attribute(s, "id"), "")
            sheets.append((s.get("name", ""), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    if not sheets or any(p not in z.namelist() for _, p in sheets):
        sheets = [(f"Sheet{k}", n) for k, n in enumerate(numbered(z, r"xl/worksheets/sheet(\d+)\.xml"), 1)]
    out: list[Segment] = []
    for name, part in sheets:
        root = xml(member(z, part))
        for c in (e for e in root.iter() if local(e) == "c") if root is not None else ():
            kind = c.get("t")
            value = next((v.text or "" for v in c if local(v) == "v"), "")
            if kind == "s":
                value = strings[int(value)] if value.isdigit() and int(value) < len(strings) else ""
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter() if local(t) == "t")
            out.append((f"{name}!{c.get('r', '')}", value))
    return out


def _mixed(p: ET.Element, stop: tuple[str, ...]) -> str:
    """Text and tails of an ODF paragraph, inner paragraphs left out but not what follows them."""
    out = [p.text or ""]
    for e in p:
        kind = local(e)
        if kind == "s":
            out.append(" " * int(attribute(e, "c") or 1))
        elif kind in ("tab", "line-break"):
            out.append("\t" if kind == "tab" else "\n")
        elif kind not in stop:
            out.append(_mixed(e, stop))
        out.append(e.tail or "")
    return "".join(out)


_BLOCKS = ("p", "h")


def odt(z: zipfile.ZipFile) -> list[Segment]:
    out: list[Segment] = []
    for part, where in (("content.xml", ""), ("styles.xml", "styles ")):
        root = xml(member(z, part))
        if root is None:
            if not where:
                raise Refused("corrupt_document", "no content part")
            continue
        out += [(f"{where}paragraph {n}", _mixed(p, _BLOCKS)) for n, p in enumerate((e for e in root.iter() if local(e) in _BLOCKS), 1)]
    return out


def ods(z: zipfile.ZipFile) -> list[Segment]:
    root, out = xml(member(z, "content.xml")), []
    for t in (e for e in root.iter() if local(e) == "table") if root is not None else ():
        row = 0
        for r in (e for e in t.iter() if local(e) == "table-row"):
            column = 0
            for c in (e for e in r if local(e) in ("table-cell", "covered-table-cell")):
                text = "\n".join(_mixed(p, _BLOCKS) for p in c.iter() if local(p) in _BLOCKS)
                if text:
                    out.append((f"{attribute(t, 'name') or 'Sheet'}!{column_letters(column)}{row + 1}", text))
                column += int(attribute(c, "number-columns-repeated") or 1)
            row += int(attribute(r, "number-rows-repeated") or 1)
    return out


def odp(z: zipfile.ZipFile) -> list[Segment]:
    root, out = xml(member(z, "content.xml")), []
    for n, page in enumerate((e for e in root.iter() if local(e) == "page") if root is not None else (), 1):
        noted = {id(p) for notes in page.iter() if local(notes) == "notes" for p in notes.iter()}
        paragraphs = [e for e in page.iter() if local(e) in _BLOCKS]
        out += [(f"slide {n}", _mixed(p, _BLOCKS)) for p in paragraphs if id(p) not in noted]
        out += [(f"slide {n} notes", _mixed(p, _BLOCKS)) for p in paragraphs if id(p) in noted]
    return out


def eml(raw: bytes) -> list[Segment]:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    head = "\n".join(f"{h}: {message[h]}" for h in HEADERS if message[h])
    out, n = [("headers", head)], 0
    for part in message.walk():
        if part.get_content_maintype() == "text" and not part.is_multipart():
            n += 1
            body = part.get_payload(decode=True) or b""
            try:
                text = body.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                text = body.decode("utf-8", "replace")
            out.append((f"part {n}", text))
    return out


def pdf(raw: bytes) -> list[Segment]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise Refused("missing_extractor", "PDF needs the optional pypdf") from e
    reader = PdfReader(io.BytesIO(raw))
    if reader.is_encrypted:
        raise Refused("encrypted", "an encrypted document")
    if len(reader.pages) > 10_000:
        raise Refused("document_limit", "too many pages")
    out = [(f"page {n}", page.extract_text() or "") for n, page in enumerate(reader.pages, 1)]
    if not any(t.strip() for _, t in out):
        raise Refused("no_text", "no text on any page")
    return out


def archive(raw: bytes, budget: Budget, depth: int) -> list[Segment]:
    if depth > MOST_DEPTH:
        raise Refused("archive_limit", "archives nest too deep")
    z, out = open_zip(raw, budget), []
    for name in (i.filename for i in z.infolist() if not i.is_dir()):
        try:
            inner = member(z, name)
            kind, found = segments(name, inner, budget, depth + 1)
            if kind == "text":
                found = [("", decode(inner)[0])]
        except Refused as e:
            if e.code in ("archive_limit", "unsafe_archive", "encrypted"):
                raise
            continue
        out += [(f"{name} · {label}" if label else name, text) for label, text in found]
    return out


_PACKED = {".docx": docx, ".pptx": pptx, ".xlsx": xlsx, ".odt": odt, ".ods": ods, ".odp": odp}


def segments(path: str, raw: bytes, budget: Budget, depth: int = 0) -> tuple[str, list[Segment]]:
    """(format, segments) by suffix and signature; format is text where they disagree or nothing structured is meant."""
    suffix = re.search(r"(\.[^./]+)?$", path.lower())[0]
    if suffix in _PACKED and raw.startswith(ZIP):
        return suffix[1:], _PACKED[suffix](open_zip(raw, budget))
    if suffix == ".zip" and raw.startswith(ZIP):
        return "zip", archive(raw, budget, depth)
    if suffix == ".pdf" and raw.startswith(PDF):
        return "pdf", pdf(raw)
    if suffix == ".eml":
        return "eml", eml(raw)
    return "text", []


@contextmanager
def deadline(seconds: float | None) -> Iterator[None]:
    """Refuses what takes longer. Only a process's main thread, which Spark's workers use, can be stopped like this."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise Refused("extraction_timeout", f"reading took more than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def read(path: str, raw: bytes, most_document: int, seconds: float | None = None) -> tuple:
    """A row of files.DOCS; ``seconds`` is how long it may take."""
    try:
        with deadline(seconds):
            return _read(path, raw, most_document)
    except Refused as e:
        return path, None, None, None, None, None, e.code, e.reason


def _read(path: str, raw: bytes, most_document: int) -> tuple:
    try:
        kind, found = segments(path, raw, Budget())
        if kind == "text":
            text, codec, bom = decode(raw)
            return path, kind, text, [], codec, bom, None, None
        if len(raw) > most_document:
            raise Refused("document_too_large", "larger than documents may be")
        text, starts = "", []
        pieces, at = [], 0
        for label, t in found:
            if t.strip():
                starts.append({"start": at, "label": label})
                pieces.append(t)
                at += len(t) + 1
        if at > MOST_TEXT:
            raise Refused("text_limit", "too much text")
        text = "\n".join(pieces)
        return path, kind, text, starts, None, None, None, None
    except Refused as e:
        return path, None, None, None, None, None, e.code, e.reason
