import io
import zipfile

import pytest
from test_sources import DOCX, ODP, ODS, ODT, PPTX, XLSX, W, pack

from maskwright.sources import extract as X
from maskwright.sources import rewrite as V


def read(name, raw):
    return X.read(name, raw, 10**8)[2]


def masked(name, raw, value, new=None):
    text = read(name, raw)
    at = text.index(value)
    out = V.rewrite(name, raw, [(at, at + len(value), new if new is not None else "*" * len(value))])
    return read(name, out), zipfile.ZipFile(io.BytesIO(out))


@pytest.mark.parametrize(
    ("name", "raw", "value", "want"),
    [
        ("a.docx", DOCX, "ssn 123-45-6789", "***************\ntwo\tx\ntop"),
        ("a.docx", DOCX, "n 123", "ss*****-45-6789\ntwo\tx\ntop"),
        ("a.docx", DOCX, "two\tx", "ssn 123-45-6789\n*****\ntop"),
        ("a.docx", DOCX, "top", "ssn 123-45-6789\ntwo\tx\n***"),
        ("a.xlsx", XLSX, "a@b.org", "*******\n42\nin"),
        ("a.xlsx", XLSX, "42", "a@b.org\n**\nin"),
        ("a.xlsx", XLSX, "in", "a@b.org\n42\n**"),
        ("a.pptx", PPTX, "note", "first\n****\nsecond"),
        ("a.odt", ODT, "e two  thr", "on**********ee\nhead"),
        ("a.odt", ODT, "head", "one two  three\n****"),
        ("a.ods", ODS, "v", "*"),
        ("a.odp", ODP, "aside", "body\n*****"),
    ],
)
def test_values_are_replaced_where_they_stand(name, raw, value, want):
    got, z = masked(name, raw, value)
    assert got == want
    before = zipfile.ZipFile(io.BytesIO(raw))
    assert z.namelist() == before.namelist()
    # what holds no replaced text is as it was
    assert sum(z.read(n) != before.read(n) for n in z.namelist()) <= 2


def test_markup_and_escapes_stay():
    body = f'<?xml version="1.0" encoding="UTF-8"?>\n<!-- note --><w:document {W} xmlns:q="unused" q:Ignorable="a b"><w:body><w:p><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">a &lt;b&gt; &amp; 4111 é </w:t></w:r></w:p></w:body></w:document>'
    got, z = masked("a.docx", pack(**{"word/document.xml": body, "other.bin": b"\0\1"}), "4111", "<&>")
    assert got == "a <b> & <&> é "
    assert z.read("word/document.xml").decode() == body.replace("4111", "&lt;&amp;&gt;") and z.read("other.bin") == b"\0\1"


def test_fields_lose_their_instructions():
    field = lambda *x: "".join(f"<w:r>{i}</w:r>" for i in x)
    body = f'<w:document {W}><w:body><w:p>' + field('<w:fldChar w:fldCharType="begin"/>', "<w:instrText>HYPERLINK mailto:jo@site.org</w:instrText>", '<w:fldChar w:fldCharType="separate"/>', "<w:t>jo@site.org</w:t>", '<w:fldChar w:fldCharType="end"/>') + '</w:p><w:p><w:fldSimple w:instr="AUTHOR jo@site.org"><w:r><w:t>x jo@site.org</w:t></w:r></w:fldSimple></w:p></w:body></w:document>'
    raw = pack(**{"word/document.xml": body})
    text = read("a.docx", raw)
    spans = [(i, i + 11, "[mail]") for i in range(len(text)) if text.startswith("jo@site.org", i)]
    out = V.rewrite("a.docx", raw, spans)
    left = zipfile.ZipFile(io.BytesIO(out)).read("word/document.xml").decode()
    assert read("a.docx", out) == "[mail]\nx [mail]" and "jo@site" not in left and "fld" not in left
    broken = pack(**{"word/document.xml": body.replace('<w:fldChar w:fldCharType="end"/>', "")})
    with pytest.raises(X.Refused):
        masked("a.docx", broken, "jo@site.org")


def test_nothing_unseen_keeps_a_value():
    # a shared string that only the changed cell has is emptied, one that others have stays
    _, z = masked("a.xlsx", XLSX, "a@b.org")
    assert b"a@b.org" not in z.read("xl/sharedStrings.xml")
    ods = pack(**{"content.xml": '<o xmlns:b="b" xmlns:t="t" xmlns:of="of"><b:table b:name="S"><b:table-row><b:table-cell of:value-type="float" of:value="4111" b:formula="=4111"><t:p>4111</t:p></b:table-cell></b:table-row></b:table><v of:string-value="is 4111"/></o>'})
    got, z = masked("a.ods", ods, "4111")
    assert got == "****" and b"4111" not in z.read("content.xml") and b'of:value-type="string"' in z.read("content.xml")
    rels = pack(**{"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>jo@site.org</w:t></w:r></w:p></w:body></w:document>", "word/_rels/document.xml.rels": '<R><R Target="mailto:jo@site.org"/></R>'})
    with pytest.raises(X.Refused, match="holds a replaced value"):
        masked("a.docx", rels, "jo@site.org")


def test_refusals(spark):
    for name, raw, spans in (("a.pdf", b"%PDF-", [(0, 1, "")]), ("a.docx", DOCX, [(0, 3, ""), (2, 5, "")]), ("a.docx", DOCX, [(0, 999, "")]), ("a.docx", DOCX, [(13, 18, "*")])):
        with pytest.raises(X.Refused):
            V.rewrite(name, raw, spans)
    assert V.rewrite("a.docx", DOCX, []) and read("a.docx", V.rewrite("a.docx", DOCX, [])) == read("a.docx", DOCX)
    rows = [("x.docx", bytearray(DOCX), [(4, 15, "***")]), ("y.docx", bytearray(b"PK\x03\x04junk"), []), ("z.txt", bytearray(b"t"), [])]
    df = spark.createDataFrame(rows, "path string, content binary, spans array<struct<start:int,end:int,text:string>>")
    got = {r["path"]: r for r in V.rewritten(df).collect()}
    assert read("x.docx", bytes(got["x.docx"]["output"])).startswith("ssn ***\n") and got["y.docx"]["code"] == "corrupt_archive" and got["z.txt"]["code"] == "not_rewritable"
