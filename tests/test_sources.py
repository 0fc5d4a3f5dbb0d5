import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.sources import extract as X
from maskwright.sources import files as S
from maskwright.sources import rules as R


def pack(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


W = 'xmlns:w="w"'
DOCX = pack(**{"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>ssn </w:t></w:r><w:r><w:t>123-45-6789</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t><w:tab/><w:t>x</w:t></w:r></w:p></w:body></w:document>", "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>top</w:t></w:r></w:p></w:hdr>"})
XLSX = pack(**{"xl/sharedStrings.xml": "<sst><si><t>a@b.org</t></si></sst>", "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="People" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="B7" t="s"><v>0</v></c><c r="C7"><v>42</v></c><c r="D7" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'})
PPTX = pack(**{"ppt/slides/slide2.xml": '<p xmlns:a="a"><a:p><a:t>second</a:t></a:p></p>', "ppt/slides/slide1.xml": '<p xmlns:a="a"><a:p><a:t>first</a:t></a:p></p>', "ppt/notesSlides/notesSlide1.xml": '<p xmlns:a="a"><a:p><a:t>note</a:t></a:p></p>'})
ODT = pack(**{"content.xml": '<o xmlns:t="t"><t:p>one <t:span>two</t:span><t:s t:c="2"/>three</t:p><t:h>head</t:h></o>'})
ODS = pack(**{"content.xml": '<o xmlns:b="b" xmlns:t="t"><b:table b:name="S"><b:table-row b:number-rows-repeated="2"><b:table-cell/></b:table-row><b:table-row><b:table-cell b:number-columns-repeated="27"/><b:table-cell><t:p>v</t:p></b:table-cell></b:table-row></b:table></o>'})
ODP = pack(**{"content.xml": '<o xmlns:d="d" xmlns:t="t" xmlns:n="n"><d:page><t:p>body</t:p><n:notes><t:p>aside</t:p></n:notes></d:page></o>'})
EML = b"From: a@b.org\r\nSubject: hi\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nbody text\r\n"


def labels(name, raw):
    path, kind, text, segments, *_ = X.read(name, raw, 10**8)
    ends = [s["start"] for s in segments[1:]] + [len(text) + 1]
    return kind, [(s["label"], text[s["start"] : e - 1]) for s, e in zip(segments, ends)]


def test_documents():
    assert labels("a.docx", DOCX) == ("docx", [("paragraph 1", "ssn 123-45-6789"), ("paragraph 2", "two\tx"), ("header1 paragraph 1", "top")])
    assert labels("a.xlsx", XLSX) == ("xlsx", [("People!B7", "a@b.org"), ("People!C7", "42"), ("People!D7", "in")])
    assert labels("a.pptx", PPTX) == ("pptx", [("slide 1", "first"), ("slide 1 notes", "note"), ("slide 2", "second")])
    assert labels("a.odt", ODT) == ("odt", [("paragraph 1", "one two  three"), ("paragraph 2", "head")])
    assert labels("a.ods", ODS) == ("ods", [("S!AB3", "v")])
    assert labels("a.odp", ODP) == ("odp", [("slide 1", "body"), ("slide 1 notes", "aside")])
    assert labels("a.eml", EML)[1][0] == ("headers", "From: a@b.org\nSubject: hi")
    inner = pack(**{"in.txt": "deep", "b.docx": DOCX})
    kind, got = labels("a.zip", pack(**{"x.zip": inner, "t.txt": "flat"}))
    assert kind == "zip" and ("x.zip · in.txt", "deep") in got and ("x.zip · b.docx · paragraph 2", "two\tx") in got and ("t.txt", "flat") in got
    assert X.column_letters(0) == "A" and X.column_letters(25) == "Z" and X.column_letters(702) == "AAA"


@pytest.mark.parametrize(
    ("name", "raw", "code"),
    [
        ("a.zip", pack(**{"..__x": "1"}), "unsafe_archive"),
        ("a.zip", pack(**{"x": "0" * 9_000_000}), "archive_limit"),
        ("a.docx", pack(**{"word/document.xml": "<!DOCTYPE a><a/>"}), "unsafe_xml"),
        ("a.docx", pack(**{"word/document.xml": "<a"}), "corrupt_document"),
        ("a.zip", b"PK\x03\x04junk", "corrupt_archive"),
        ("a.png", b"\x89PNG\r\n\x1a\n\0", "binary_file"),
        ("a.txt", b"\xff\xfe\x00", "unsupported_encoding"),
        ("a.txt", bytes(range(128, 160)) * 9, "unsupported_encoding"),
    ],
)
def test_refusals(name, raw, code):
    assert X.read(name, raw, 10**8)[6] == code


def test_decoding():
    for codec, bom in (("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-32-be", b"\0\0\xfe\xff")):
        assert X.decode(bom + "añ😀".encode(codec)) == ("añ😀", codec, bom)
    assert X.decode("añ".encode()) == ("añ", "utf-8", b"") and X.decode("café".encode("cp1252") * 9)[1] == "cp1252"
    r = random.Random(1)
    assert X.read("a.bin", bytes(r.randrange(256) for _ in range(500)), 1)[6] in ("binary_file", "unsupported_encoding")


def test_files(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "sub").mkdir()
    for name, data in {"a.txt": b"hello", "sub/b.md": b"x", "sub/c.log": b"y", "node_modules/d.txt": b"z", "p.docx": DOCX, "i.png": b"\x89PNG\r\n\x1a\n\0"}.items():
        (tmp_path / name).write_bytes(data)
    root = f"file://{tmp_path}"
    docs, skipped = S.load(spark, [root], rules=["*.log"], exclude=[".md"])
    assert {r["path"].rpartition("/")[2]: r["text"] for r in docs.collect()} == {"a.txt": "hello", "p.docx": "ssn 123-45-6789\ntwo\tx\ntop"}
    assert {r["path"].rpartition("/")[2]: r["code"] for r in skipped.collect()} == {"b.md": "excluded_extension", "c.log": "ignore_rule", "d.txt": "ignored_directory", "i.png": "binary_file"}
    at = docs.where("format = 'docx'").select(T.location(F.col("segments"), F.lit(17)), T.location(F.col("segments"), F.lit(0))).first()
    assert list(at) == ["paragraph 2", "paragraph 1"]
    before = S.fingerprints(spark, [root]).collect()
    frame = spark.createDataFrame(before)
    (tmp_path / "a.txt").write_bytes(b"other")
    assert [r["path"].rpartition("/")[2] for r in S.changed(frame, S.fingerprints(spark, [root])).collect()] == ["a.txt"]


@pytest.mark.parametrize(
    ("rule", "fits", "not_fits"),
    [
        ("*.log", ["a.log", "x/y.log", "d.log/z"], ["a.logs", "log"]),
        ("/top", ["top", "top/x"], ["a/top"]),
        ("a/b", ["a/b", "a/b/c"], ["x/a/b"]),
        ("dir/", ["dir/x", "y/dir/x"], ["dir"]),
        ("a/**", ["a/x", "a/x/y"], ["a"]),
        ("/**/z", ["z", "q/z", "q/r/z"], ["q/zz"]),
        ("f?.c", ["f1.c"], ["f.c", "f12.c"]),
        ("a.b", ["a.b"], ["axb"]),
    ],
)
def test_ignore_rules(rule, fits, not_fits):
    import re

    p = re.compile(R.rule_pattern(rule))
    assert all(p.search(x) for x in fits) and not any(p.search(x) for x in not_fits)


def test_rule_limits():
    assert R.parse_rules("# c\n\na\n!b\n") == ["a", "!b"]
    assert R.parse_rules("\n".join(f"r{i}" for i in range(2000))) == [] and R.parse_rules("x" * 2000) == []


def test_stream(spark, tmp_path):
    from maskwright.streaming import events as V

    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("p", "ssn 123-45-6789"), ("q", "nothing")], "path string, text string").write.parquet(str(src))
    V.findings_sink(spark, str(src), str(out), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(out)).collect()
    assert [(r["path"], r["detector_id"], r["tier"]) for r in got] == [("p", "us_ssn", "A")]


def test_windows_overlap_by_the_longest_match(spark):
    import pytest

    from maskwright.operators import detectors as D
    from maskwright.sources import rules

    jwt = next(d for d in D.BUILT_IN if d.id == "jwt")
    token = "ey" + "a" * 1500 + "." + "b" * 1500 + "." + "c" * 1500
    docs = spark.createDataFrame([("p", "x " * 11_000 + token + " x" * 20_000)], "path string, text string")
    spans = lambda df: df.select("start", "end", "value", "confidence").collect()
    whole = spans(D.detect(docs, [jwt]))
    assert len(whole) == 1 and spans(rules.chunked_detections(docs, [jwt], core=23_000)) == whole
    with pytest.raises(ValueError, match="24682"):
        rules.chunked_detections(docs, [jwt], core=23_000, overlap=700)


def test_links_are_not_followed(spark, tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "real" / "a.txt").write_text("a")
    (tmp_path / "file.txt").symlink_to(tmp_path / "real" / "a.txt")
    (tmp_path / "folder").symlink_to(tmp_path / "real")
    listed = {r["path"].split(str(tmp_path))[1]: r["issue"] and r["issue"]["code"] for r in S.discover(spark, [f"file://{tmp_path}"]).collect()}
    assert listed.pop("/real/a.txt") is None and listed and set(listed.values()) == {"symlink"}


def test_deadline(monkeypatch):
    import time

    monkeypatch.setattr(X, "segments", lambda *a: time.sleep(5))
    began = time.time()
    assert X.read("a.docx", DOCX, 10**6, 0.2)[6] == "extraction_timeout" and time.time() - began < 2


def test_table_functions(spark):
    from maskwright.sources import udtf

    udtf.register(spark)
    rows = [("a.docx", bytearray(DOCX)), ("t.txt", bytearray(b"plain")), ("i.png", bytearray(b"\x89PNG\r\n\x1a\n\0")), (None, None)]
    spark.createDataFrame(rows, "path string, content binary").createOrReplaceTempView("given_files")
    got = spark.sql("SELECT path, s.format, s.label, s.start, s.text FROM given_files, LATERAL document_segments(path, content) s").collect()
    assert sorted(map(tuple, got), key=str) == [("a.docx", "docx", "header1 paragraph 1", 22, "top"), ("a.docx", "docx", "paragraph 1", 0, "ssn 123-45-6789"), ("a.docx", "docx", "paragraph 2", 16, "two\tx"), ("t.txt", "text", None, 0, "plain")]
    assert [tuple(r) for r in spark.sql("SELECT path, s.code FROM given_files, LATERAL file_issue(path, content) s").collect()] == [("i.png", "binary_file")]
