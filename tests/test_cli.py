import json
import zipfile

from maskwright import cli
from maskwright.sources import extract as X


def test_scan(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("ssn 123-45-6789 and card 4111 1111 1111 1111")
    (tmp_path / "b.log").write_text("ssn 123-45-6789")
    assert cli.main(["scan", f"file://{tmp_path}", "--json", "--exclude", ".log", "--category", "financial"], spark) == 0
    out = capsys.readouterr()
    rows = [json.loads(x) for x in out.out.splitlines() if x.startswith("{")]
    assert [r["detector_id"] for r in rows] == ["credit_card"] and "4111 1111" not in out.out
    assert '"skipped": 1' in out.err
    assert cli.main(["scan", f"file://{tmp_path}", "--target", "AND", "--markdown"], spark) == 0
    assert "user\\_target\\_0" in capsys.readouterr().out
    assert cli.main(["scan", f"file://{tmp_path}"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "Tier A: almost certain" and "a.txt:1:26  Credit Card" in lines[1] and not any("4111 1111" in x for x in lines)


def docx(path, *texts, **more):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {w}><w:body>" + "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts) + "</w:body></w:document>")
        for name, data in more.items():
            z.writestr(name.replace("__", "/"), data)


def test_locations_and_labels(spark, tmp_path, capsys):
    """Office findings say where they are, and no label holds a value."""
    docx(tmp_path / "a 123-45-6789.docx", "first", "ssn 123-45-6789")
    assert cli.main(["scan", f"file://{tmp_path}", "--json"], spark) == 0
    (row,) = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert (row["location"], row["can_anonymize"], row["suggested_action"]) == ("paragraph 2", True, "anonymize")
    assert row["path"].endswith("a [redacted].docx")
    assert cli.main(["scan", f"file://{tmp_path}"], spark) == 0
    out = capsys.readouterr().out
    assert "paragraph 2" in out and "123-45-6789" not in out


def test_redact(spark, tmp_path, capsys):
    docx(tmp_path / "a.docx", "ssn 123-45-6789")
    (tmp_path / "b.txt").write_bytes("ssn 123-45-6789 é".encode("cp1252"))
    (tmp_path / "c.txt").write_text("nothing")
    assert cli.main(["redact", f"file://{tmp_path}"], spark) == 0
    said = json.loads(capsys.readouterr().err.strip().splitlines()[-1])
    assert said == {"copies": 2, "refused": 0, "detections_left": 0}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a-auto-redacted-copy.docx", "a.docx", "b-auto-redacted-copy.txt", "b.txt", "c.txt"]
    assert (tmp_path / "b-auto-redacted-copy.txt").read_bytes() == "ssn *******6789 é".encode("cp1252")
    assert X.read("a.docx", (tmp_path / "a-auto-redacted-copy.docx").read_bytes(), 10**6)[2] == "ssn *******6789"
    assert b"123-45" in (tmp_path / "b.txt").read_bytes()


def test_redact_is_all_or_nothing(spark, tmp_path, capsys):
    docx(tmp_path / "a.docx", "ssn 123-45-6789", word___rels__document_xml_rels="x", **{"word__custom.xml": "<a>123-45-6789</a>"})
    (tmp_path / "b.txt").write_text("ssn 123-45-6789")
    assert cli.main(["redact", f"file://{tmp_path}"], spark) == 1
    assert "not_rewritable" in capsys.readouterr().err and sorted(p.name for p in tmp_path.iterdir()) == ["a.docx", "b.txt"]
    assert cli.main(["redact", f"file://{tmp_path}", "--partial"], spark) == 0
    assert "b-auto-redacted-copy.txt" in {p.name for p in tmp_path.iterdir()}
