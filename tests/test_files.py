import io
import zipfile

from pyspark.sql import functions as F

from inkstone.operators import batch, jobs
from inkstone.sources import containers, files, office, sinks
from inkstone.streaming.files import convert_arriving


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = {
    "[Content_Types].xml": "<x/>",
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>你好</w:t><w:tab/><w:t>国</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>first</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:pStyle w:val="L"/></w:pPr><w:r><w:t>second</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>deep</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
    "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="0" w:type="separator"><w:p><w:r><w:t>no</w:t></w:r></w:p></w:footnote><w:footnote w:id="1"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>',
    "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerRoman"/><w:lvlText w:val="%1.%2)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="L"><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr></w:style></w:styles>',
}
T = 'xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
ODT = {"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f'<o {T}><text:h>Head</text:h><text:p>a<text:s text:c="2"/>b<text:tab/>c</text:p><text:list><text:list-item><text:p>one</text:p></text:list-item></text:list><table:table-row><table:table-cell><text:p>x</text:p></table:table-cell><table:table-cell><text:p>y</text:p></table:table-cell></table:table-row></o>'}
EPUB = {
    "mimetype": "application/epub+zip",
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>',
    "OEBPS/p.opf": '<package><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="a" href="text/../a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type=""/><item id="i" href="i.png" media-type="image/png"/></manifest>'
    '<spine><itemref idref="n"/><itemref idref="b"/><itemref idref="i"/><itemref idref="a"/><itemref idref="zz"/></spine></package>',
    "OEBPS/nav.xhtml": "<html><body><p>nav</p></body></html>",
    "OEBPS/a.xhtml": "<!DOCTYPE html><html><head><title>t</title></head><body><h1>国</h1><p>x&nbsp;y<br/>z</p></body></html>",
    "OEBPS/b.xhtml": "<html><body><p>first   one</p><script>no</script></body></html>",
}


def frame(spark, rows):
    return spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")


def all_files(spark):
    return frame(spark, [
        ("/a/b.docx", zipped(**DOCX)), ("/a/c.odt", zipped(**ODT)), ("/a/d.epub", zipped(**EPUB)), ("/a/e.txt", "﻿中国".encode()),
        ("/a/f.pdf", b"%PDF-1.7 x"), ("/a/g.docx", b"broken"), ("/a/h.exe", b"x"), ("/a/i.txt", "国".encode("utf-16")),
    ])


def test_detection(spark):
    got = {r.path[-6:]: r.format for r in files.detected(all_files(spark)).collect()}
    assert got == {"b.docx": "docx", "/c.odt": "odt", "d.epub": "epub", "/e.txt": "text", "/f.pdf": "pdf", "g.docx": "text", "/h.exe": "text", "/i.txt": "text"}


def test_extraction(spark):
    got = {r.path: r for r in jobs.opened(all_files(spark)).collect()}
    assert got["/a/b.docx"].text == "你好\t国\n1. first\n2. second\n2.i) deep\na\tb\n\nnote\n\n"
    assert got["/a/c.odt"].text == "Head\na  b\tc\n- one\nx\ty\n"
    assert got["/a/d.epub"].text == "first one\n\n国\n\nx y\nz"
    assert got["/a/e.txt"].text == "中国" and got["/a/i.txt"].text == "国"
    assert got["/a/f.pdf"].error and got["/a/h.exe"].error
    bad = containers.epub_texts(frame(spark, [("x.epub", b"no zip"), ("y.epub", zipped(**(EPUB | {"OEBPS/b.xhtml": "<p>"})))])).collect()
    assert all(r.text is None and r.error for r in bad)


def test_batch(spark, tmp_path):
    out = jobs.convert_files(all_files(spark), "s2t", reflowed=True, quotes=True).cache()
    got = {r.path: r for r in out.collect()}
    assert got["/a/e.txt"].text == "中國" and got["/a/e.txt"].out_name == "e_Hant.txt" and got["/a/h.exe"].status == "skipped"
    log = sinks.write_files(out.where("text is not null").withColumnRenamed("out_name", "name"), str(tmp_path)).collect()
    assert all(r.status == "written" for r in log) and (tmp_path / "e_Hant.txt").read_bytes() == "中國".encode()
    assert spark.range(1).select(batch.output_name(F.lit("书.pdf"), F.lit("t2s"), F.lit("t2s"))).first()[0] == "书_Hans.txt"
    labels = {r.path: r.label for r in jobs.detect_scripts(all_files(spark)).collect()}
    assert labels["/a/e.txt"] == "simplified" and labels["/a/f.pdf"] == "skipped"


def test_office(spark):
    rows = files.detected(all_files(spark)).where("format in ('docx', 'epub')")
    got = {r.path: r for r in office.convert_containers(rows, {"国": "國"}).collect()}
    with zipfile.ZipFile(io.BytesIO(got["/a/d.epub"].content)) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and "國" in z.read("OEBPS/a.xhtml").decode()
    assert containers.docx_text(bytes(got["/a/b.docx"].content)).startswith("你好\t國")


def test_batch_of_containers(spark, tmp_path):
    sheet = zipped(**{"xl/sharedStrings.xml": "<sst><t>中国</t></sst>", "xl/styles.xml": "<a>国</a>"})
    rows = [("/a/t.xlsx", sheet), ("/a/w.docx", b"PK no zip"), ("/a/v.pptx", zipped(x="国")), ("/a/e.txt", "中国".encode())]
    out = jobs.convert_files(all_files(spark).select("path", "content").where("path like '%.docx' or path like '%.epub'").union(frame(spark, rows).select("path", "content")), "s2t").cache()
    got = {r.path: r for r in out.collect()}
    with zipfile.ZipFile(io.BytesIO(got["/a/t.xlsx"].content)) as z:
        assert z.read("xl/sharedStrings.xml").decode() == "<sst><t>中國</t></sst>" and z.read("xl/styles.xml").decode() == "<a>国</a>"
    assert got["/a/t.xlsx"].status == "converted" and got["/a/t.xlsx"].text is None and got["/a/t.xlsx"].out_name == "t_Hant.xlsx"
    assert all(got[p].status == "skipped" and got[p].content is None and got[p].message for p in ("/a/w.docx", "/a/v.pptx"))
    assert containers.docx_text(bytes(got["/a/b.docx"].content)).startswith("你好\t國") and got["/a/d.epub"].content[:2] == b"PK"
    assert bytes(got["/a/e.txt"].content).decode() == got["/a/e.txt"].text == "中國"
    opened = {r.path: r for r in jobs.opened(frame(spark, rows)).collect()}
    assert opened["/a/t.xlsx"].text is None and opened["/a/t.xlsx"].error and opened["/a/w.docx"].error
    sinks.write_files(out.where("content is not null").withColumnRenamed("out_name", "name"), str(tmp_path), data_col="content").collect()
    assert zipfile.is_zipfile(tmp_path / "b_Hant.docx")
    two = office.convert_containers(spark.createDataFrame([("p", sheet, "xlsx")], "path string, content binary, format string"), [{"国": "國"}, {"中國": "X"}]).first()
    with zipfile.ZipFile(io.BytesIO(two.content)) as z:
        assert "<t>X</t>" in z.read("xl/sharedStrings.xml").decode()


def test_pages_of_a_plugged_extractor(spark):
    got = files.pdf_pages(frame(spark, [("a", b"x|y"), ("b", None)]), lambda c: bytes(c).decode().split("|")).collect()
    assert sorted((r.path, r.page_no, r.text) for r in got if r.error is None) == [("a", 1, "x"), ("a", 2, "y")]
    assert [r.path for r in got if r.error] == ["b"]


def test_bullets_and_numbers():
    assert [containers.bullet(a, b) for a, b in (("", "Symbol"), ("", "Wingdings 2"), ("o", "Courier New"), ("•", ""), ("zz", "Arial"), ("", ""))] == ["•", "✓", "○", "•", "•", "•"]
    assert [containers.format_counter(n, f) for n, f in ((27, "lowerLetter"), (1994, "upperRoman"), (7, "decimalZero"), (0, "x"))] == ["aa", "MCMXCIV", "07", "1"]


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "STCharacters.txt").write_text("国\t國 囯\n# no\n这\t這\n", encoding="utf-8")
    d = files.dictionary_texts(spark, str(tmp_path))
    assert sorted(map(tuple, d.collect())) == [("STCharacters", "国", "國"), ("STCharacters", "这", "這")]
    sinks.write_dictionary(d, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_settings(tmp_path):
    (tmp_path / "d.json").write_text('{"a": {"b": 1, "c": 2}}')
    (tmp_path / "u.json").write_text('{"a": {"c": 3}}')
    assert files.settings(str(tmp_path / "d.json"), str(tmp_path / "u.json")) == {"a": {"b": 1, "c": 3}}
    assert files.settings(str(tmp_path / "d.json"), str(tmp_path / "none")) == {"a": {"b": 1, "c": 2}}


def test_uri(spark):
    rows = spark.createDataFrame([("file:///a/b%20c+d",), ("/x",)], "u string").select(files.path_of_uri(F.col("u"))).collect()
    assert [r[0] for r in rows] == ["/a/b c+d", "/x"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("中国说", encoding="utf-8")
    q = convert_arriving(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["中國說"]
