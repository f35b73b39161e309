import zipfile

from kgloom.session import ship
from kgloom.sources import office

W = 'xmlns:w="w"'
P = 'xmlns:a="a" xmlns:p="p"'


def docx(path):
    par = lambda t, s="": f"<w:p><w:pPr>{f'<w:pStyle w:val={chr(34)}{s}{chr(34)}/>' if s else ''}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{par(t)}</w:tc>"
    body = par("intro") + par("Scope", "h2") + par("line one") + par("line two") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}</w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="h2"><w:name w:val="heading 2"/></w:style></w:styles>')


def pptx(path):
    shape = lambda ph, *ps: f"<p:sp>{ph}<p:txBody>{''.join(ps)}</p:txBody></p:sp>"
    par = lambda t, lv=0: f'<a:p><a:pPr lvl="{lv}"/><a:r><a:t>{t}</a:t></a:r></a:p>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ppt/slides/slide1.xml", f"<p:sld {P}>{shape('<p:ph type=%stitle%s/>' % (chr(34), chr(34)), par('Plan'))}{shape('', par('one'), par('two', 1))}</p:sld>")
        z.writestr("ppt/slides/slide2.xml", f"<p:sld {P}>{shape('', par('only'))}</p:sld>")
        z.writestr("ppt/notesSlides/notesSlide1.xml", f"<p:notes {P}>{shape('', par('say it'))}</p:notes>")


def xlsx(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>id</t></si><si><t>name</t></si><si><t>Acme</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c><c r="C2"><v>9</v></c></row><row/><row><c r="B4" t="inlineStr"><is><t>Beta</t></is></c></row></sheetData></worksheet>')


HTML = "<html><head><title>T</title><style>x{}</style></head><body><nav>Home</nav><div class='sidebar'><div>in</div>out</div><p>Lead</p><h2>Part</h2><ul><li>a &amp; b</li></ul><table><tr><td>1</td><td>2</td></tr></table></body></html>"


def test_files(spark, tmp_path):
    ship(spark)
    docx(tmp_path / "d.docx")
    pptx(tmp_path / "s.pptx")
    (tmp_path / "w.html").write_text(HTML)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "skip.bin").write_bytes(b"x")
    got = {r.metadata["filename"]: r for r in office.parse_new(spark, str(tmp_path)).collect()}
    assert set(got) == {"d.docx", "s.pptx", "w.html", "bad.docx"}
    d = got["d.docx"]
    assert [c.markdown for c in d.chunks] == ["intro", "## Scope\n\nline one\nline two", "## Table 1\n\n| a | b |\n| --- | --- |\n| 1 |  |"]
    s = got["s.pptx"]
    assert s.chunks[0].markdown == "# Slide 1: Plan\n\n- one\n  - two\n\n\n_Notes:_ say it" and s.chunks[1].markdown == "# Slide 2\n\n- only"
    w = got["w.html"]
    assert w.metadata["title"] == "T" and w.markdown == "Lead\n\n## Part\n\n- a & b\n\n1 | 2" and [c.level for c in w.chunks] == [0, 2]
    assert got["bad.docx"].markdown is None and got["bad.docx"].warnings
    known = spark.createDataFrame([(got["d.docx"].raw_path,)], "raw_path string")
    assert office.parse_new(spark, str(tmp_path), known).count() == 3


def test_sheet(spark, tmp_path):
    ship(spark)
    xlsx(tmp_path / "r.xlsx")
    assert [(r.row_no, r.fields) for r in office.sheet(spark, str(tmp_path / "r.xlsx")).collect()] == [(1, {"id": "7", "name": "Acme"}), (2, {"id": "", "name": "Beta"})]
