"""Encodings, files and formats; every file is built here."""

import io
import struct
import zipfile
from email.message import EmailMessage

import pytest

from maskwright.plans.config import Config
from maskwright.plans.engine import Engine
from maskwright.sources import encoding, files, formats


@pytest.mark.parametrize(("data", "text", "codec", "bom"), [
    ("日本語テキスト".encode(), "日本語テキスト", "utf-8", False), ("日本語テキストです".encode("cp932"), "日本語テキストです", "cp932", False), (b"\xef\xbb\xbfabc", "abc", "utf-8", True),
    ("hello there".encode("utf-16-le"), "hello there", "utf-16-le", False), (b"\xff\xfe" + "hé".encode("utf-16-le"), "hé", "utf-16-le", True), ("日本".encode("iso2022_jp"), "日本", "iso2022_jp", False), (b"", "", "utf-8", False),
])
def test_decode(data, text, codec, bom):
    assert encoding.decode(data) == (text, codec, bom)
    assert encoding.encode(text, codec, bom) == data


def test_labels():
    assert encoding.label("Shift_JIS") == ("cp932", False) and encoding.label("UTF-8-BOM") == ("utf-8", True)
    with pytest.raises(ValueError):
        encoding.label("klingon")


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def replaced(doc, old, new):
    at, out = 0, []
    while (i := doc.text.find(old, at)) >= 0:
        out.append((i, i + len(old), new))
        at = i + len(old)
    return out


def parts_of(data):
    z = zipfile.ZipFile(io.BytesIO(data))
    return {i: z.read(i).decode() for i in z.namelist()}


def test_docx():
    xml = "<w:document><w:p><w:r><w:t>Mail a&amp;</w:t></w:r><w:r><w:b/><w:t>b@c.de now</w:t></w:r></w:p><!-- <w:t>no</w:t> --><w:p><w:t>bye</w:t></w:p></w:document>"
    link = '<R><Relationship Id="r1" Target="mailto:x@y.zz" TargetMode="External"/><Relationship Id="r2" Target="media/a.png"/></R>'
    data = office({"word/document.xml": xml, "docProps/core.xml": "<c><dc:creator>Ann</dc:creator></c>", "word/_rels/document.xml.rels": link, "media.bin": "raw"})
    doc = formats.open_document("a.DOCX", data)
    assert doc.text == "Mail a&b@c.de now\nbye\nmailto:x@y.zz\n" and doc.properties == [("creator", "Ann")] and doc.locations[0] == (0, "document")
    parts = parts_of(formats.write_document("a.docx", data, replaced(doc, "a&b@c.de", "<E>") + replaced(doc, "x@y.zz", "M")))
    assert "<w:t>Mail &lt;E&gt;</w:t>" in parts["word/document.xml"] and "<w:t> now</w:t>" in parts["word/document.xml"] and "Ann" not in parts["docProps/core.xml"]
    assert parts["word/_rels/document.xml.rels"] == link.replace("x@y.zz", "M") and parts["media.bin"] == "raw"


HIDDEN = "kept.secret@corp.jp"


@pytest.mark.parametrize(("kind", "part", "xml"), [
    ("docx", "word/document.xml", "<w:document><w:p><w:del w:id='1'><w:r><w:delText>{v}</w:delText></w:r></w:del></w:p></w:document>"),
    ("docx", "word/document.xml", "<w:document><w:p><w:instrText>HYPERLINK \"mailto:{v}\"</w:instrText><w:t>us</w:t></w:p></w:document>"),
    ("docx", "word/header2.xml", "<w:hdr><w:p><w:t>{v}</w:t></w:p></w:hdr>"),
    ("docx", "word/footer1.xml", "<w:ftr><w:p><w:t>{v}</w:t></w:p></w:ftr>"),
    ("docx", "word/footnotes.xml", "<w:f><w:p><w:t>{v}</w:t></w:p></w:f>"),
    ("docx", "word/comments.xml", "<w:c><w:p><w:t>{v}</w:t></w:p></w:c>"),
    ("docx", "word/charts/chart1.xml", "<c:c><a:p><a:t>{v}</a:t></a:p></c:c>"),
    ("docx", "word/diagrams/data1.xml", "<d><a:p><a:t>{v}</a:t></a:p></d>"),
    ("pptx", "ppt/notesSlides/notesSlide1.xml", "<n><a:p><a:t>{v}</a:t></a:p></n>"),
    ("pptx", "ppt/comments/comment1.xml", "<c><p:text>{v}</p:text></c>"),
    ("pptx", "ppt/charts/chart3.xml", "<c><a:p><a:t>{v}</a:t></a:p></c>"),
    ("pptx", "ppt/diagrams/data2.xml", "<d><a:p><a:t>{v}</a:t></a:p></d>"),
    ("xlsx", "xl/comments1.xml", "<c><comment><text><t>{v}</t></text></comment></c>"),
    ("xlsx", "xl/threadedComments/threadedComment1.xml", "<T><threadedComment><text>{v}</text></threadedComment></T>"),
    ("xlsx", "xl/drawings/drawing1.xml", "<x><a:p><a:t>{v}</a:t></a:p></x>"),
    ("xlsx", "xl/charts/chart1.xml", "<x><a:p><a:t>{v}</a:t></a:p></x>"),
    ("xlsx", "xl/sharedStrings.xml", "<sst><si><t>{v}</t></si></sst>"),
])
def test_text_in_every_part_is_found_and_goes(kind, part, xml):
    base = {"docx": {"word/document.xml": "<w:document/>"}, "pptx": {"ppt/slides/slide1.xml": "<s/>"}, "xlsx": {"xl/workbook.xml": "<workbook/>"}}[kind]
    data = office(base | {part: xml.format(v=HIDDEN)})
    doc = formats.open_document(f"a.{kind}", data)
    assert HIDDEN in doc.text
    new = parts_of(formats.write_document(f"a.{kind}", data, replaced(doc, HIDDEN, "<E>")))[part]
    assert HIDDEN not in new and "&lt;E&gt;" in new


@pytest.mark.parametrize(("kind", "part", "xml", "label"), [
    ("docx", "docProps/core.xml", "<c><cp:lastModifiedBy>{v}</cp:lastModifiedBy></c>", "lastModifiedBy"),
    ("docx", "docProps/app.xml", "<c><Company>{v}</Company></c>", "Company"),
    ("docx", "docProps/custom.xml", '<c><property name="Client"><vt:lpwstr>{v}</vt:lpwstr></property></c>', "Client"),
    ("docx", "word/document.xml", '<w:document><w:p><w:ins w:id="1" w:author="{v}"><w:t>x</w:t></w:ins></w:p></w:document>', "author"),
    ("docx", "word/comments.xml", '<c><w:comment w:initials="{v}"><w:p><w:t>x</w:t></w:p></w:comment></c>', "initials"),
    ("docx", "word/people.xml", '<p><w15:person w15:author="{v}"/></p>', "author"),
    ("pptx", "ppt/commentAuthors.xml", '<p><p:cmAuthor id="1" name="{v}"/></p>', "name"),
    ("xlsx", "xl/persons/person.xml", '<p><person displayName="{v}"/></p>', "displayName"),
    ("xlsx", "xl/comments1.xml", "<c><authors><author>{v}</author></authors></c>", "author"),
])
def test_property_modes(spark, kind, part, xml, label):
    base = {"docx": {"word/document.xml": "<w:document/>"}, "pptx": {"ppt/slides/slide1.xml": "<s/>"}, "xlsx": {"xl/workbook.xml": "<workbook/>"}}[kind]
    value = f"by {HIDDEN} (me)"
    data = office(base | {part: xml.format(v=value)})
    doc = formats.open_document(f"a.{kind}", data)
    assert (label, value) in doc.properties and HIDDEN not in doc.text
    write = lambda mode, found=(): parts_of(formats.write_document(f"a.{kind}", data, list(found), properties=mode))[part]
    assert value not in write("clear") and value in write("keep")
    whole = doc.text + "\n" + formats.property_text(doc.properties)
    at = whole.index(HIDDEN)
    assert "by [E] (me)" in write("mask", [(at, at + len(HIDDEN), "[E]")])


def test_masked_properties_of_files(spark, tmp_path):
    data = office({"word/document.xml": "<w:document><w:p><w:t>a@b.co</w:t></w:p></w:document>", "docProps/core.xml": "<c><dc:creator>a@b.co and c@d.co</dc:creator></c>"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(data)
    engine = Engine(Config(allow_domains=()).only("email").changed(properties="mask"))
    files.write_files(files.masked_files(files.list_files(spark, str(tmp_path / "in")), engine), str(tmp_path / "out"))
    parts = parts_of((tmp_path / "out" / "a.masked.docx").read_bytes())
    assert "&lt;EMAIL_1&gt; and &lt;EMAIL_2&gt;" in parts["docProps/core.xml"] and "&lt;EMAIL_1&gt;" in parts["word/document.xml"]


def test_pptx_and_xlsx():
    data = office({f"ppt/slides/slide{i}.xml": f"<p:sld><a:p><a:t>slide {i}</a:t></a:p></p:sld>" for i in (10, 2)})
    doc = formats.open_document("a.pptx", data)
    assert doc.text == "slide 2\nslide 10\n" and [x for _, x in doc.locations] == ["slide 2", "slide 10"]
    data = office({
        "xl/workbook.xml": '<sheets><sheet name="People" r:id="r7"/></sheets>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r7" Target="worksheets/sheet1.xml"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>a@b.co</t><rPh><t>kana</t></rPh></si><si><t>x@y.zz</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<row><c r="A1" t="s"><v>0</v></c><c><v>0312345678</v></c><c r="C1" t="inlineStr"><is><t>in &lt;x&gt;</t></is></c></row><row><c r="A2" t="s"><v>0</v></c></row>',
    })
    doc = formats.open_document("a.xlsx", data)
    assert doc.text == "[シート: People]\na@b.co\tin <x>\na@b.co\nx@y.zz\n" and any("numeric" in w for w in doc.warnings)
    assert [x for _, x in doc.locations] == ["People!A1", "People!C1", "People!A2", "shared strings"]
    new = parts_of(formats.write_document("a.xlsx", data, replaced(doc, "a@b.co", "E")))["xl/sharedStrings.xml"]
    assert new == "<sst><si><t>E</t><rPh><t></t></rPh></si><si><t>x@y.zz</t></si></sst>"


def test_mail():
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Reply-To"] = "Grüße", "Ann <a@b.co>", "c@d.co", "r@s.co"
    m.set_content("Subject: no header\nAttachment: see the annex\ncall 090-1111-2222\n")
    m.add_attachment(b"x", maintype="application", subtype="pdf", filename="ann.pdf")
    doc = formats.open_document("x.eml", m.as_bytes())
    assert doc.text == "Subject: Grüße\nFrom: Ann <a@b.co>\nTo: c@d.co\nReply-To: r@s.co\nSubject: no header\nAttachment: see the annex\ncall 090-1111-2222\nAttachment: ann.pdf\n"
    new = formats.write_document("x.eml", m.as_bytes(), replaced(doc, "090-1111-2222", "<P>") + replaced(doc, "ann.pdf", "f"))
    assert b"a@b.co" not in new and b"r@s.co" not in new and b"ann.pdf" not in new and b"attachment-1.bin" in new
    body = formats.open_document("y.eml", new).text
    assert "Subject: no header\nAttachment: see the annex\ncall <P>\n" in body


def compound(streams):
    """A compound file (version 3) whose streams all fill at least one ordinary sector."""
    size, end, free = 512, 0xFFFFFFFE, 0xFFFFFFFF
    names, chains, body, fat = list(streams), [], b"", []
    for data in streams.values():
        data = data.ljust(4096, b"\0") if len(data) < 4096 else data
        n = -(-len(data) // size)
        chains.append((len(fat), len(data)))
        fat += [len(fat) + i + 1 for i in range(n - 1)] + [end]
        body += data.ljust(n * size, b"\0")
    entries = b""
    for i, (name, kind, child, start, length) in enumerate([("Root Entry", 5, 1, end, 0)] + [(n, 2, free, *c) for n, c in zip(names, chains, strict=True)]):
        raw = name.encode("utf-16-le") + b"\0\0"
        right = i + 1 if 0 < i < len(names) else free
        entries += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", free, right, child) + b"\0" * 36 + struct.pack("<IQ", start, length)
    entries = entries.ljust(-(-len(entries) // size) * size, b"\0")
    first_dir, n_dir = len(fat), len(entries) // size
    fat += [len(fat) + i + 1 for i in range(n_dir - 1)] + [end]
    fat_sector = len(fat)
    fat.append(0xFFFFFFFD)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(size, b"\xff")
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10
    header += struct.pack("<IIIIIIIII", 1, first_dir, 0, 4096, end, 0, end, 0, fat_sector)
    return header.ljust(512, b"\xff") + body + entries + table


def test_outlook_message():
    # the trailing zeros of a stream that fills its sector are no part of what is asserted
    data = compound({"__substg1.0_0037001F": "Grüße".encode("utf-16-le"), "__substg1.0_0C1A001F": "Ann".encode("utf-16-le"), "__substg1.0_1000001F": "call a@b.co".encode("utf-16-le")})
    doc = formats.open_document("x.msg", data)
    assert [x for _, x in doc.locations] == ["Subject", "From", "body"]
    text = doc.text.replace("\0", "")
    assert text == "Subject: Grüße\nFrom: Ann\ncall a@b.co\n"
    assert formats.output_name("x.msg") == "x.masked.msg.txt"


def test_part_size_is_bounded(monkeypatch):
    from maskwright.sources import office as O

    monkeypatch.setattr(O, "PART_LIMIT", 10)
    with pytest.raises(ValueError, match="too large"):
        formats.open_document("a.docx", office({"word/document.xml": "<w:document/>"}))


def test_bad_files():
    for name, data in {"a.docx": b"\xd0\xcf\x11\xe0rest", "b.docx": b"no zip", "c.msg": b"no", "d.pdf": b"%PDF-"}.items():
        with pytest.raises(ValueError):
            formats.open_document(name, data)


def test_names():
    assert formats.output_name("a/report.txt") == "a/report.masked.txt" and formats.output_name("x.msg") == "x.masked.msg.txt" and formats.output_name("README") == "README.masked"


def test_folder(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_bytes("連絡先 a@b.co".encode("cp932"))
    (src / "sub" / "B.LOG").write_text("10.0.0.7")
    (src / "a.masked.txt").write_text("old@out.put")
    (src / "bad.docx").write_bytes(b"no zip")
    (src / "skip.exe").write_bytes(b"x")
    engine = Engine(Config(allow_domains=()).only("email", "ipv4"))
    listed = files.list_files(spark, str(src))
    assert {r["rel"] for r in listed.select("rel").collect()} == {"a.txt", "sub/B.LOG", "bad.docx"}
    done = {r["rel"]: r for r in files.write_files(files.masked_files(listed, engine), str(out)).collect()}
    assert (out / "a.masked.txt").read_bytes().decode("cp932") == "連絡先 <EMAIL_1>" and (out / "sub" / "B.masked.LOG").read_text() == "<IPV4_1>"
    again = files.masked_files(listed, Engine(Config(allow_domains=(), suffix="").only("email", "ipv4")))
    refused = {r["rel"]: r for r in files.write_files(again, str(src)).collect()}
    assert "replace the input" in refused["a.txt"]["error"] and (src / "a.txt").read_bytes().decode("cp932") == "連絡先 a@b.co"
    assert done["bad.docx"]["error"] and done["bad.docx"]["out_path"] is None and done["a.txt"]["n"] == 1


def test_stream(spark, tmp_path):
    from maskwright.streaming import live

    src = tmp_path / "lines"
    src.mkdir()
    (src / "1.txt").write_text("mail a@b.co\nnone\nip 10.0.0.7\n")
    engine = Engine(Config(allow_domains=()).only("email", "ipv4").changed(template="[{label}]"))
    stream = live.mask_stream(engine, spark.readStream.schema("value string").text(str(src)))
    q = stream.select("masked").writeStream.format("memory").queryName("masked_lines").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r[0] for r in spark.table("masked_lines").collect()) == ["ip [IPV4]", "mail [EMAIL]", "none"]


def test_a_table_in_tasks_of_bounded_size(spark, monkeypatch):
    """One row group is dealt to as many tasks as its bytes ask for, and to all cores at least."""
    from maskwright.sources import tables

    path = "/root/testdata/sf0.1/documents.parquet"
    assert tables.read_table(spark, path, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "PART", 1 << 20)
    got = tables.read_table(spark, path, "doc_id")
    sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 16 and sum(sizes) == 10_000 and max(sizes) < 2 * min(sizes)
