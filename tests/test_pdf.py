"""PDF files made here: what is put in must come out."""

import contextlib
import random
import struct
import zlib

import pytest

from corpusloom.functions import pdf as P
from corpusloom.operators import extract
from corpusloom.sources import files, pdf
from corpusloom.tools import read_pages


def stream(head, data, flate=True):
    if flate:
        head, data = head + b"/Filter/FlateDecode", zlib.compress(data)
    return b"<<%s/Length %d>>\nstream\n%s\nendstream" % (head, len(data), data)


def document(pages, resources=b"<</Font<</F 90 0 R>>>>", more=None, info=b"<</Title(A \\(made\\) title)/CreationDate(D:20240305120000)>>"):
    """Objects by number of a file whose pages run the given instructions."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count %d/Kids[%s]/Resources %s>>" % (len(pages), b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages))), resources)}
    objects |= {3: info, 90: b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding>>"}
    for k, page in enumerate(pages):
        objects[10 + 2 * k] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (11 + 2 * k)
        objects[11 + 2 * k] = stream(b"", page)
    return objects | (more or {})


def plain(objects, extra=b"", shift=0):
    """A file with a cross-reference table."""
    out, at = b"%PDF-1.4\n", {}
    for n, body in objects.items():
        at[n] = len(out) + shift
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, place) for n, place in at.items())
    return out + b"trailer\n<</Root 1 0 R/Info 3 0 R/Size 100%s>>\nstartxref\n%d\n%%%%EOF" % (extra, start)


def packed(objects):
    """A file with an object stream and a cross-reference stream under a predictor."""
    out, rows = b"%PDF-1.5\n", {}
    inner = {n: b for n, b in objects.items() if b"stream" not in b}
    heads, body = [], b""
    for k, (n, b) in enumerate(inner.items()):
        heads.append(b"%d %d" % (n, len(body)))
        body += b + b" "
        rows[n] = (2, 95, k)
    head = b" ".join(heads) + b" "
    for n, b in (objects | {95: stream(b"/Type/ObjStm/N %d/First %d" % (len(inner), len(head)), head + body)}).items():
        if n not in inner:
            rows[n] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    rows[96] = (1, len(out), 0)
    table = [struct.pack(">BHB", *rows.get(n, (0, 0, 0))) for n in range(97)]
    above, told = bytes(4), b""
    for k, row in enumerate(table):  # the rules of PNG in turn: none, left, up, mean, nearest
        rule, line = k % 5, b""
        for i in range(4):
            left, up, corner = row[i - 1] if i else 0, above[i], above[i - 1] if i else 0
            p = left + up - corner
            near = min((left, up, corner), key=lambda x: abs(p - x))
            line += bytes([(row[i] - (0, left, up, (left + up) // 2, near)[rule]) & 255])
        told, above = told + bytes([rule]) + line, row
    body = stream(b"/Type/XRef/Size 97/W[1 2 1]/Root 1 0 R/Info 3 0 R/DecodeParms<</Predictor 15/Columns 4>>", told)
    return out + b"96 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (body, len(out))


WORDS = b"BT /F 10 Tf 12 TL 50 700 Td (First line) Tj T* (caf\\351 \\(two\\)) Tj 0 -12 Td [(Wo) 20 (rd) -600 (gap)] TJ ET"


def test_text_of_tables_streams_and_broken_tables():
    made = document([WORDS, b"BT /F 10 Tf 1 0 0 1 50 700 Tm (Page two) Tj ET"])
    want = ["First line\ncafé (two)\nWord gap", "Page two"]
    for data in (plain(made), packed(made), b"junk\n" + plain(made), plain(made, shift=7), plain(made).replace(b"startxref", b"startxxxx"), packed(made)[:-30], plain(made)[:-200]):
        texts, info = P.read(data)
        assert texts == want
    assert P.read(packed(made))[1] == P.read(plain(made))[1] == {"Title": "A (made) title", "CreationDate": "D:20240305120000"}


def test_a_later_revision_goes_before():
    old = plain(document([WORDS]))
    at = len(old) + 1
    start = old[old.rindex(b"startxref") + 10 :].split()[0]
    new = b"\n11 0 obj\n%s\nendobj\n" % stream(b"", b"BT /F 10 Tf (New text) Tj ET")
    tail = b"xref\n11 1\n%010d 00000 n \ntrailer\n<</Root 1 0 R/Info 3 0 R/Size 100/Prev %s>>\nstartxref\n%d\n%%%%EOF" % (at, start, len(old) + len(new))
    assert P.read(old + new + tail)[0] == ["New text"]
    assert P.read((old + new).replace(b"startxref", b"startxxxx"))[0] == ["New text"]  # without tables the file is looked through


def test_fonts():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0041> endbfchar 2 beginbfrange <0010> <0012> <4E00> <0020> <0021> [<D83DDE00> <00660069>] endbfrange"
    fonts = {
        91: b"<</Subtype/Type0/Encoding/Identity-H/DescendantFonts[92 0 R]/ToUnicode 93 0 R>>", 92: b"<</DW 1000/W[3[500] 16 18 1000]>>", 93: stream(b"", cmap),
        94: b"<</Subtype/TrueType/Encoding<</BaseEncoding/MacRomanEncoding/Differences[65/eacute/Scaron/uni4E2D/fi/nothing]>>>>",
        89: b"<</Subtype/Type1/BaseFont/Times-Roman>>",
    }
    page = b"BT /A 10 Tf 0 700 Td <0003001000120020 0021> Tj /B 10 Tf 0 -20 Td (ABCDEz\\216) Tj /C 10 Tf 0 -20 Td (it's \\256ne\\320) Tj ET"
    made = document([page], b"<</Font<</A 91 0 R/B 94 0 R/C 89 0 R>>>>", fonts)
    assert P.read(plain(made))[0] == P.read(packed(made))[0] == ["A一丂😀fi\néŠ中fizé\nit’s fine—"]
    assert [P.glyph(n) for n in ("a", "ccedilla", "u1F600", "a.alt", "g123")] == ["a", "ç", "😀", "a", ""]


def test_forms_states_and_inline_images():
    form = stream(b"/Subtype/Form/Matrix[1 0 0 1 0 -50]/Resources<</Font<</F 90 0 R>>/XObject<</X 98 0 R>>>>", b"BT /F 10 Tf 0 600 Td (inside) Tj ET /X Do")
    page = b"q 2 0 0 2 0 0 cm BT /F 5 Tf 10 350 Td (twice) Tj (as large) ' ET Q BI /W 1 /H 1 ID \x00(Tj\xff EI /X Do BT /F 10 Tf 20 500 Td (a) Tj 3 Ts (b) Tj 0 Ts 200 0 Td (far) Tj ET % (no) Tj"
    made = document([page], b"<</Font<</F 90 0 R>>/XObject<</X 98 0 R>>>>", {98: form})
    assert P.read(plain(made))[0] == ["twice as large\ninside\nab far"]


def test_unreadable_files_and_long_ones():
    for bad in (b"", b"%PDF-1.4", b"plain text", plain(document([WORDS]), b"/Encrypt 3 0 R"), b"%PDF-1.4\n" + b"[" * 100000, b"%PDF-1.4\n1 0 obj" + b"<<" * 100000, b"%PDF-1.7\n" + b"1 0 obj (" * 30000):
        with pytest.raises(P.BROKEN):
            P.read(bad)
    assert P.read(plain(document([b"BT /F 10 Tf (kept) Tj ET BT (no end"])))[0] == ["kept"]
    torn = plain(document([WORDS])).replace(b"startxref", b"startxxxx") + b"\n77 0 obj (no end"
    assert P.read(torn)[0] == ["First line\ncafé (two)\nWord gap"]
    circle = document([WORDS])
    circle[2] = b"<</Type/Pages/Kids[2 0 R 10 0 R 10 0 R]/Resources<</Font<</F 90 0 R>>>>>>"
    assert len(P.read(plain(circle))[0]) == 1
    line = b"(" + b"word " * 20 + b") '"
    long = P.read(plain(document([b"BT /F 10 Tf 12 TL 0 9 Td " + line * 20000 + b" ET"])))[0]
    assert long == ["\n".join(["word " * 20] * 20000)]


def test_damaged_files_are_read_or_refused():
    draw = random.Random(3)
    for data in (plain(document([WORDS, WORDS])), packed(document([WORDS, WORDS]))):
        for _ in range(400):
            torn = bytearray(data)
            for _ in range(draw.randint(1, 8)):
                k = draw.randrange(len(torn))
                torn[k : k + draw.choice([0, 1, 1, 30])] = draw.choice([b"<<", b">", b"(", b"[", b"9", b" 1 0 R", b"/", bytes([draw.randrange(256)])])
            for f in (P.read, P.images):
                with contextlib.suppress(*P.BROKEN):
                    f(bytes(torn))


def picture(data, head):
    return stream(b"/Subtype/Image/BitsPerComponent 8" + head, data)


def test_pictures(spark):
    noise = bytes((i * 7919 >> 3) & 255 for i in range(60 * 50 * 3))
    more = {
        70: picture(noise, b"/Width 60/Height 50/ColorSpace/DeviceRGB"), 71: picture(noise, b"/Width 10/Height 300/ColorSpace/DeviceRGB"),
        72: picture(noise[:3600], b"/Width 60/Height 60/ColorSpace[/Indexed/DeviceRGB 255 <%s>]" % (bytes(range(256)) * 3).hex().encode()),
        73: b"<</Subtype/Image/Width 80/Height 80/Filter/DCTDecode/Length 300>>\nstream\n" + b"\xff\xd8" + b"j" * 298 + b"\nendstream",
        74: picture(noise[:8000], b"/Width 50/Height 40/ColorSpace/DeviceCMYK"),
    }
    made = document([WORDS], b"<</Font<</F 90 0 R>>/XObject<<" + b"".join(b"/I%d %d 0 R" % (n, n) for n in more) + b">>>>", more)
    rows = [(1, plain(made)), (2, None), (3, b"%PDF"), (4, packed(made))]
    got = pdf.pictures(spark.createDataFrame(rows, "id long, content binary"), "id").orderBy("id", "number").collect()
    assert [(r.id, r.number, r.page, r.format, r.width, r.height) for r in got] == [(i, *x) for i in (1, 4) for x in ((1, 1, "png", 60, 50), (2, 1, "png", 60, 60), (3, 1, "jpg", 80, 80))]
    png = got[0].data
    at = png.index(b"IDAT")
    rows = zlib.decompress(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]])
    assert b"".join(rows[k * 181 + 1 : (k + 1) * 181] for k in range(50)) == noise


def test_tables_of_files(spark, tmp_path):
    data = plain(document([WORDS, b"BT /F 10 Tf (see https://b.org/y hy-) Tj 0 -12 Td (phen) Tj ET"]))
    rows = [(1, "https://a.org/x.pdf", None, "application/pdf", data), (2, "https://a.org/y", "<h1>Page</h1>", "text/html", None), (3, "https://a.org/z.pdf", None, None, b"%PDF-1.4 broken")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, content_type string, content binary")
    got = {r.url[-1:]: r for r in read_pages(pages, [r[1] for r in rows]).collect() if r.url != rows[2][1]}
    assert got["f"].title == "A (made) title" and got["f"].published == "2024-03-05" and "hyphen" in got["f"].text and got["f"].outlinks[0].href == "https://b.org/y"
    assert got["y"].title == "Page" and "(2 pages)" in got["f"].description
    clash = pdf.captured(pages.withColumn("text", pages.url).withColumn("info", pages.url)).orderBy("page_id").collect()
    assert [(r.pages, r.text is None) for r in clash] == [(2, False), (None, True), (None, True)]
    assert pdf.captured(pages.limit(0)).count() == 0 and extract.extract_pdf(pdf.captured(pages)).count() == 3
    words = " ".join(f"word{i} of a file" for i in range(40)).encode()
    (tmp_path / "a.pdf").write_bytes(plain(document([b"BT /F 10 Tf 0 700 Td (" + words + b") Tj 0 -20 Td (12) Tj ET"])))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    texts = {r.name: r.text for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert texts == {"a.pdf": words.decode(), "b.pdf": None}
    assert [r.file_name for r in files.ingest(spark, str(tmp_path), "lib")[0].collect()] == ["a.pdf"]
