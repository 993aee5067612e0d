"""Minimal office files, written as the zipped XML that the scans read."""

import zipfile

_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = f'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_REL}"'
_P = (f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="{_REL}" '
      'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"')


def _write(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)


def _rels(*targets):
    rows = "".join(f'<Relationship Id="r{i}" Type="{_REL}/{kind}" Target="{target}"/>'
                   for i, (kind, target) in enumerate(targets, 1))
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def par(text, style=None):
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"


def word_table(rows):
    return "<w:tbl>" + "".join(
        "<w:tr>" + "".join(f"<w:tc>{par(cell)}</w:tc>" for cell in row) + "</w:tr>" for row in rows) + "</w:tbl>"


def write_docx(path, body):
    _write(path, {
        "word/styles.xml": f'<w:styles {_W}><w:style w:styleId="T1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>"})


def write_xlsx(path, sheets):
    """sheets: name -> list of rows; text cells go to the shared strings, None leaves a gap."""
    strings, parts = [], {}
    for number, rows in enumerate(sheets.values(), 1):
        xml = ""
        for r, row in enumerate(rows, 1):
            xml += f'<row r="{r}">'
            for c, value in enumerate(row):
                ref = f"{chr(65 + c)}{r}"
                if isinstance(value, str):
                    strings.append(value)
                    xml += f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
                elif isinstance(value, tuple):
                    xml += f'<c r="{ref}" s="1"><v>{value[0]}</v></c>'
                elif value is not None:
                    xml += f'<c r="{ref}"><v>{value}</v></c>'
            xml += "</row>"
        parts[f"xl/worksheets/sheet{number}.xml"] = f"<worksheet {_S}><sheetData>{xml}</sheetData></worksheet>"
    sheet_list = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
    _write(path, parts | {
        "xl/workbook.xml": f"<workbook {_S}><sheets>{sheet_list}</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": _rels(*[("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)]),
        "xl/styles.xml": f'<styleSheet {_S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst {_S}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>"})


def _shape(text, kind=None):
    place = f'<p:ph type="{kind}"/>' if kind else ""
    lines = "".join(f"<a:p><a:r><a:t>{line}</a:t></a:r></a:p>" for line in text.split("\n"))
    return f"<p:sp><p:nvSpPr><p:nvPr>{place}</p:nvPr></p:nvSpPr><p:txBody>{lines}</p:txBody></p:sp>"


def write_pptx(path, slides):
    """slides: list of (list of shape texts, notes or None)."""
    parts = {}
    for i, (shapes, notes) in enumerate(slides, 1):
        tree = "".join(_shape(s) for s in shapes)
        parts[f"ppt/slides/slide{i}.xml"] = f"<p:sld {_P}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>"
        if notes:
            parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = _rels(("notesSlide", f"../notesSlides/notes{i}.xml"))
            tree = _shape("3", "sldNum") + _shape(notes, "body")
            parts[f"ppt/notesSlides/notes{i}.xml"] = f"<p:notes {_P}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:notes>"
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="r{i}"/>' for i in range(1, len(slides) + 1))
    _write(path, parts | {
        "ppt/presentation.xml": f"<p:presentation {_P}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": _rels(*[("slide", f"slides/slide{i}.xml") for i in range(1, len(slides) + 1)])})
