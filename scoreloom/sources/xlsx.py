"""A small workbook writer: sheets of titled tables, with charts beside them, in OOXML, without further libraries."""

from __future__ import annotations

import math
import zipfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from xml.sax.saxutils import escape

# Number formats of OOXML and the words of column names that take them.
PERCENT, DECIMAL, WHOLE = 10, 2, 3
_PERCENT_WORDS = ("占比", "rate", "prop", "缺失率")


#: Rows and columns that a chart covers.
CHART_ROWS, CHART_COLUMNS = 14, 8


@dataclass(frozen=True)
class Chart:
    """Columns of one table column over another's categories, and a line of a third on an axis of its own."""

    category: str
    bars: str
    line: str
    title: str


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _style(column: str, value) -> int:
    if any(w in column for w in _PERCENT_WORDS):
        return 1
    return 3 if isinstance(value, int) else 2


def _cell(row: int, at: int, value, style: int) -> str:
    place = f'r="{_letters(at)}{row}"'
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f'<c {place} t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
    return f'<c {place} s="{style}"><v>{value!r}</v></c>'


def _sheet(blocks: Sequence[tuple]) -> tuple[str, list[tuple[Chart, int, Sequence[str], int]]]:
    """The sheet's cells, and for each chart the row of its table's header, its columns and its number of rows."""
    rows, at, charts = [], 1, []
    for title, columns, data, *chart in blocks:
        rows.append(f'<row r="{at}">{_cell(at, 0, title, 4)}</row>')
        at += 1
        head = at
        rows.append(f'<row r="{at}">' + "".join(_cell(at, i, c, 4) for i, c in enumerate(columns)) + "</row>")
        for values in data:
            at += 1
            rows.append(f'<row r="{at}">' + "".join(_cell(at, i, v, _style(c, v) if isinstance(v, (int, float)) else 0) for i, (c, v) in enumerate(zip(columns, values, strict=True))) + "</row>")
        if chart and chart[0] is not None and data:
            charts.append((chart[0], head, columns, len(data)))
            at = max(at, head + CHART_ROWS)
        at += 2
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    drawing = '<drawing r:id="rId1"/>' if charts else ""
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}" xmlns:r="{_REL}">{view}<sheetData>{"".join(rows)}</sheetData>{drawing}</worksheet>', charts


_MAIN, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE, _DRAWING = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/drawingml/2006"


def _chart(chart: Chart, sheet: str, head: int, columns: Sequence[str], n: int) -> str:
    """Bars on the left axis, a line on the right one, both reading the table's cells."""
    quoted = escape("'" + sheet.replace("'", "''") + "'")

    def cells(name: str, first: int, last: int) -> str:
        c = _letters(list(columns).index(name))
        return f"{quoted}!${c}${first}:${c}${last}"

    def series(i: int, name: str) -> str:
        at = cells(name, head, head).split(":")[0]
        return f"<c:ser><c:idx val=\"{i}\"/><c:order val=\"{i}\"/><c:tx><c:strRef><c:f>{at}</c:f></c:strRef></c:tx><c:cat><c:strRef><c:f>{cells(chart.category, head + 1, head + n)}</c:f></c:strRef></c:cat><c:val><c:numRef><c:f>{cells(name, head + 1, head + n)}</c:f></c:numRef></c:val></c:ser>"

    def axes(cat: int, val: int, side: str, hidden: int) -> str:
        crosses = "max" if side == "r" else "autoZero"
        return (
            f'<c:catAx><c:axId val="{cat}"/><c:scaling><c:orientation val="minMax"/></c:scaling><c:delete val="{hidden}"/><c:axPos val="b"/><c:crossAx val="{val}"/></c:catAx>'
            f'<c:valAx><c:axId val="{val}"/><c:scaling><c:orientation val="minMax"/></c:scaling><c:delete val="0"/><c:axPos val="{side}"/><c:numFmt formatCode="0.0%" sourceLinked="0"/><c:crossAx val="{cat}"/><c:crosses val="{crosses}"/></c:valAx>'
        )

    bars = f'<c:barChart><c:barDir val="col"/><c:grouping val="clustered"/>{series(0, chart.bars)}<c:axId val="1"/><c:axId val="2"/></c:barChart>'
    line = f'<c:lineChart><c:grouping val="standard"/>{series(1, chart.line)}<c:marker val="1"/><c:axId val="3"/><c:axId val="4"/></c:lineChart>'
    title = f'<c:title><c:tx><c:rich><a:bodyPr/><a:p><a:r><a:t>{escape(chart.title)}</a:t></a:r></a:p></c:rich></c:tx><c:overlay val="0"/></c:title>'
    return f'<?xml version="1.0" encoding="UTF-8"?><c:chartSpace xmlns:c="{_DRAWING}/chart" xmlns:a="{_DRAWING}/main"><c:chart>{title}<c:autoTitleDeleted val="0"/><c:plotArea><c:layout/>{bars}{line}{axes(1, 2, "l", 0)}{axes(3, 4, "r", 1)}</c:plotArea><c:legend><c:legendPos val="b"/></c:legend><c:plotVisOnly val="1"/></c:chart></c:chartSpace>'


def _anchored(charts: Sequence[tuple[Chart, int, Sequence[str], int]]) -> str:
    out = []
    for i, (chart, head, columns, _) in enumerate(charts, 1):
        left, top = len(columns) + 1, head - 2
        frame = f'<xdr:graphicFrame macro=""><xdr:nvGraphicFramePr><xdr:cNvPr id="{i + 1}" name="{escape(chart.title, {chr(34): "&quot;"})}"/><xdr:cNvGraphicFramePr/></xdr:nvGraphicFramePr><xdr:xfrm><a:off x="0" y="0"/><a:ext cx="0" cy="0"/></xdr:xfrm><a:graphic><a:graphicData uri="{_DRAWING}/chart"><c:chart xmlns:c="{_DRAWING}/chart" r:id="rId{i}"/></a:graphicData></a:graphic></xdr:graphicFrame>'
        place = f"<xdr:from><xdr:col>{left}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{top}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from><xdr:to><xdr:col>{left + CHART_COLUMNS}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{top + CHART_ROWS}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:to>"
        out.append(f"<xdr:twoCellAnchor>{place}{frame}<xdr:clientData/></xdr:twoCellAnchor>")
    return f'<?xml version="1.0" encoding="UTF-8"?><xdr:wsDr xmlns:xdr="{_DRAWING}/spreadsheetDrawing" xmlns:a="{_DRAWING}/main" xmlns:r="{_REL}">{"".join(out)}</xdr:wsDr>'


def _links(targets: Sequence[tuple[str, str]]) -> str:
    listed = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(targets, 1))
    return f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships">{listed}</Relationships>'


def write_workbook(path: str, sheets: Mapping[str, Sequence[tuple]]) -> None:
    """sheets: name -> blocks of (title, column names, rows[, Chart]). The first row is frozen; null and non-finite numbers are blank; a block without rows has no chart."""
    names = list(sheets)
    made = [_sheet(sheets[n]) for n in names]
    sheet_type, chart_type = "application/vnd.openxmlformats-officedocument.spreadsheetml", "application/vnd.openxmlformats-officedocument.drawing"
    parts: dict[str, str] = {}
    kinds = {"/xl/workbook.xml": f"{sheet_type}.sheet.main+xml", "/xl/styles.xml": f"{sheet_type}.styles+xml"}
    number = 0
    for i, (name, (xml, charts)) in enumerate(zip(names, made, strict=True), 1):
        parts[f"xl/worksheets/sheet{i}.xml"] = xml
        kinds[f"/xl/worksheets/sheet{i}.xml"] = f"{sheet_type}.worksheet+xml"
        if charts:
            parts[f"xl/worksheets/_rels/sheet{i}.xml.rels"] = _links([("drawing", f"../drawings/drawing{i}.xml")])
            parts[f"xl/drawings/drawing{i}.xml"] = _anchored(charts)
            parts[f"xl/drawings/_rels/drawing{i}.xml.rels"] = _links([("chart", f"../charts/chart{number + k}.xml") for k in range(1, len(charts) + 1)])
            kinds[f"/xl/drawings/drawing{i}.xml"] = f"{chart_type}+xml"
        for chart, head, columns, n in charts:
            number += 1
            parts[f"xl/charts/chart{number}.xml"] = _chart(chart, name[:31], head, columns, n)
            kinds[f"/xl/charts/chart{number}.xml"] = "application/vnd.openxmlformats-officedocument.drawingml.chart+xml"
    listed = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    parts["xl/workbook.xml"] = f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = _links([*[("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(names) + 1)], ("styles", "styles.xml")])
    parts["_rels/.rels"] = _links([("officeDocument", "xl/workbook.xml")])
    styles = "".join(f'<xf numFmtId="{f}" fontId="{b}" fillId="0" borderId="0" applyNumberFormat="1"/>' for f, b in ((0, 0), (PERCENT, 0), (DECIMAL, 0), (WHOLE, 0), (0, 1)))
    parts["xl/styles.xml"] = f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="5">{styles}</cellXfs></styleSheet>'
    overrides = "".join(f'<Override PartName="{part}" ContentType="{kind}"/>' for part, kind in kinds.items())
    types = f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{overrides}</Types>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", types)
        for part, xml in parts.items():
            z.writestr(part, xml)
