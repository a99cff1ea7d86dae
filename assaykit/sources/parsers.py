"""Documents to blocks, in plain Python: one parser for each file type.

A block is (kind, locator, text, row). Tables give a block a row with the header as context;
tables that can't be read without guessing stay whole, as ``*_unresolved``.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

Block = tuple[str, str, str, dict[str, str] | None]
HIDDEN = frozenset(["script", "style", "noscript", "svg", "template"])
TEXTUAL = frozenset(["title", "h1", "h2", "h3", "h4", "p", "li", "figcaption"])
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
CHUNK = 10_000
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def squeeze(text: object) -> str:
    return re.sub(r"\s+", " ", str(text or "")).strip()


def as_row(names: list[str], values: list) -> tuple[str, dict[str, str]]:
    row = {n: v if v is None else str(v) for n, v in zip(names, values)}
    return json.dumps(row, ensure_ascii=False), row


def unique(names: list[str]) -> bool:
    return bool(names) and all(names) and len(set(names)) == len(names)


def delimited(text: str, delimiter: str) -> list[Block]:
    """Header and rows; a missing or repeated header, or a ragged row, is an error."""
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))
    if not rows or not unique(rows[0]):
        raise ValueError("missing or repeated header")
    out: list[Block] = []
    for number, values in enumerate(rows[1:], 2):
        if not values:
            continue
        if len(values) != len(rows[0]):
            raise ValueError(f"ragged row {number}")
        body, row = as_row(rows[0], values)
        kind = "digitized_curve" if row.get("estimated", "").lower() == "true" else "raw_table"
        out.append((kind, f"row:{number}", body, row))
    return out


def cell_column(reference: str) -> int:
    total = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        total = total * 26 + ord(letter) - 64
    return total - 1


def workbook(data: bytes) -> list[Block]:
    """Rows of every sheet; formulas stay text and are never evaluated."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{SHEET}t")) for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))]
        titles = [s.get("name") for s in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{SHEET}sheet")]
        for k, title in enumerate(titles, 1):
            header: list[str] = []
            for line in ElementTree.fromstring(archive.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{SHEET}row"):
                values: dict[int, str] = {}
                for cell in line.iter(f"{SHEET}c"):
                    formula, value = cell.find(f"{SHEET}f"), cell.find(f"{SHEET}v")
                    if formula is not None:
                        shown = "=" + (formula.text or "")
                    elif cell.get("t") == "s" and value is not None:
                        shown = shared[int(value.text)]
                    elif cell.get("t") == "inlineStr":
                        shown = "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
                    else:
                        shown = value.text if value is not None else None
                    values[cell_column(cell.get("r"))] = shown
                if not header:
                    header = [values.get(i) or f"unnamed_{i}" for i in range(max(values, default=-1) + 1)]
                    if not unique(header):
                        raise ValueError(f"repeated column names in {title}")
                    continue
                body, row = as_row(header, [values.get(i) for i in range(len(header))])
                out.append(("raw_table", f"sheet:{title};row:{line.get('r')}", body, row))
    return out


class Article(HTMLParser):
    """Texts, tables with spans, links and metadata of an article, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.found: list[tuple[str, object]] = []
        self.links: list[str] = []
        self.hidden = 0
        self.capture: tuple[str, list[str]] | None = None
        self.grid: list[list[str]] | None = None
        self.row: list[str] = []
        self.cell: list[str] | None = None
        self.spans: tuple[int, int] = (1, 1)
        self.below: dict[int, tuple[int, str]] = {}

    def fill_below(self) -> None:
        """Cells that reach down from rows above."""
        while len(self.row) in self.below:
            left, value = self.below.pop(len(self.row))
            if left > 1:
                self.below[len(self.row)] = (left - 1, value)
            self.row.append(value)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = {k: v or "" for k, v in attrs}
        if tag in HIDDEN:
            self.hidden += 1
        elif self.hidden:
            return
        elif tag == "meta" and named.get("content"):
            key = (named.get("name") or named.get("property") or "").lower()
            if key:
                self.meta[key] = named["content"].strip()
        elif tag == "a" and named.get("href"):
            self.links.append(named["href"])
        elif tag in TEXTUAL:
            self.end_text()
            self.capture = (tag, [])
        elif tag == "table":
            self.grid, self.below = [], {}
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.fill_below()
            self.cell = []
            size = lambda k: int(named[k]) if re.fullmatch(r"[1-9][0-9]{0,2}", named.get(k, "")) else 1
            self.spans = (size("rowspan"), size("colspan"))

    def end_text(self) -> None:
        if self.capture:
            text = squeeze("".join(self.capture[1]))
            if text:
                self.found.append((self.capture[0], text))
        self.capture = None

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag in TEXTUAL:
            self.end_text()
        elif tag in ("td", "th") and self.cell is not None:
            value = squeeze("".join(self.cell))
            for _ in range(self.spans[1]):
                if self.spans[0] > 1:
                    self.below[len(self.row)] = (self.spans[0] - 1, value)
                self.row.append(value)
            self.cell = None
        elif tag == "tr" and self.row and self.grid is not None:
            self.fill_below()
            self.grid.append(self.row)
            self.row = []
        elif tag == "table" and self.grid:
            self.found.append(("table", self.grid))
            self.grid = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            if self.capture:
                self.capture[1].append(data)
            if self.cell is not None:
                self.cell.append(data)

    def close(self) -> None:
        super().close()
        self.end_text()


def parsed(text: str) -> Article:
    article = Article()
    article.feed(text)
    article.close()
    return article


def table_blocks(grid: list[list[str]], place: str, kind: str) -> list[Block]:
    if len(grid) < 2:
        return []
    header = [squeeze(h) for h in grid[0]]
    if not unique(header):
        return [(f"{kind}_unresolved", place, json.dumps(grid, ensure_ascii=False), None)]
    out: list[Block] = []
    for number, values in enumerate(grid[1:], 1):
        if len(values) != len(header):
            out.append((f"{kind}_unresolved", f"{place};row:{number}", json.dumps(values, ensure_ascii=False), None))
        else:
            body, row = as_row(header, values)
            out.append((kind, f"{place};row:{number}", body, row))
    return out


def html(text: str) -> list[Block]:
    out: list[Block] = []
    for number, (kind, content) in enumerate(parsed(text).found, 1):
        if kind == "table":
            out += table_blocks(content, f"html:table:{number}", "html_table")
        else:
            out.append(("html_text", f"html:{kind}:{number}", content, None))
    return out


def layout(text: str) -> list[Block]:
    """A JSON list of layout items; HTML tables inside become rows."""
    items = json.loads(text)
    if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
        raise ValueError("not a list of layout items")
    out: list[Block] = []
    for number, item in enumerate(items):
        kind, place = item.get("type", "text"), f"page:{int(item.get('page_idx', 0)) + 1};item:{number}"
        body = str(item.get("table_body", ""))
        tables = [c for k, c in parsed(body).found if k == "table"] if kind == "table" and "<table" in body.lower() else None
        if tables is not None:
            for k, grid in enumerate(tables, 1):
                out += table_blocks(grid, f"{place};table:{k}", "layout_table")
        else:
            parts = [str(item.get(k, "")) for k in ("text", "table_body", "table_caption", "image_caption", "table_footnote")]
            out.append((kind, place, "\n".join(parts), None))
    return out


RULE = re.compile(r"[\s|:\-]+")


def markdown(text: str) -> list[Block]:
    """Pipe tables to rows; other lines in chunks that end at a blank line, a table or 10,000
    characters."""
    lines, out, at = text.splitlines(), [], 0
    opens = lambda k: k + 1 < len(lines) and "|" in lines[k] and bool(RULE.fullmatch(lines[k + 1])) and bool(lines[k + 1].strip())
    cells = lambda line: [c.strip() for c in line.strip().strip("|").split("|")]
    while at < len(lines):
        if opens(at):
            header = cells(lines[at])
            at += 2
            while at < len(lines) and "|" in lines[at]:
                values = cells(lines[at])
                if len(values) != len(header) or not unique(header):
                    raise ValueError(f"malformed table at line {at + 1}")
                body, row = as_row(header, values)
                out.append(("table", f"line:{at + 1}", body, row))
                at += 1
            continue
        begin, size = at, 0
        while at < len(lines) and size <= CHUNK and (at == begin or (lines[at].strip() and not opens(at))):
            size += len(lines[at])
            at += 1
        chunk = "\n".join(lines[begin:at])
        if chunk.strip():
            out.append(("text", f"lines:{begin + 1}-{at}", chunk, None))
    return out


RIS_LINE = re.compile(r"^([A-Z0-9]{2})\s{2}-\s?(.*)$")
# RIS tags by field.
RIS_FIELDS = {"DO": "doi", "TI": "title", "T1": "title", "AB": "abstract", "N2": "abstract", "JO": "journal", "JF": "journal", "T2": "journal", "TY": "document_type", "PY": "date", "Y1": "date", "UR": "url"}
RIS_LISTS = {"AU": "authors", "A1": "authors", "KW": "keywords"}


def ris(text: str) -> list[dict]:
    """Records of an RIS file; lines without a tag continue the field before."""
    records: list[dict] = []
    now: dict = {}
    field = None
    for line in text.splitlines():
        m = RIS_LINE.match(line)
        if not m:
            if line.strip() and isinstance(now.get(field), str):
                now[field] += "\n" + line.strip()
            continue
        tag, value = m.groups()
        if tag in ("TY", "ER") and now:
            if tag == "ER" or "document_type" in now or len(now) > 0:
                records.append(now)
            now, field = {}, None
        if tag in RIS_FIELDS:
            field = RIS_FIELDS[tag]
            now[field] = value
        elif tag in RIS_LISTS:
            field = RIS_LISTS[tag]
            now.setdefault(field, []).append(value)
        else:
            field = None
    return [r for r in [*records, now] if r]


def ris_blocks(text: str) -> list[Block]:
    return [("bibliographic", f"record:{k}", json.dumps(r, ensure_ascii=False), {n: v if isinstance(v, str) else "; ".join(v) for n, v in r.items()}) for k, r in enumerate(ris(text), 1)]


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


OUTSIDE_XML = frozenset(["abstract", "bibliography", "references", "ref-list", "figure", "fig", "bib-reference", "tail", "coredata", "front"])


def full_text_xml(text: str) -> list[Block]:
    """Paragraphs under their section titles, and tables with spans, of a publisher's XML.
    Abstract, references and figures are left out; entity declarations are refused."""
    if re.search(r"<!ENTITY", text, re.IGNORECASE):
        raise ValueError("entity declarations are refused")
    out: list[Block] = []

    def words(node: ElementTree.Element) -> str:
        return squeeze("".join(node.itertext()))

    def grid(node: ElementTree.Element) -> list[list[str]]:
        rows: list[list[str]] = []
        below: dict[int, tuple[int, str]] = {}
        for line in node.iter():
            if local(line.tag) != "row" and local(line.tag) != "tr":
                continue
            row: list[str] = []
            for cell in line:
                while len(row) in below:
                    left, value = below.pop(len(row))
                    if left > 1:
                        below[len(row)] = (left - 1, value)
                    row.append(value)
                names = re.findall(r"\d+", f"{cell.get('namest', '')} {cell.get('nameend', '')}")
                wide = int(names[1]) - int(names[0]) + 1 if len(names) == 2 else int(cell.get("colspan", 1))
                deep = int(cell.get("morerows", int(cell.get("rowspan", 1)) - 1))
                for _ in range(max(1, wide)):
                    if deep > 0:
                        below[len(row)] = (deep, words(cell))
                    row.append(words(cell))
            while len(row) in below:
                left, value = below.pop(len(row))
                if left > 1:
                    below[len(row)] = (left - 1, value)
                row.append(value)
            rows.append(row)
        return rows

    def visit(node: ElementTree.Element, path: str, trail: list[str]) -> None:
        counts: dict[str, int] = {}
        for child in node:
            name = local(child.tag)
            counts[name] = counts.get(name, 0) + 1
            place = f"{path}/{name}[{counts[name]}]"
            if name in OUTSIDE_XML:
                continue
            if name in ("para", "p", "simple-para"):
                body = words(child)
                if body:
                    out.append(("xml_text", f"{place}|{' > '.join(trail)}", body, None))
            elif name == "table":
                out.extend(table_blocks(grid(child), place, "xml_table"))
            else:
                titles = [words(c) for c in child if local(c.tag) in ("section-title", "title")]
                visit(child, place, trail + titles[:1])

    root = ElementTree.fromstring(text)
    visit(root, "/" + local(root.tag), [])
    return out


def document(path: str, data: bytes) -> list[Block]:
    """Blocks of a file by its ending; what can't be read here says so in its kind."""
    suffix = "." + path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    if suffix in IMAGES:
        return [("image_needs_ocr", "image:1", "", None)]
    if suffix == ".xlsx":
        return workbook(data)
    if suffix == ".pdf":
        return pdf(data)
    text = data.decode("utf-8-sig", errors="replace")
    by_suffix = {".csv": lambda: delimited(text, ","), ".tsv": lambda: delimited(text, "\t"), ".json": lambda: layout(text), ".html": lambda: html(text), ".htm": lambda: html(text), ".md": lambda: markdown(text), ".txt": lambda: markdown(text), ".ris": lambda: ris_blocks(text), ".xml": lambda: full_text_xml(text)}
    if suffix not in by_suffix:
        raise ValueError(f"unsupported file type {suffix}")
    return by_suffix[suffix]()


def pdf(data: bytes) -> list[Block]:
    """Page texts where the optional reader is installed; pages under 50 characters need OCR."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return [("pdf_reader_missing", "file", "", None)]
    pages = [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]
    return [("pdf_text" if len(t.strip()) >= 50 else "pdf_needs_ocr", f"page:{k}", t, None) for k, t in enumerate(pages, 1)]
