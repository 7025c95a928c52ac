"""Readers: bytes of one document -> its pages, each a label and lines."""

from __future__ import annotations

import csv
import email
import email.policy
import html.parser
import io
import json
import mailbox
import os
import re
import tempfile
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Callable

from .detect import Unreadable, decode, kind_of, open_zip, unpack

Page = tuple[str | None, list[str]]
_NEWLINES = re.compile("\r\n|[\r\x0b\x1c\x1d\x1e\x85\u2028\u2029]")
_INVISIBLE = re.compile("[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\x00-\x08\x0e-\x1f\x7f]")
_LIGATURES = str.maketrans({"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"})
TEXT_COLUMNS = ("text", "content", "line", "transcription", "ocr_text", "body", "sentence", "value")
PAGE_COLUMNS = ("page", "page_num", "page_number", "page_id", "pagenum")
JSON_TEXT = frozenset("text content lines line value body caption title paragraph transcription ocr_text sentence description plaintext".split())
JSON_PAGES = ("pages", "page", "pageresults", "readresults", "page_list", "pageslist")


def clean(line: str) -> str:
    """NFC, ligatures apart, no invisible characters, a soft hyphen at the end as a hyphen."""
    line = unicodedata.normalize("NFC", line.translate(_LIGATURES)).replace("\xa0", " ")
    line = re.sub("\xad$", "-", line.rstrip()).replace("\xad", "")
    return _INVISIBLE.sub("", line).strip()


def text_pages(text: str) -> list[Page]:
    pages = _NEWLINES.sub("\n", text).removesuffix("\n").split("\f")
    return [(None, p.strip("\n").split("\n")) for p in pages if p.strip()]


def markdown(text: str) -> list[Page]:
    text = re.sub(r"\A---\n.*?\n---\n", "", _NEWLINES.sub("\n", text), flags=re.DOTALL)
    text = re.sub(r"<!--.*?-->", "", text, flags=re.DOTALL)
    out, fenced = [], False
    for line in text.split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
            continue
        if not fenced:
            if re.match(r"\s*([-*_]\s*){3,}$|\s*\[[^]]+\]:\s|\s*\|?[\s:|-]+\|[\s:|-]*$", line):
                continue
            line = re.sub(r"^\s*(?:#{1,6}\s+|>+\s?|[-*+]\s+|\d+[.)]\s+)", "", line)
            line = re.sub(r"!?\[([^]]*)\]\([^)]*\)", r"\1", line)
            line = re.sub(r"(\*\*|__|\*|_|`|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", line)
            if line.strip().startswith("|"):
                line = "\t".join(c.strip() for c in line.strip().strip("|").split("|"))
        out.append(line)
    return [(None, out)]


def table(text: str, delimiter: str | None = None) -> list[Page]:
    """The text column (else all cells) by page column, pages in order of appearance."""
    text = _NEWLINES.sub("\n", text)
    if delimiter is None:
        first = text.split("\n", 1)[0]
        delimiter = max(",;\t|", key=first.count)
    quoting = csv.QUOTE_NONE if text.count('"') % 2 else csv.QUOTE_MINIMAL
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter, quoting=quoting) if any(c.strip() for c in r)]
    if not rows:
        return []
    names = [c.strip().lower() for c in rows[0]]
    column = next((names.index(n) for n in TEXT_COLUMNS if n in names), None)
    if column is None:
        return [(None, ["\t".join(r) for r in rows])]
    page = next((names.index(n) for n in PAGE_COLUMNS if n in names), None)
    pages: dict[str | None, list[str]] = {}
    for r in rows[1:]:
        if len(r) > column:
            pages.setdefault(r[page] if page is not None and len(r) > page else None, []).extend(r[column].split("\n"))
    return list(pages.items())


def tesseract(text: str) -> list[Page]:
    rows = csv.DictReader(io.StringIO(text), delimiter="\t", quoting=csv.QUOTE_NONE)
    pages: dict[str, dict[tuple, list[str]]] = {}
    for r in rows:
        if r.get("level") == "1":
            pages.setdefault(r["page_num"], {})
        elif r.get("level") == "5" and (r.get("text") or "").strip():
            pages.setdefault(r["page_num"], {}).setdefault((int(r["block_num"]), int(r["par_num"]), int(r["line_num"])), []).append(r["text"].strip())
    return [(p, [" ".join(w) for w in lines.values()]) for p, lines in pages.items()]


def _blob(text: str) -> bool:
    return bool(re.match(r"data:[\w/+-]+;", text) or re.fullmatch(r"[A-Za-z0-9+/=]{64,}|[0-9a-fA-F]{32,}|\S{256,}", text))


def json_leaves(data, keys: frozenset[str] | None = JSON_TEXT, key: str | None = None) -> list[str]:
    """Text below text keys (or all strings if keys is None), in order; where an object has lines, its words aren't repeated."""
    if isinstance(data, str):
        return [x for x in _NEWLINES.sub("\n", data).split("\n") if x.strip()] if (keys is None or key in keys) and not _blob(data) else []
    if isinstance(data, list):
        return [x for d in data for x in json_leaves(d, keys, key)]
    if isinstance(data, dict):
        lower = {k.lower(): k for k in data}
        if "lines" in lower and (got := json_leaves(data[lower["lines"]], keys, "lines")):
            return got
        return [x for k, v in data.items() if k.lower() not in ("words", "glyphs", "symbols") for x in json_leaves(v, keys, k.lower() if isinstance(v, str) else key if k.lower() not in JSON_TEXT else k.lower())]
    return []


def _page_list(data, depth: int = 0):
    if isinstance(data, dict) and depth <= 2:
        for k, v in data.items():
            if k.lower() in JSON_PAGES and isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
                return v
        for v in data.values():
            if (got := _page_list(v, depth + 1)) is not None:
                return got
    return None


def json_pages(text: str) -> list[Page]:
    try:
        data = json.loads(text)
    except ValueError as e:
        raise Unreadable("bad_json") from e
    number = lambda d: next((str(d[k]) for k in d if re.fullmatch(r"(?i)page_?(num(ber)?|no|id)?", k) and isinstance(d[k], (str, int))), None)
    if (found := _page_list(data)) is not None:
        return [(number(p) or str(i), json_leaves(p)) for i, p in enumerate(found, 1)]
    if isinstance(data, list) and sum(isinstance(d, dict) and number(d) is not None for d in data) * 2 > len(data):
        pages: dict[str | None, list[str]] = {}
        for d in data:
            pages.setdefault(number(d) if isinstance(d, dict) else None, []).extend(json_leaves(d))
        if len(pages) > 1:
            return list(pages.items())
    return [(None, json_leaves(data) or json_leaves(data, None))]


def jsonl(text: str) -> list[Page]:
    pages = []
    for i, line in enumerate(text.split("\n"), 1):
        if line.strip():
            try:
                data = json.loads(line)
            except ValueError:
                continue
            pages.append((str(i), json_leaves(data) or json_leaves(data, None)))
    return pages


class _Flow(html.parser.HTMLParser):
    """Visible text by block elements; hOCR pages and lines where the classes say so."""

    BLOCKS = frozenset("p div section article header footer li ul ol table tr h1 h2 h3 h4 h5 h6 blockquote pre br hr dd dt dl title figcaption main nav aside form".split())
    HIDDEN = frozenset(("script", "style", "noscript", "template"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pages: list[Page] = [(None, [])]
        self.line: list[str] = []
        self.hidden = self.pre = 0

    def flush(self) -> None:
        text = "".join(self.line)
        for part in text.split("\n") if self.pre else [re.sub(r"\s+", " ", text)]:
            if part.strip():
                self.pages[-1][1].append(part.strip())
        self.line = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        kind = a.get("class") or ""
        if tag in self.HIDDEN:
            self.hidden += 1
        if tag in self.BLOCKS or "ocr_line" in kind or "ocr_page" in kind:
            self.flush()
        if "ocr_page" in kind or re.search(r"page-break-before\s*:\s*always|break-before\s*:\s*page", a.get("style") or ""):
            if self.pages[-1][1]:
                self.pages.append((None, []))
        if tag in ("td", "th") and self.line:
            self.line.append("\t")
        self.pre += tag == "pre"

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in self.BLOCKS:
            self.flush()
        self.pre -= tag == "pre" and self.pre > 0

    def handle_data(self, data):
        if not self.hidden:
            self.line.append(data)


def html_pages(text: str) -> list[Page]:
    flow = _Flow()
    flow.feed(text)
    flow.close()
    flow.flush()
    return [p for p in flow.pages if p[1]]


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


def _all(e: ET.Element, *names: str) -> list[ET.Element]:
    return [x for x in e.iter() if _local(x) in names]


def _flat(e: ET.Element) -> str:
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip()


def parse_xml(data: bytes) -> ET.Element:
    if re.search(rb"<!ENTITY|<!DOCTYPE[^>]*\[", data[:65536]):
        raise Unreadable("xml_entities")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise Unreadable("bad_xml") from e


def alto(root: ET.Element) -> list[Page]:
    pages = []
    for p in _all(root, "page"):
        lines = []
        for line in _all(p, "textline"):
            words: list[str] = []
            for w in line:
                if _local(w) == "string":
                    words.append(w.get("CONTENT") or "")
                elif _local(w) == "hyp" and words:
                    words[-1] += "-"
            lines.append(" ".join(words))
        pages.append((p.get("PHYSICAL_IMG_NR") or p.get("ID"), lines))
    return pages


def page_xml(root: ET.Element) -> list[Page]:
    def own(e: ET.Element) -> str:
        for t in e:
            if _local(t) == "textequiv":
                return next((_flat(u) for u in t if _local(u) == "unicode"), "")
        return ""

    def region_lines(r: ET.Element) -> list[str]:
        lines = _all(r, "textline")
        got = [own(x) or " ".join(own(w) for w in x if _local(w) == "word") for x in lines]
        return got if lines else [own(r)]

    pages = []
    for p in _all(root, "page"):
        regions = [r for r in p if _local(r).endswith("region")]
        order = {x.get("regionRef"): int(x.get("index") or 0) for x in _all(p, "regionrefindexed")}
        regions.sort(key=lambda r: order.get(r.get("id"), len(order) + 1_000_000))
        pages.append((None, [x for r in regions for x in region_lines(r) if x]))
    return pages


def tei(root: ET.Element) -> list[Page]:
    pages: list[Page] = [(None, [])]
    line: list[str] = []

    def flush() -> None:
        text = re.sub(r"\s+", " ", "".join(line)).strip()
        if text:
            pages[-1][1].append(text)
        line.clear()

    def walk(e: ET.Element) -> None:
        name = _local(e)
        if name in ("teiheader", "sic", "orig", "abbr"):
            line.append(e.tail or "")
            return
        if name == "pb":
            flush()
            if pages[-1][1]:
                pages.append((e.get("n"), []))
            else:
                pages[-1] = (e.get("n"), [])
        if name in ("lb", "p", "head", "l", "item", "div", "ab", "row"):
            flush()
        line.append(e.text or "")
        for child in e:
            walk(child)
        if name in ("p", "head", "l", "item", "div", "ab", "row"):
            flush()
        line.append(e.tail or "")

    walk(root)
    flush()
    return [p for p in pages if p[1]]


def abbyy(root: ET.Element) -> list[Page]:
    def text(line: ET.Element) -> str:
        out = ""
        for c in _all(line, "charparams"):
            if c.get("wordStart") in ("1", "true") and out and not out.endswith(" "):
                out += " "
            out += c.text or ""
        return re.sub("¬$", "-", (out or _flat(line)).strip())

    return [(None, [t for x in _all(p, "line") if (t := text(x))]) for p in _all(root, "page")]


def djvu(root: ET.Element) -> list[Page]:
    pages = []
    for o in _all(root, "object"):
        label = next((x.get("value") for x in _all(o, "param") if (x.get("name") or "").upper() == "PAGE"), o.get("usemap"))
        pages.append((label, [" ".join(_flat(w) for w in _all(x, "word")) or _flat(x) for x in _all(o, "line") or _all(o, "paragraph")]))
    return pages


def generic_xml(root: ET.Element) -> list[Page]:
    def lines(e: ET.Element) -> list[str]:
        if (e.text or "").strip() or not len(e) or any((c.tail or "").strip() for c in e):
            return [t] if (t := _flat(e)) else []
        return [x for c in e for x in lines(c)]

    parts = [lines(c) for c in root]
    return [(str(i), p) for i, p in enumerate(parts, 1) if p] if sum(map(bool, parts)) >= 2 else [(None, lines(root))]


def subtitles(text: str) -> list[Page]:
    out, timed = [], False
    for line in _NEWLINES.sub("\n", text).split("\n"):
        if "-->" in line:
            timed = True
        elif not line.strip():
            timed = False
        elif timed:
            out.append(re.sub(r"<[^>]*>|\{\\[^}]*\}", "", line))
    return [(None, out)]


def _message(m) -> list[str]:
    out = [str(m["subject"])] if m["subject"] else []
    body = m.get_body(preferencelist=("plain", "html"))
    if body is not None:
        text = body.get_content()
        out += [x for _, p in html_pages(text) for x in p] if body.get_content_subtype() == "html" else _NEWLINES.sub("\n", text).rstrip("\n").split("\n")
    return out


def mail(data: bytes) -> list[Page]:
    return [(None, _message(email.message_from_bytes(data, policy=email.policy.default)))]


def mbox(data: bytes) -> list[Page]:
    with tempfile.TemporaryDirectory() as d:
        with open(path := os.path.join(d, "m"), "wb") as f:
            f.write(data)
        box = mailbox.mbox(path, factory=lambda f: email.message_from_binary_file(f, policy=email.policy.default))
        return [(str(i), _message(m)) for i, m in enumerate(box, 1)]


def docx(data: bytes) -> list[Page]:
    root = parse_xml(open_zip(data).read("word/document.xml"))
    pages: list[Page] = [(None, [])]
    for p in _all(root, "p"):
        line: list[str] = []
        for e in p.iter():
            name = _local(e)
            if name == "t":
                line.append(e.text or "")
            elif name == "tab":
                line.append("\t")
            elif name == "br" and any(v == "page" for v in e.attrib.values()) or name in ("pagebreakbefore", "lastrenderedpagebreak"):
                if line and "".join(line).strip():
                    pages[-1][1].append("".join(line))
                    line = []
                if pages[-1][1]:
                    pages.append((None, []))
            elif name in ("br", "cr"):
                line.append("\n")
        pages[-1][1].extend(x for x in "".join(line).split("\n") if x.strip())
    return [p for p in pages if p[1]]


def xlsx(data: bytes) -> list[Page]:
    z = open_zip(data)
    names = z.namelist()
    shared = [_flat(s) for s in _all(parse_xml(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target", "").lstrip("/").removeprefix("xl/") for r in parse_xml(z.read("xl/_rels/workbook.xml.rels"))}
    pages = []
    for sheet in _all(parse_xml(z.read("xl/workbook.xml")), "sheet"):
        ref = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
        rows = []
        for row in _all(parse_xml(z.read("xl/" + targets[ref])), "row"):
            cells = []
            for c in _all(row, "c"):
                value = next((_flat(x) for x in c if _local(x) in ("v", "is")), "")
                if c.get("t") == "s" and value:
                    cells.append(shared[int(value)])
                elif c.get("t") in ("inlineStr", "str"):
                    cells.append(value)
            if any(cells):
                rows.append("\t".join(cells))
        if rows:
            pages.append((sheet.get("name"), rows))
    return pages


def pptx(data: bytes) -> list[Page]:
    z = open_zip(data)
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    return [(str(i), [t for p in _all(parse_xml(z.read(n)), "p") if (t := _flat(p))]) for i, n in enumerate(slides, 1)]


def odf(data: bytes) -> list[Page]:
    root = parse_xml(open_zip(data).read("content.xml"))
    if sheets := _all(root, "table"):
        pages = []
        for s in sheets:
            rows = [r for r in ("\t".join(_flat(c) for c in row if _local(c) == "table-cell").strip() for row in _all(s, "table-row")) if r]
            name = next((v for k, v in s.attrib.items() if k.endswith("}name")), None)
            pages.append((name, rows))
        if not _all(root, "text"):
            return [p for p in pages if p[1]]
    drawn = _all(root, "page")
    return [(str(i), [t for p in _all(d, "p", "h") if (t := _flat(p))]) for i, d in enumerate(drawn, 1)] if drawn else [(None, [t for p in _all(root, "p", "h") if (t := _flat(p))])]


def epub(data: bytes) -> list[Page]:
    z = open_zip(data)
    opf = next(r.get("full-path") for r in _all(parse_xml(z.read("META-INF/container.xml")), "rootfile"))
    book, base = parse_xml(z.read(opf)), opf.rpartition("/")[0]
    items = {i.get("id"): i.get("href") for i in _all(book, "item")}
    pages = []
    for ref in _all(book, "itemref"):
        name = f"{base}/{items.get(ref.get('idref'))}".lstrip("/")
        if name in z.namelist():
            lines = [x for _, p in html_pages(decode(z.read(name))[0]) for x in p]
            if lines:
                pages.append((os.path.splitext(os.path.basename(name))[0], lines))
    return pages


def rtf(data: bytes) -> list[Page]:
    text = data.decode("latin-1")
    code = re.search(r"\\ansicpg(\d+)", text)
    encoding = f"cp{code[1]}" if code else "cp1252"
    out: list[str] = []
    stack: list[bool] = []
    skip, pending = False, b""

    def settle() -> None:
        nonlocal pending
        if pending:
            out.append(pending.decode(encoding, "replace"))
            pending = b""

    tokens = re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", text, re.DOTALL)
    swallow = 0
    for m in tokens:
        word, number, hexed, symbol, brace, char = m.groups()
        if hexed:
            if swallow:
                swallow -= 1
            elif not skip:
                pending += bytes([int(hexed, 16)])
            continue
        settle()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif symbol == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "object"):
            skip = True
        elif skip:
            continue
        elif word in ("par", "line", "row", "sect"):
            out.append("\n")
        elif word == "page":
            out.append("\f")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            swallow = 1
        elif symbol in ("\\", "{", "}"):
            out.append(symbol)
        elif symbol == "~":
            out.append(" ")
        elif char:
            if swallow:
                swallow -= 1
            else:
                out.append(char)
    settle()
    joined = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text_pages(joined)


def bundle(data: bytes) -> list[Page]:
    """Members of a ZIP in natural order, as the pages of one document; of equal stems the first kind by precedence."""
    z = open_zip(data)
    natural = lambda n: [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", n)]
    best: dict[str, tuple[int, str]] = {}
    precedence = ("alto", "page_xml", "html", "xml", "text", "markdown", "csv", "json")
    for name in sorted(z.namelist(), key=natural):
        base = name.rpartition("/")[2]
        if name.endswith("/") or base.startswith((".", "~$")) or name.startswith("__MACOSX"):
            continue
        try:
            kind = kind_of(unpack(z.read(name)), base)
        except Unreadable:
            continue
        rank = precedence.index(kind) if kind in precedence else len(precedence)
        stem = os.path.splitext(name)[0].lower()
        if kind != "zip" and (stem not in best or rank < best[stem][0]):
            best[stem] = rank, name
    pages: list[Page] = []
    for _, name in sorted(best.values(), key=lambda x: natural(x[1])):
        got = read(z.read(name), name)[1]
        pages += [(label or os.path.splitext(name.rpartition("/")[2])[0], lines) for label, lines in got]
    return pages


#: Below so many characters a page has no text layer; over that share of unreadable ones it is garbled; at that share of invisible text it is OCR's.
PDF_LEAST_CHARS, PDF_GARBLED, PDF_OCR_SHARE = 1, 0.20, 0.50


def text_layer(text: str, objects: int, invisible: int) -> tuple[str, str | None]:
    """none, garbled, ocr or digital, and why a page needs OCR."""
    seen = [c for c in text if not c.isspace() and c not in "\x02\ufffe"]
    if len(seen) < PDF_LEAST_CHARS:
        return "none", "no extractable text layer"
    if sum(c == "\ufffd" or unicodedata.category(c) in ("Cc", "Cf", "Co", "Cn") for c in seen) > PDF_GARBLED * len(seen):
        return "garbled", "garbled text layer"
    return ("ocr" if objects and invisible >= PDF_OCR_SHARE * objects else "digital"), None


def pdf(data: bytes) -> list[Page]:
    """Pages of a PDF by the optional library pypdf; garbled pages have no lines."""
    import pypdf

    reader = pypdf.PdfReader(io.BytesIO(data))
    if reader.is_encrypted and not reader.decrypt(""):
        raise Unreadable("encrypted")
    pages: list[Page] = []
    for k, page in enumerate(reader.pages, 1):
        text = page.extract_text() or ""
        layer, _ = text_layer(text, 0, 0)
        pages.append((str(k), text.splitlines() if layer in ("digital", "ocr") else []))
    return pages


_ON_TEXT: dict[str, Callable[[str], list[Page]]] = {
    "text": text_pages, "markdown": markdown, "csv": table, "tsv": lambda t: table(t, "\t"), "tesseract": tesseract, "json": json_pages, "jsonl": jsonl, "html": html_pages, "subtitles": subtitles,
}
_ON_XML: dict[str, Callable[[ET.Element], list[Page]]] = {"alto": alto, "page_xml": page_xml, "tei": tei, "abbyy": abbyy, "djvu": djvu, "xml": generic_xml}
_ON_BYTES: dict[str, Callable[[bytes], list[Page]]] = {"email": mail, "mbox": mbox, "docx": docx, "xlsx": xlsx, "pptx": pptx, "odf": odf, "epub": epub, "rtf": rtf, "zip": bundle, "pdf": pdf}


def read(data: bytes, name: str) -> tuple[str, list[Page]]:
    """Kind and pages of a document; Unreadable with its reason."""
    data = unpack(data)
    kind = kind_of(data, name)
    if kind in _ON_BYTES:
        pages = _ON_BYTES[kind](data)
    elif kind in _ON_XML:
        pages = _ON_XML[kind](parse_xml(data))
    else:
        pages = _ON_TEXT[kind](decode(data)[0])
    return kind, [(label, [clean(x) for x in lines]) for label, lines in pages]
