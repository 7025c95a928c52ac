"""What a file is, by its content, and its bytes as text."""

from __future__ import annotations

import bz2
import gzip
import importlib.util
import io
import json
import lzma
import re
import zipfile

MAX_BYTES = 256 << 20
MAX_RATIO = 200
FALLBACKS = ("cp1250", "iso8859_2", "cp1252")
_OPENERS = {b"\x1f\x8b": gzip.open, b"BZh": bz2.open, b"\xfd7zXZ\x00": lzma.open}
_XML_ROOTS = {"alto": "alto", "pcgts": "page_xml", "tei": "tei", "teicorpus": "tei", "djvuxml": "djvu", "html": "html"}
_BY_NAME = {"md": "markdown", "markdown": "markdown", "csv": "csv", "tsv": "tsv", "srt": "subtitles", "vtt": "subtitles", "jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "mbox": "mbox", "eml": "email"}


class Unreadable(ValueError):
    """Why a file can't be read: a short reason code."""


def unpack(data: bytes) -> bytes:
    """Looks through one layer of gzip, bzip2 or xz, within limits."""
    for magic, opener in _OPENERS.items():
        if data.startswith(magic):
            most = min(MAX_BYTES, MAX_RATIO * max(len(data), 1024))
            with opener(io.BytesIO(data)) as f:
                out = f.read(most + 1)  # what is over the limit is never unpacked
            if len(out) > most:
                raise Unreadable("compression_bomb")
            return out
    return data


def open_zip(data: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Unreadable("bad_zip") from e
    if sum(i.file_size for i in z.infolist()) > MAX_BYTES or len(z.infolist()) > 10_000:
        raise Unreadable("compression_bomb")
    if any(i.flag_bits & 1 for i in z.infolist()):
        raise Unreadable("encrypted")
    return z


def decode(data: bytes, fallbacks: tuple[str, ...] = FALLBACKS) -> tuple[str, str]:
    """Text and encoding: a byte order mark, UTF-8, UTF-16 by its zero bytes, then the fallbacks in order."""
    for bom, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(bom):
            return data.decode(name, "replace"), name
    try:
        text = data.decode("utf-8")
        if "\0" not in text:
            return text, "utf-8"
    except UnicodeDecodeError:
        pass
    head = data[:4096]
    even, odd = head[::2].count(0) / max(1, len(head[::2])), head[1::2].count(0) / max(1, len(head[1::2]))
    for share, other, name in ((odd, even, "utf-16-le"), (even, odd, "utf-16-be")):
        if share > 0.4 and other < 0.1:
            return data.decode(name, "replace"), name
    controls = sum(b < 32 and b not in (9, 10, 11, 12, 13, 27) for b in head)
    if head.count(0) > 0.01 * len(head) or controls > 0.1 * len(head):
        raise Unreadable("binary")
    for name in fallbacks:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace"), "utf-8-replaced"


def _zip_kind(z: zipfile.ZipFile) -> str:
    names = set(z.namelist())
    for part, kind in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"), ("META-INF/container.xml", "epub")):
        if part in names:
            return kind
    if "mimetype" in names and z.read("mimetype").startswith(b"application/vnd.oasis"):
        return "odf"
    return "zip"


def kind_of(data: bytes, name: str) -> str:
    """The reader's name for these (unpacked) bytes; Unreadable with a reason for what has none."""
    end = re.sub(r"\.(gz|bz2|xz)$", "", name.lower()).rpartition(".")[2]
    if data.startswith(b"%PDF"):
        if importlib.util.find_spec("pypdf") is None:
            raise Unreadable("dependency_missing")
        return "pdf"
    if data.startswith(b"\xd0\xcf\x11\xe0"):
        raise Unreadable("legacy_office")
    if data.startswith(b"PK\x03\x04"):
        return _zip_kind(open_zip(data))
    if data.startswith((b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"II*\0", b"MM\0*")):
        raise Unreadable("image")
    if data[257:262] == b"ustar" or data.startswith((b"7z\xbc\xaf", b"Rar!")):
        raise Unreadable("archive")
    if data.startswith(b"{\\rtf"):
        return "rtf"
    text, _ = decode(data)
    head = text[:4000].lstrip("\ufeff \t\r\n")
    if re.match(r"(?i)<!doctype html|<html[\s>]", head):
        return "html"
    if head.startswith("<"):
        root = re.search(r"<(?![?!])(?:[\w.-]+:)?([\w.-]+)([^>]*)>", re.sub(r"<!--.*?-->|<\?.*?\?>", "", head, flags=re.DOTALL))
        if root:
            if root[1].lower() == "document" and "abbyy" in root[2].lower():
                return "abbyy"
            return _XML_ROOTS.get(root[1].lower(), "xml")
    if head.startswith("WEBVTT"):
        return "subtitles"
    if head.startswith("level\tpage_num\tblock_num"):
        return "tesseract"
    if end in _BY_NAME:
        return _BY_NAME[end]
    if head[:1] in "{[":
        try:
            json.loads(text)
            return "json"
        except ValueError:
            lines = [x for x in text.splitlines()[:50] if x.strip()]
            try:
                if [json.loads(x) for x in lines] and len(lines) > 1:
                    return "jsonl"
            except ValueError:
                pass
    if re.match(r"From \S+ .*\d{4}\r?\n", head):
        return "mbox"
    if re.match(r"(?i)(?:(?:from|to|subject|date|message-id|received|mime-version|return-path)\s*:.*\r?\n){2}", head):
        return "email"
    if re.match(r"\d+\r?\n\d\d:\d\d:\d\d[,.]\d{3} --> ", head):
        return "subtitles"
    return "text"
