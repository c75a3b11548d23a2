"""Documents in files: text, mail and office formats, read to text with locations and written back masked.

Each function takes and returns bytes and plain values, so that it runs in an Arrow batch on any executor."""

from __future__ import annotations

import email
import email.policy
import io
import re
import struct
import unicodedata
from dataclasses import dataclass, field
from email.message import EmailMessage
from html import unescape

from maskwright.sources import encoding, office

KINDS = {"eml": "eml", "docx": "docx", "docm": "docx", "xlsx": "xlsx", "xlsm": "xlsx", "pptx": "pptx", "pptm": "pptx", "pdf": "pdf", "msg": "msg"}
NOT_IN_NAMES = re.compile(r'[\\"<>@,;:]')
HEADERS = ("Subject", "From", "To", "Cc", "Reply-To", "Date")


@dataclass
class Document:
    kind: str
    text: str = ""
    encoding: str = "utf-8"
    bom: bool = False
    warnings: list[str] = field(default_factory=list)
    properties: list[tuple[str, str]] = field(default_factory=list)
    locations: list[tuple[int, str]] = field(default_factory=list)
    fields: list[tuple[str, int, int]] = field(default_factory=list)  # of a mail: header, body or attachment, and its text
    property_nodes: list[tuple[str, int, int]] = field(default_factory=list)  # part and span of each property
    phonetic: list[tuple[str, list, list]] = field(default_factory=list)  # part, spans of a string, spans of how it is read
    nodes: list[tuple[int, int, str, int, int]] = field(default_factory=list)  # text start and end, part, and its span there


def kind_of(path: str) -> str:
    return KINDS.get(path.rsplit(".", 1)[-1].lower() if "." in path else "", "text")


def open_document(path: str, data: bytes, forced: str | None = None) -> Document:
    kind = kind_of(path)
    if kind == "eml":
        return open_mail(data)
    if kind in ("docx", "xlsx", "pptx"):
        return open_office(kind, data)
    if kind == "msg":
        return open_msg(data)
    if kind == "pdf":
        return open_pdf(data)
    text, codec, bom = encoding.decode(data, forced)
    return Document("text", text, codec, bom)


class Builder:
    """Text from pieces, some of which are nodes of a source part."""

    def __init__(self, doc: Document):
        self.doc, self.out, self.at = doc, [], 0

    def push(self, s: str, part: str | None = None, span: tuple[int, int] = (0, 0)) -> None:
        if part is not None and s:
            self.doc.nodes.append((self.at, self.at + len(s), part, *span))
        self.out.append(s)
        self.at += len(s)

    def property(self, label: str, part: str, xml: str, span: tuple[int, int]) -> None:
        if (v := unescape(xml[slice(*span)])).strip():
            self.doc.properties.append((label, v))
            self.doc.property_nodes.append((part, *span))

    def newline(self) -> None:
        if self.out and not self.out[-1].endswith("\n"):
            self.push("\n")

    def place(self, label: str) -> None:
        self.doc.locations.append((self.at, label))

    def done(self) -> Document:
        self.doc.text = "".join(self.out)
        return self.doc


# ---- mail ----


def open_mail(data: bytes) -> Document:
    """Headers, body and names of attachments; where each is in the text is kept, so that writing need not guess."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    doc = Document("eml")
    b = Builder(doc)

    def field_(kind: str, text: str) -> None:
        doc.fields.append((kind, b.at, b.at + len(text)))
        b.push(text)

    for h in HEADERS:
        if m[h]:
            b.place(h)
            b.push(f"{h}: ")
            field_(h, " ".join(str(m[h]).split()))
            b.push("\n")
    body = m.get_body(("plain", "html"))
    if body is not None:
        b.place("body")
        text = body.get_content()
        if body.get_content_type() == "text/html":
            text = plain_html(text)
            doc.warnings.append("the body is written as plain text")
        field_("body", text.replace("\r\n", "\n"))
        b.newline()
    for i, part in enumerate(m.iter_attachments(), 1):
        b.place(f"attachment {i}")
        b.push("Attachment: ")
        field_("attachment", (part.get_filename() or f"attachment-{i}").replace("\n", " "))
        b.push("\n")
    if any(k == "attachment" for k, _, _ in doc.fields):
        doc.warnings.append("attachments are not read and not written")
    return b.done()


def plain_html(text: str) -> str:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", text)
    text = re.sub(r"(?i)<br\s*/?>|</(?:p|div|tr|li|h[1-6])>", "\n", text)
    return unescape(re.sub(r"<[^>]*>", "", text))


def write_mail(doc: Document, replacements: list[tuple[int, int, str]]) -> bytes:
    """A new mail from the masked fields. Addresses go to an invalid domain; of attachments a number and the extension stay."""
    out = EmailMessage(policy=email.policy.SMTP)
    new = split_output(replacements, [(s, e) for _, s, e in doc.fields], doc.text)
    fields = [(kind, text) for (kind, _, _), text in zip(doc.fields, new, strict=True)]
    for kind, text in fields:
        plain = " ".join(text.split())
        if kind in ("Subject", "Date"):
            out[kind] = plain
        elif kind in HEADERS:
            # what may end a display name, or begin an address, goes
            out[kind] = f'"{NOT_IN_NAMES.sub(" ", plain).strip() or "undisclosed"}" <undisclosed@masked.invalid>'
    for i, name in enumerate((t for k, t in fields if k == "attachment"), 1):
        ext = re.search(r"\.([A-Za-z0-9]{1,5})\Z", name)
        out[f"X-Removed-Attachment-{i}"] = f"attachment-{i}.{ext[1].lower() if ext else 'bin'}"
    out.set_content("".join(t for k, t in fields if k == "body"), cte="base64")
    return out.as_bytes()


def split_output(replacements: list[tuple[int, int, str]], ranges: list[tuple[int, int]], text: str) -> list[str]:
    """The masked content of each range: a replacement goes to the range that holds its start and is cut from the others."""
    out = []
    for a, z in ranges:
        parts, at = [], a
        for s, e, r in replacements:
            if e <= a or s >= z:
                continue
            parts.append(text[at : max(s, a)])
            if s >= a:
                parts.append(r)
            at = max(at, min(e, z))
        out.append("".join(parts) + text[at:z])
    return out


# ---- office files ----


def open_office(kind: str, data: bytes) -> Document:
    b = Builder(Document(kind))
    office.read_office(b, kind, data)
    b.newline()
    return b.done()


def property_text(properties: list[tuple[str, str]]) -> str:
    """What is masked of properties: their values, one in a line."""
    return "\n".join(v.replace("\n", " ") for _, v in properties)


def write_office(data: bytes, doc: Document, replacements: list[tuple[int, int, str]], properties: str = "clear") -> bytes:
    """The file with changed nodes only. properties: clear, keep, or mask: replacements then go on behind the text and a line
    feed with those of property_text."""
    edits = office.changed_nodes(doc, split_output(replacements, [(n[0], n[1]) for n in doc.nodes], doc.text))
    if properties == "clear":
        new = [""] * len(doc.properties)
    elif properties == "mask":
        ranges, at, text = [], len(doc.text) + 1, doc.text + "\n" + property_text(doc.properties)
        for _, v in doc.properties:
            ranges.append((at, at + len(v)))
            at += len(v) + 1
        new = split_output(replacements, ranges, text)
    else:
        new = [v for _, v in doc.properties]
    for (part, a, z), (_, old), v in zip(doc.property_nodes, doc.properties, new, strict=True):
        if v != old:
            edits.setdefault(part, {})[a, z] = v
    return office.write_parts(data, edits)


# ---- Outlook messages ----


def compound_streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by path."""
    if not data.startswith(office.OLE):
        raise ValueError("not a compound file")
    size = 1 << struct.unpack_from("<H", data, 30)[0]
    mini = 1 << struct.unpack_from("<H", data, 32)[0]
    n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
    cutoff, first_mini = struct.unpack_from("<I", data, 56)[0], struct.unpack_from("<I", data, 60)[0]
    first_difat, n_difat = struct.unpack_from("<II", data, 68)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    difat = list(struct.unpack_from("<109I", data, 76))
    for _ in range(n_difat):
        block = struct.unpack(f"<{size // 4}I", sector(first_difat))
        difat += block[:-1]
        first_difat = block[-1]
    fat = [x for i in difat[:n_fat] if i < 0xFFFFFFFA for x in struct.unpack(f"<{size // 4}I", sector(i))]

    def chain(i: int, table: list[int], read) -> bytes:
        out, seen = [], 0
        while i < 0xFFFFFFFA and i < len(table) and seen <= len(table):
            out.append(read(i))
            i, seen = table[i], seen + 1
        return b"".join(out)

    directory = chain(first_dir, fat, sector)
    entries = []
    for at in range(0, len(directory) - 127, 128):
        length = struct.unpack_from("<H", directory, at + 64)[0]
        name = directory[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
        left, right, child = struct.unpack_from("<III", directory, at + 68)
        entries.append((name, directory[at + 66], left, right, child, struct.unpack_from("<I", directory, at + 116)[0], struct.unpack_from("<Q", directory, at + 120)[0]))
    minis = chain(entries[0][5], fat, sector)
    table = [x for x in struct.unpack(f"<{len(t) // 4}I", t)] if (t := chain(first_mini, fat, sector)) else []
    out: dict[str, bytes] = {}

    def walk(i: int, path: str) -> None:
        todo = [i]
        while todo:
            k = todo.pop()
            if k >= len(entries):
                continue
            name, kind, left, right, child, start, length = entries[k]
            todo += [left, right]
            if kind == 1:
                walk(child, f"{path}{name}/")
            elif kind == 2:
                read = (lambda j: minis[j * mini : (j + 1) * mini]) if length < cutoff else sector
                out[path + name] = chain(start, table if length < cutoff else fat, read)[:length]

    walk(entries[0][4], "")
    return out


def open_msg(data: bytes) -> Document:
    streams = compound_streams(data)

    def prop(tag: str, at: str = "") -> str:
        if (raw := streams.get(f"{at}__substg1.0_{tag}001F")) is not None:
            return raw.decode("utf-16-le", "replace")
        return encoding.decode(streams[k])[0] if (k := f"{at}__substg1.0_{tag}001E") in streams else ""

    doc = Document("msg")
    b = Builder(doc)
    # fixed values: property tags of a message
    for label, tags in (("Subject", ("0037",)), ("From", ("0C1A", "5D01", "0C1F")), ("To", ("0E04",)), ("Cc", ("0E03",))):
        text = " ".join(dict.fromkeys(x for t in tags if (x := prop(t))))
        if text:
            b.place(label)
            b.push(f"{label}: {text}\n")
    body = prop("1000") or plain_html(encoding.decode(streams.get("__substg1.0_10130102", b""))[0])
    b.place("body")
    b.push(body.replace("\r\n", "\n"))
    b.newline()
    for i, at in enumerate(sorted({k.split("/")[0] + "/" for k in streams if k.startswith("__attach")}), 1):
        b.place(f"attachment {i}")
        b.push(f"Attachment: {prop('3707', at) or prop('3704', at) or f'attachment-{i}'}\n")
    return b.done()


def open_pdf(data: bytes) -> Document:
    try:
        import pypdf
    except ImportError:
        raise ValueError("reading PDF needs pypdf") from None
    doc = Document("pdf")
    b = Builder(doc)
    for i, page in enumerate(pypdf.PdfReader(io.BytesIO(data)).pages, 1):
        b.place(f"page {i}")
        b.push(f"--- {i} ページ ---\n" if i > 1 else "")
        b.push("".join(unicodedata.normalize("NFKC", c) if "⺀" <= c <= "⿟" or "豈" <= c <= "﫿" else c for c in page.extract_text() or ""))
        b.newline()
    if len(b.done().text.strip()) < 4:
        doc.warnings.append("no text: the pages may be scans")
    return doc


def write_document(path: str, data: bytes, replacements: list[tuple[int, int, str]], forced: str | None = None, output_encoding: str = "same", properties: str = "clear") -> bytes:
    """The masked file. replacements: (start, end, text), disjoint, by start, in the text that open_document gives."""
    doc = open_document(path, data, forced)
    if doc.kind in ("docx", "xlsx", "pptx"):
        return write_office(data, doc, replacements, properties)
    if doc.kind == "eml":
        return write_mail(doc, replacements)
    masked = split_output(replacements, [(0, len(doc.text))], doc.text)[0]
    codec, mark = (doc.encoding, doc.bom) if output_encoding == "same" else encoding.label(output_encoding)
    return encoding.encode(masked, codec, mark)


def output_name(path: str, suffix: str = ".masked") -> str:
    """report.txt -> report.masked.txt; PDF and Outlook messages become text."""
    stem, dot, ext = path.rpartition(".")
    name = f"{stem}{suffix}.{ext}" if dot else path + suffix
    return name + ".txt" if kind_of(path) in ("pdf", "msg") else name
