"""Office files: which elements and attributes of which parts hold text, reading them, and writing only what changed.

A part is scanned once for tags; what is between them is never parsed into a tree, so that every piece of text keeps its
place in the part and all other bytes are copied as they are.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from xml.sax.saxutils import escape

PART_LIMIT = 256 << 20
OLE = b"\xd0\xcf\x11\xe0"
TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<[^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=<>/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


@dataclass(frozen=True)
class Part:
    """Parts whose names match, the elements with text, those that end a line, and attributes or elements that are properties."""

    names: str
    label: str
    text: tuple[str, ...] = ()
    lines: tuple[str, ...] = ()
    attributes: tuple[str, ...] = ()
    elements: tuple[str, ...] = ()


WORD_TEXT, AUTHORS = ("t", "delText", "instrText"), ("author", "initials")
DRAWN = dict(text=("t",), lines=("p",))
# Names of parts, elements and attributes of the formats.
PARTS = {
    "docx": (
        Part(r"word/document\.xml", "document", WORD_TEXT, ("p",), AUTHORS),
        Part(r"word/header.*\.xml", "header", WORD_TEXT, ("p",), AUTHORS),
        Part(r"word/footer.*\.xml", "footer", WORD_TEXT, ("p",), AUTHORS),
        Part(r"word/footnotes.*\.xml", "footnotes", WORD_TEXT, ("p",), AUTHORS),
        Part(r"word/endnotes.*\.xml", "endnotes", WORD_TEXT, ("p",), AUTHORS),
        Part(r"word/comments.*\.xml", "comments", WORD_TEXT, ("p",), AUTHORS),
        Part(r"word/charts/chart.*\.xml", "chart", **DRAWN),
        Part(r"word/diagrams/data.*\.xml", "diagram", **DRAWN),
        Part(r"word/people\.xml", "people", attributes=("author", "userId")),
    ),
    "pptx": (
        Part(r"ppt/slides/slide.*\.xml", "slide {n}", **DRAWN),
        Part(r"ppt/notesSlides/notesSlide.*\.xml", "notes {n}", **DRAWN),
        Part(r"ppt/comments/.*\.xml", "comments", ("t", "text"), ("p", "text")),
        Part(r"ppt/charts/chart.*\.xml", "chart", **DRAWN),
        Part(r"ppt/diagrams/data.*\.xml", "diagram", **DRAWN),
        Part(r"ppt/(?:commentAuthors|authors)\.xml", "people", attributes=("name", "initials", "userId")),
    ),
    "xlsx": (
        Part(r"xl/comments.*\.xml", "comments", ("t",), ("comment",), elements=("author",)),
        Part(r"xl/threadedComments/.*\.xml", "comments", ("text",), ("threadedComment",)),
        Part(r"xl/(?:drawings/drawing|charts/chart).*\.xml", "drawing", **DRAWN),
        Part(r"xl/persons/.*\.xml", "people", attributes=("displayName", "userId")),
    ),
}
LINKS = {"docx": r"word/_rels/.*\.rels", "pptx": r"ppt/(?:slides|notesSlides)/_rels/.*\.rels", "xlsx": r"xl/(?:worksheets|drawings)/_rels/.*\.rels"}
PROPERTIES = (
    Part(r"docProps/core\.xml", "", elements=("creator", "lastModifiedBy", "title", "subject", "keywords", "description", "category")),
    Part(r"docProps/app\.xml", "", elements=("Company", "Manager")),
)


@dataclass
class Tag:
    name: str  # without its prefix
    closing: bool
    single: bool
    start: int
    end: int


def tags(xml: str) -> Iterator[Tag]:
    """Tags in order; comments, CDATA and instructions are passed over."""
    for m in TAG.finditer(xml):
        if m[0][:2] not in ("<!", "<?") and (name := re.match(r"</?(?:[^\s/>:]+:)?([^\s/>]+)", m[0])):
            yield Tag(name[1], m[0][1] == "/", m[0].endswith("/>"), m.start(), m.end())


def attributes(xml: str, tag: Tag) -> dict[str, tuple[int, int]]:
    """Where the values of a tag's attributes are, by name without prefix."""
    out = {}
    for m in ATTRIBUTE.finditer(xml, tag.start, tag.end):
        out[m[1].rsplit(":", 1)[-1]] = m.span(2) if m[2] is not None else m.span(3)
    return out


def value(xml: str, found: dict[str, tuple[int, int]], name: str) -> str:
    return unescape(xml[slice(*found[name])]) if name in found else ""


def read_parts(data: bytes) -> dict[str, str]:
    """XML parts by name; of others only the name."""
    if data.startswith(OLE):
        raise ValueError("legacy or encrypted office files can't be read")
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise ValueError("not an office file") from None
    parts = {}
    for info in z.infolist():
        if info.filename.endswith((".xml", ".rels")):
            if info.file_size > PART_LIMIT:
                raise ValueError(f"{info.filename} is too large")
            parts[info.filename] = z.read(info).decode("utf-8", "replace")
        else:
            parts[info.filename] = ""
    return parts


def natural(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def matching(parts: dict[str, str], pattern: str) -> list[str]:
    return sorted((p for p in parts if re.fullmatch(pattern, p)), key=natural)


def read_part(b, name: str, xml: str, spec: Part) -> None:
    """Text of a part to the builder, with its places; properties to the document."""
    inside: Tag | None = None
    owner: Tag | None = None
    for tag in tags(xml):
        if inside and tag.start > inside.end:
            b.push(unescape(xml[inside.end : tag.start]), name, (inside.end, tag.start))
        if owner and tag.start > owner.end:
            b.property(owner.name, name, xml, (owner.end, tag.start))
        inside = owner = None
        if tag.closing:
            if tag.name == "instrText" and tag.name in spec.text:
                b.push(" ")
            if tag.name in spec.lines:
                b.newline()
            continue
        for attribute, span in attributes(xml, tag).items() if spec.attributes else ():
            if attribute in spec.attributes:
                b.property(attribute, name, xml, span)
        if tag.single:
            b.push({"tab": "\t", "br": "\n", "cr": "\n"}.get(tag.name, "") if spec.text else "")
        elif tag.name in spec.text:
            inside = tag
        elif tag.name in spec.elements:
            owner = tag


def read_custom(b, name: str, xml: str) -> None:
    """Properties that users have set."""
    label, before = None, None
    for tag in tags(xml):
        if label is not None and before and not before.closing and not before.single and before.name != "property" and tag.start > before.end:
            b.property(label, name, xml, (before.end, tag.start))
        if tag.name == "property":
            label = None if tag.closing else value(xml, attributes(xml, tag), "name")
        before = tag


def read_links(b, parts: dict[str, str], pattern: str) -> None:
    for name in matching(parts, pattern):
        for tag in tags(parts[name]):
            found = attributes(parts[name], tag) if tag.name == "Relationship" else {}
            if value(parts[name], found, "TargetMode") == "External" and "Target" in found:
                b.newline()
                b.place("link")
                b.push(value(parts[name], found, "Target"), name, found["Target"])
                b.newline()


def read_office(b, kind: str, data: bytes) -> None:
    parts = read_parts(data)
    needed = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml"}.get(kind)
    if needed and needed not in parts:
        raise ValueError(f"{needed} is missing")
    if kind == "xlsx":
        read_workbook(b, parts)
    for spec in PARTS[kind]:
        for name in matching(parts, spec.names):
            b.newline()
            if spec.text:
                number = re.search(r"(\d+)\.xml\Z", name)
                b.place(spec.label.format(n=number[1] if number else ""))
            read_part(b, name, parts[name], spec)
            b.newline()
    read_links(b, parts, LINKS[kind])
    for spec in PROPERTIES:
        for name in matching(parts, spec.names):
            read_part(b, name, parts[name], spec)
    if "docProps/custom.xml" in parts:
        read_custom(b, "docProps/custom.xml", parts["docProps/custom.xml"])
    if kind == "docx" and re.search(r"<w:(?:ins|del)\s", parts[needed]):
        b.doc.warnings.append("tracked changes are left in the file; deleted text is masked too")
    if any("/media/" in p or "/embeddings/" in p for p in parts):
        b.doc.warnings.append("images and embedded files are left as they are")


# ---- workbooks ----


def shared_strings(xml: str) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """Places of the text and of the phonetic text of each shared string."""
    out, phonetic, inside = [], False, None
    for tag in tags(xml):
        if inside and out:
            out[-1][phonetic].append((inside.end, tag.start))
        inside = None
        if tag.name == "si" and not tag.closing:
            out.append(([], []))
        elif tag.name == "rPh":
            phonetic = not tag.closing and not tag.single
        elif tag.name == "t" and not tag.closing and not tag.single:
            inside = tag
    return out


def read_workbook(b, parts: dict[str, str]) -> None:
    """Sheets row by row, then strings that no cell uses. A phonetic text goes with the string that it belongs to."""
    book, targets = parts["xl/workbook.xml"], {}
    links = parts.get("xl/_rels/workbook.xml.rels", "")
    for tag in tags(links):
        found = attributes(links, tag)
        if tag.name == "Relationship":
            target = value(links, found, "Target")
            targets[value(links, found, "Id")] = target[1:] if target.startswith("/") else f"xl/{target}"
    in_order = matching(parts, r"xl/worksheets/sheet\d+\.xml")
    names = []
    for tag in tags(book):
        if tag.name == "sheet" and not tag.closing:
            found = attributes(book, tag)
            part = targets.get(value(book, found, "id")) or (in_order[len(names)] if len(names) < len(in_order) else None)
            names.append((value(book, found, "name"), part))
    source = parts.get("xl/sharedStrings.xml", "")
    shared = shared_strings(source)
    used: set[int] = set()

    def push_shared(i: int) -> None:
        used.add(i)
        for span in shared[i][0]:
            b.push(unescape(source[slice(*span)]), "xl/sharedStrings.xml", span)
        if shared[i][1]:
            b.doc.phonetic.append(("xl/sharedStrings.xml", shared[i][0], shared[i][1]))

    long_numbers = False
    for sheet, part in names:
        if part not in parts:
            continue
        b.newline()
        b.push(f"[シート: {sheet}]\n")
        xml, cell, first, inside = parts[part], {}, True, None
        held: list[tuple[int, int]] = []
        for tag in tags(xml):
            if inside:
                held.append((inside.end, tag.start))
            inside = None
            if tag.name == "row" and not tag.single:
                first = True
                if tag.closing:
                    b.newline()
            elif tag.name == "c" and not tag.closing:
                cell, held = attributes(xml, tag), []
            elif tag.name in ("v", "t") and not tag.closing and not tag.single:
                inside = tag
            elif tag.name == "c":
                kind, content = value(xml, cell, "t"), "".join(xml[slice(*s)] for s in held).strip()
                index = int(content) if kind == "s" and content.isdigit() else -1
                if kind in ("", "n"):
                    long_numbers |= len(content) >= 9 and content.isascii() and content.isdigit()
                if not (0 <= index < len(shared) and shared[index][0]) and not (kind == "inlineStr" and held):
                    continue
                if not first:
                    b.push("\t")
                first = False
                b.place(f"{sheet}!{value(xml, cell, 'r')}")
                if kind == "s":
                    push_shared(index)
                else:
                    for span in held:
                        b.push(unescape(xml[slice(*span)]), part, span)
    rest = [i for i, s in enumerate(shared) if i not in used and s[0]]
    if rest:
        b.newline()
        b.place("shared strings")
    for i in rest:
        push_shared(i)
        b.newline()
    if long_numbers:
        b.doc.warnings.append("long numbers in numeric cells are left as they are")


# ---- writing ----


def changed_nodes(doc, outputs: list[str]) -> dict[str, dict[tuple[int, int], str]]:
    """New content by part and place. A node that several cells show takes the first output that differs."""
    edits: dict[str, dict[tuple[int, int], str]] = {}
    for (s, e, part, a, z), text in zip(doc.nodes, outputs, strict=True):
        if text != doc.text[s:e]:
            edits.setdefault(part, {}).setdefault((a, z), text)
    for part, main, phonetic in doc.phonetic:
        if any(span in edits.get(part, {}) for span in main):
            edits[part] |= dict.fromkeys(phonetic, "")
    return edits


def write_parts(data: bytes, edits: dict[str, dict[tuple[int, int], str]]) -> bytes:
    """The file with these edits; other parts keep their bytes."""
    source, out = zipfile.ZipFile(io.BytesIO(data)), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for info in source.infolist():
            raw = source.read(info)
            if info.filename in edits:
                xml, done, at = raw.decode("utf-8", "replace"), [], 0
                for (a, e), text in sorted(edits[info.filename].items()):
                    if a >= at:
                        done += [xml[at:a], escape(text, {'"': "&quot;"})]
                        at = e
                raw = ("".join(done) + xml[at:]).encode()
            z.writestr(info, raw)
    return out.getvalue()
