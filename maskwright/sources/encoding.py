"""Text encodings: guessing, decoding and encoding of whole files, one value at a time."""

from __future__ import annotations

import codecs

# Labels of encodings; (codec, byte order mark).
LABELS = {
    "utf-8": ("utf-8", False), "utf8": ("utf-8", False), "utf-8-bom": ("utf-8", True), "utf8-bom": ("utf-8", True), "utf-8-sig": ("utf-8", True),
    "utf-16": ("utf-16-le", True), "utf-16le": ("utf-16-le", True), "utf-16be": ("utf-16-be", True), "utf16le": ("utf-16-le", True), "utf16be": ("utf-16-be", True),
    "shift_jis": ("cp932", False), "sjis": ("cp932", False), "shift-jis": ("cp932", False), "cp932": ("cp932", False), "ms932": ("cp932", False), "windows-31j": ("cp932", False),
    "euc-jp": ("euc_jp", False), "eucjp": ("euc_jp", False), "iso-2022-jp": ("iso2022_jp", False), "jis": ("iso2022_jp", False),
    "windows-1252": ("cp1252", False), "latin1": ("latin-1", False), "iso-8859-1": ("latin-1", False), "ascii": ("ascii", False),
}
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def label(name: str) -> tuple[str, bool]:
    try:
        return LABELS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown encoding {name}") from None


def sniff_utf16(data: bytes) -> str | None:
    """UTF-16 without a mark: text in Latin letters has zeros at every other byte."""
    head = data[:4096]
    head = head[: len(head) // 2 * 2]
    if len(head) < 4:
        return None
    n = len(head) / 2
    even, odd = head[::2].count(0) / n, head[1::2].count(0) / n
    return "utf-16-le" if odd > 0.4 and even < 0.1 else "utf-16-be" if even > 0.4 and odd < 0.1 else None


def decode(data: bytes, forced: str | None = None) -> tuple[str, str, bool]:
    """(text, codec, byte order mark). Order: mark, UTF-16 by its zeros, escape sequences of
    ISO-2022-JP, UTF-8, other Japanese encodings, then Latin-1."""
    if forced and forced != "auto":
        codec, _ = label(forced)
        mark = next((m for m, c in MARKS if c == codec and data.startswith(m)), b"")
        return data[len(mark) :].decode(codec, "replace"), codec, bool(mark)
    for mark, codec in MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(codec, "replace"), codec, True
    if codec := sniff_utf16(data):
        return data.decode(codec, "replace"), codec, False
    for codec in ("iso2022_jp", "utf-8", "euc_jp", "cp932", "cp1252"):
        if codec == "iso2022_jp" and b"\x1b$" not in data and b"\x1b(" not in data:
            continue
        try:
            text = data.decode(codec)
        except UnicodeDecodeError:
            continue
        if codec == "euc_jp" and _halfwidth(text) > 0.2:
            continue
        return text, codec, False
    return data.decode("latin-1"), "latin-1", False


def _halfwidth(text: str) -> float:
    wide = [c for c in text if ord(c) > 127]
    return sum("｡" <= c <= "ﾟ" for c in wide) / max(1, len(wide))


def encode(text: str, codec: str, mark: bool = False) -> bytes:
    """Characters that the encoding lacks become numeric references."""
    data = text.encode(codec, "xmlcharrefreplace")
    return next((m for m, c in MARKS if c == codec), b"") + data if mark else data
