"""Japanese companies: a legal form is the anchor, and the name is read word by word on either side of it.

The text between two legal forms belongs to both. On the left the nearest words are read until something that can't be
in a name; if a name is left, it ends with the form. Otherwise the name is on the right. What stops a name there (a form
of address, a title, a unit) may be followed by a person, who is returned too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from maskwright.functions import words as W

HAN = "一-鿿㐀-䶿豈-﫿々〆ヶ"
LETTERS = f"{HAN}ァ-ヿｦ-ﾟA-Za-z0-9０-９Ａ-Ｚａ-ｚ&＆"
WORD = re.compile(f"[{LETTERS}]+(?:[\\-.'’－．][{LETTERS}]+)*")
FORM = re.compile("|".join(map(re.escape, sorted(W.LEGAL_FORMS, key=len, reverse=True))))
STOP = re.compile("|".join(map(re.escape, sorted([*W.ADDRESS_TERMS, *W.TITLES, *W.ORG_UNITS, *W.UNIT_KANJI], key=len, reverse=True))))
DATE = re.compile(r"(?:[0-9０-９]+[年月日度]+)+")
LEADING = re.compile("(?:" + "|".join(sorted(W.NOT_COMPANY, key=len, reverse=True)) + ")+")
MOST_WORDS, MOST_CHARS = 4, 30
ADDRESS, TITLE, UNIT = "address", "title", "unit"


def _words(text: str, low: int, high: int) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(text, low, high)]


def _joined(text: str, a: int, b: int) -> bool:
    """Nothing or one space between two places."""
    return text[a:b] in ("", " ", "　")


def _ends(word: str) -> bool:
    return word.lower() in W.FUNCTION_WORDS or word in W.NOT_COMPANY


def _left(text: str, low: int, end: int) -> list[tuple[int, int]]:
    """Words before a form, the nearest first."""
    out, at = [], end
    for s, e in reversed(_words(text, low, end)):
        s = max(s, e - MOST_CHARS)
        if len(out) == MOST_WORDS or not _joined(text, e, at) or _ends(text[s:e]):
            break
        out.append((s, e))
        at = s
    return out


def _right(text: str, start: int, high: int) -> list[tuple[int, int]]:
    """Words after a form, the nearest first."""
    out, at = [], start
    for s, e in _words(text, start, high):
        if len(out) == MOST_WORDS or not _joined(text, at, s) or (not out and s != start) or _ends(text[s:e]):
            break
        e = min(e, s + MOST_CHARS)
        out.append((s, e))
        at = e
    return out


def unit_start(lx, text: str, low: int, at: int) -> int | None:
    """Where the department or place before a unit begins; None if there is none, and then it is no unit."""
    head = text[low:at]
    names = [d for d in W.DEPARTMENTS if head.endswith(d)]
    if names:
        return at - len(max(names, key=len))
    return next((at - n for n in range(min(5, len(head)), 1, -1) if head[-n:] in lx.places), None)


def stops(lx, text: str, s: int, e: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what a name can't hold, in a word."""
    low = at = s
    while m := STOP.search(text, at, e):
        found = m[0]
        begin = unit_start(lx, text, low, m.start())
        if found in W.ADDRESS_TERMS:
            kind, begin = ADDRESS, m.start()
        elif found in W.TITLES:
            kind, begin = TITLE, m.start() if begin is None else begin
        elif begin is not None:
            kind = UNIT
        else:
            at = m.start() + 1
            continue
        yield begin, m.end(), kind
        low = at = m.end()


def _person(lx, text: str, s: int, e: int, least: int, before: str | None, after: str | None) -> tuple[int, float] | None:
    """Where a person at the end of s to e begins, and how sure it is."""
    run = re.search(f"[{HAN}]*\\Z", text[s:e])
    for i in range(max(s + run.start(), least), e):
        name = text[i:e]
        if lx.split(name):
            return i, 0.75
        if len(name) >= 2 and name in lx.surnames:
            if after in (ADDRESS, TITLE):
                return i, 0.85
            if i == s and before in (TITLE, UNIT):
                return i, 0.7
    return None


def _read(lx, text: str, words: list[tuple[int, int]], named: bool) -> tuple[int | None, list[tuple[int, int, float]]]:
    """Where the name in these words ends, and the persons after it. named: the first word begins with the name."""
    people: list[tuple[int, int, float]] = []
    whole = words[0][0] if words else None  # the end of the words that are all name
    end = None
    for k, (s, e) in enumerate(words):
        marks = [*stops(lx, text, s, e), (e, e, None)]
        at, before = s, None
        for begin, stop, kind in marks:
            if begin > at:
                least = at + 1 if named and k == 0 and at == s and end is None else at
                if found := _person(lx, text, at, begin, least, before, kind):
                    people.append((found[0], begin, found[1]))
                    if end is None:
                        end = found[0] if found[0] > s else whole
            if kind and end is None:
                end = begin if begin > s else whole
            at, before = stop, kind
        if end is None:
            whole = e
    return (whole if end is None else end), people


def _trimmed(lx, text: str, words: list[tuple[int, int]]) -> int | None:
    """Where a name that ends with the first of these words begins: without forms of address, dates and words like 'our company'."""
    if not words:
        return None
    s, e = words[-1]
    for _, stop, _ in stops(lx, text, s, e):
        s = max(s, stop)
    for m in DATE.finditer(text, s, e):
        s = m.end()
    while (m := LEADING.match(text, s, e)) and s < e:
        stop = next((s + len(w) for w in sorted(W.NOT_COMPANY, key=len, reverse=True) if text.startswith(w, s)), s)
        if stop >= e:
            break
        s = stop
    while text[s : s + 1] in (" ", "　"):
        s += 1
    end = words[0][1]
    return s if s < end and re.search(f"[{LETTERS}]", re.sub("[0-9０-９]", "", text[s:end])) else None


def _letters(text: str) -> int:
    return sum(1 for c in text if re.match(f"[{LETTERS}]", c))


def analyze(lx, text: str) -> tuple[list[tuple[int, int, float]], list[tuple[int, int, float]]]:
    """Companies and the persons after them: (start, end, confidence)."""
    forms = [m.span() for m in FORM.finditer(text)]
    firms, people = [], []
    for k, (s, e) in enumerate(forms):
        low, high = forms[k - 1][1] if k else 0, forms[k + 1][0] if k + 1 < len(forms) else len(text)
        begin = _trimmed(lx, text, _left(text, low, s))
        start = e if begin is not None or text[e : e + 1] not in (" ", "　") else e + 1
        end, found = _read(lx, text, _right(text, start, high), begin is None)
        people += found
        named = end is not None and end > start and _letters(text[start:end]) >= 2
        if begin is not None:  # if there is a name on both sides, both go
            firms.append((begin, end if named else e, 0.8))
        elif named:
            firms.append((s, end, 0.85))
    return firms, people
