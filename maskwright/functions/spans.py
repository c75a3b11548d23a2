"""Spans as column expressions: where a pattern matches, and the tests that a match has to pass.

Spark has no regular-expression function that returns offsets. One regexp_replace puts noncharacters around the head,
the value and the tail of each match; the pieces between them, taken in order, give every offset by running sums. Text
is scanned once for each pattern, and only where what the pattern needs is present. Offsets are code points, from 0, end
exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Noncharacters: they cannot be in valid interchange text; clean() replaces them if they are.
OPEN, VALUE, CLOSE = "\uFDD0", "\uFDD1", "\uFDD2"
FOUND = "array<struct<start:int,end:int,conf:double,det:int>>"
LOOK = 40


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row. The optimizer would otherwise write value out wherever later
    columns read it, and it is long; it does not look through a generator of one row."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def clean(text: Column) -> Column:
    """The text without the marks that spans() inserts; null becomes empty. Marks are looked for in bytes, without decoding the text."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(OPEN) | t.contains(VALUE) | t.contains(CLOSE), F.translate(t, OPEN + VALUE + CLOSE, "�" * 3)).otherwise(t)


def three_groups(pattern: str) -> str:
    """The pattern with group 1 before the value, group 2 the value and group 3 the rest; flags stay in front."""
    flags = re.match(r"\(\?[imdsu]+\)", pattern)
    front, rest = (flags[0], pattern[len(flags[0]) :]) if flags else ("", pattern)
    at = rest.find("(?<v>")
    if at < 0:
        return f"{front}()({rest})()"
    depth, i, inside = 0, at, False
    while True:
        c = rest[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif not inside and c in "()":
            depth += 1 if c == "(" else -1
            if depth == 0:
                break
        i += 1
    return f"{front}({rest[:at]})({rest[at + 5 : i]})({rest[i + 1 :]})"


def empty() -> Column:
    return F.array().cast(FOUND)


def sql_text(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Pieces that one fold goes through. A fold copies what it has gathered at each step, so long texts go in chunks.
CHUNK = 128


def pattern_sql(column: str, pattern: str, conf: float, det: int = 0) -> str:
    """SQL for array<struct<start, end, conf, det>> of a Java pattern's values in a column: as a tree of columns it would take
    hundreds of calls into the JVM. Chunks of pieces are folded on their own, from the offsets that the chunks before add up to."""
    marked = f"regexp_replace({column}, {sql_text(three_groups(pattern))}, {sql_text(f'{OPEN}$1{VALUE}$2{CLOSE}$3')})"
    none = f"cast(array() AS {FOUND})"
    head = f"length(substring_index(x, '{VALUE}', 1))"
    value = f"length(substring_index(substring_index(x, '{CLOSE}', 1), '{VALUE}', -1))"
    span = f"named_struct('start', acc.at + {head}, 'end', acc.at + {head} + {value}, 'conf', {float(conf)!r}D, 'det', {det})"
    fold = f"aggregate(c, named_struct('at', a, 'out', {none}), (acc, x) -> named_struct('at', acc.at + length(x) - 2, 'out', array_append(acc.out, {span})), acc -> acc.out)"
    sums = "transform(cs, c -> aggregate(c, 0, (n, x) -> n + length(x) - 2))"
    begins = f"aggregate({sums}, named_struct('at', length(p[0]), 'out', cast(array() AS array<int>)), (acc, n) -> named_struct('at', acc.at + n, 'out', array_append(acc.out, acc.at)), acc -> acc.out)"
    chunks = f"transform(sequence(0, (size(p) - 2) div {CHUNK}), i -> slice(p, cast(i * {CHUNK} + 2 AS int), {CHUNK}))"
    many = f"transform(array({chunks}), cs -> flatten(zip_with(cs, {begins}, (c, a) -> {fold})))[0]"
    return f"transform(array({marked}), m -> CASE WHEN contains(m, '{OPEN}') THEN transform(array(split(m, '{OPEN}', -1)), p -> {many})[0] ELSE {none} END)[0]"


def pattern_spans(column: str, pattern: str, conf: float) -> Column:
    return F.expr(pattern_sql(column, pattern, conf))


def value_of(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def before(text: Column, at: Column, n: int = LOOK) -> Column:
    """Up to n characters before an offset."""
    return F.substring(text, F.greatest(at - n, F.lit(0)) + 1, F.least(at, F.lit(n)))


def after(text: Column, at: Column, n: int = LOOK) -> Column:
    return F.substring(text, at + 1, F.lit(n))


# What may not stand beside a match, and labels that may.
DASHES = r"\-‐‑–—―−ー－ｰ"
DIGIT_BAD = rf"[0-9０-９A-Za-z_{DASHES}]"
KANA = "[ァ-ヺｦ-ﾝ]"
DIGIT_LABELS, IP_LABELS = "tel|fax|phone|mobile|mob|cell", "ip|ipv4|ipaddr|addr"


def _bare(side: Column, bad: str, end: bool) -> Column:
    """No bad character next to the match."""
    return ~side.rlike(rf"{bad}\z" if end else rf"\A{bad}")


def _label_before(side: Column, labels: str) -> Column:
    return side.rlike(rf"(?i)(?:\A|[^A-Za-z])(?:{labels})\z")


BOUNDARIES: dict[str, Callable[[Column, Column], Column]] = {
    "alnum": lambda b, a: _bare(b, "[A-Za-z0-9_]", True) & _bare(a, "[A-Za-z0-9_]", False),
    "digit": lambda b, a: (
        (_bare(b, DIGIT_BAD, True) | b.rlike(rf"{KANA}[ーｰ]\z") | _label_before(b, DIGIT_LABELS))
        & (_bare(a, DIGIT_BAD, False) | a.rlike(rf"\A[ーｰ]{KANA}") | a.rlike(rf"(?i)\A(?:{DIGIT_LABELS})(?![A-Za-z])"))
    ),
    "ip": lambda b, a: (
        (_bare(b, r"[A-Za-z0-9_\-]", True) | _label_before(b, IP_LABELS))
        & _bare(a, r"[A-Za-z0-9_\-]", False) & ~b.rlike(r"[0-9]\.\z") & ~a.rlike(r"\A\.[A-Za-z0-9]")
    ),
    "hex": lambda b, a: _bare(b, "[A-Za-z0-9_:]", True) & _bare(a, "[A-Za-z0-9_:]", False),
    "path": lambda b, a: _bare(b, r"[A-Za-z0-9_\\/:.]", True) & _bare(a, "[A-Za-z0-9_]", False),
}


def has_context(text: Column, span: Column, words: tuple[str, ...], back: int, ahead: int) -> Column:
    """A context word within the window around the span; ASCII letters in either case."""
    begin = F.greatest(span["start"] - back, F.lit(0))
    window = F.substring(text, begin + 1, span["end"] + ahead - begin)
    return window.rlike("(?i)" + "|".join(re.escape(w) for w in words))


def line_of(text: Column, at: Column) -> Column:
    """1-based line of an offset."""
    head = F.substring(text, F.lit(1), at)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1).cast("int")


def column_of(text: Column, at: Column) -> Column:
    """1-based column of an offset, in code points."""
    return (F.length(F.substring_index(F.substring(text, F.lit(1), at), "\n", -1)) + 1).cast("int")


def bytes_before(text: Column, at: Column) -> Column:
    """The UTF-8 byte offset of a code point offset."""
    return F.octet_length(F.substring(text, F.lit(1), at))
