"""Search: literal or pattern queries over texts, with places and snippets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import spans as S

#: Most hits of a text that a listing shows, and that a document view shows.
HITS, HITS_IN_DOCUMENT, NO_LIMIT = 200, 10_000, 2**31 - 1


@dataclass(frozen=True)
class Query:
    text: str
    case: bool = False
    pattern: bool = False

    @property
    def empty(self) -> bool:
        return not self.text

    def java(self) -> str:
        """The query as a Java pattern; ^ and $ stand for line ends. Raises ValueError for a pattern that can't be read."""
        if self.pattern:
            try:
                re.compile(self.text.replace(r"\z", r"\Z"))
            except re.error as e:
                raise ValueError(str(e)) from None
            return ("(?md)" if self.case else "(?imdu)") + self.text
        quoted = re.sub(r"([\\.\[\]{}()*+?^$|\-#&~])", r"\\\1", self.text)
        return quoted if self.case else "(?iu)" + quoted


def matches(q: Query, value: Column) -> Column:
    """Whether a value matches; an empty query matches all."""
    return F.lit(True) if q.empty else value.rlike(q.java())


def find(q: Query, column: str, limit: int = HITS) -> tuple[Column, Column]:
    """(array<struct<start, end>> of at most limit hits in a column, whether there are more)."""
    from maskwright.plans.engine import rule_pattern

    java = q.java()
    flags = re.match(r"\(\?[imdsu]+\)", java)
    front = flags[0] if flags else ""
    hits = S.pattern_spans(column, front + (rule_pattern(java[len(front) :], "-") if q.pattern else java[len(front) :]), 1.0)
    hits = F.transform(F.filter(hits, lambda x: x["end"] > x["start"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.slice(hits, 1, limit), F.size(hits) > limit


def snippet(text: Column, start: Column, end: Column, around: int = 30) -> Column:
    """One line around a hit, with an ellipsis where it is cut."""
    a, b = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(text))
    line = F.regexp_replace(F.substring(text, a + 1, b - a), r"[\r\n\t]", " ")
    return F.concat(F.when(a > 0, "…").otherwise(""), line, F.when(b < F.length(text), "…").otherwise(""))


def search(df: DataFrame, q: Query, key: str, text_col: str = "text", limit: int = HITS, around: int = 30) -> DataFrame:
    """key, start, end, line, column, snippet, truncated: a row for each hit. Texts without one are left out before their hits are placed."""
    if q.empty:
        return df.select(key, *[F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("end", "int"), ("line", "int"), ("column", "int"), ("snippet", "string"), ("truncated", "boolean"))]).limit(0)
    some = S.once(df.filter(F.col(text_col).rlike(q.java())).select(key, text_col), "__t", S.clean(F.col(text_col)))
    hits, more = find(q, "__t", limit)
    held = S.once(some, "__h", F.struct(hits.alias("hits"), more.alias("truncated")))
    x = held.select(key, "__t", F.explode("__h.hits").alias("x"), F.col("__h.truncated").alias("truncated"))
    t, at = F.col("__t"), F.col("x.start")
    return x.select(key, at.alias("start"), F.col("x.end").alias("end"), S.line_of(t, at).alias("line"), S.column_of(t, at).alias("column"), snippet(t, at, F.col("x.end"), around).alias("snippet"), "truncated")


def totals(df: DataFrame, q: Query, text_col: str = "text") -> DataFrame:
    """hits, files: a single row, over all hits, however many a listing shows of a text."""
    if q.empty:
        per = df.select(F.lit(0).alias("n"))
    else:
        some = S.once(df.filter(F.col(text_col).rlike(q.java())).select(text_col), "__t", S.clean(F.col(text_col)))
        per = some.select(F.size(find(q, "__t", NO_LIMIT)[0]).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("hits"), F.count_if(F.col("n") > 0).alias("files"))
