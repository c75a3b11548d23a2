"""DuckDB SQL with the rows of a detector's query, written from the catalog by the same rules in another engine."""

from __future__ import annotations

from maskwright.functions.spans import DASHES, DIGIT_BAD, DIGIT_LABELS, IP_LABELS, KANA, three_groups
from maskwright.functions.template import DEFAULT_KEY
from maskwright.functions.validators import COMMON_USERS, NO_DOMAINS, NO_HOSTS, NO_SECRETS
from maskwright.functions.words import PLACES
from maskwright.operators.mask import PLAIN, WIDE
from maskwright.plans.catalog import AFTER, BEFORE, BOOST, BY_ID, DIGITS, HYPHENS, PREFECTURES, Detector

SPACE = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def re2(pattern: str) -> str:
    p = pattern.replace("{DC}", DIGITS).replace("{HC}", HYPHENS).replace("{PREF}", PREFECTURES).replace("(?P<v>", "(?<v>")
    out, inside, i = [], False, 0
    while i < len(p):
        two = p[i : i + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            inside = (inside or p[i] == "[") and p[i] != "]"
            out.append(p[i])
            i += 1
    q = "".join(out)
    return three_groups(q if q.startswith("(?im)") else q.replace("|$)", r"|\z)"))


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, {lit(pattern)})"


def listed(words) -> str:
    return ", ".join(map(lit, words))


def _digits(v: str) -> str:
    return f"regexp_replace(translate({v}, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g')"


D = _digits("v")
N = f"[CAST(c AS INTEGER) FOR c IN string_split({D}, '') IF c <> '']"
LUHN = f"list_sum([CASE WHEN i % 2 = 1 THEN x WHEN 2 * x > 9 THEN 2 * x - 9 ELSE 2 * x END FOR x, i IN list_reverse({N})]) % 10 = 0"
TWO, FOUR = f"TRY_CAST(left({D}, 2) AS INTEGER)", f"TRY_CAST(left({D}, 4) AS INTEGER)"
C = f"regexp_replace(v, '[{SPACE}]', '', 'g')"
REST = (
    f"list_reduce(string_split(substr({C}, 5) || left({C}, 4), ''), lambda r, c: CASE WHEN c BETWEEN '0' AND '9' THEN (r * 10 + ascii(c) - 48) % 97 ELSE (r * 100 + ascii(c) - 55) % 97 END, 0)"
)
#: Conditions on v, and where needed when the verdict is strong.
VALID: dict[str, tuple[str, str]] = {
    "phone_intl": (f"length({D}) BETWEEN 8 AND 15", "false"),
    "iban": (f"length({C}) BETWEEN 15 AND 34 AND regexp_matches({C}, '\\A[0-9A-Z]*\\z') AND {REST} = 1", "true"),
    "high_entropy": (
        r"strlen(v) >= 20 AND CASE WHEN regexp_matches(v, '\A[0-9A-Fa-f]*\z') THEN strlen(v) >= 32 AND regexp_matches(v, '[0-9]') AND list_entropy(string_split(v, '')) >= 3.0 "
        "ELSE regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') AND list_entropy(string_split(v, '')) >= 4.0 END", "false",
    ),
    "us_ssn": (f"length({D}) = 9 AND left({D}, 3) NOT IN ('000', '666') AND {D} NOT LIKE '9%' AND substr({D}, 4, 2) <> '00' AND substr({D}, 6, 4) <> '0000'", "false"),
    "ipv4": (r"NOT regexp_matches(split_part(v, '/', 1), '(^|\.)0[0-9]') AND split_part(v, '/', 1) NOT LIKE '127.%' AND split_part(v, '/', 1) NOT IN ('0.0.0.0', '255.255.255.255')", "false"),
    "ipv6": ("v NOT IN ('::', '::1') AND length(v) - length(replace(v, ':', '')) >= 2 AND (contains(v, '::') OR length(v) - length(replace(v, ':', '')) = 7 OR contains(v, '.')) AND length(regexp_replace(v, '[^0-9A-Fa-f]', '', 'g')) >= 4", "false"),
    "jwt": (r"v LIKE 'eyJ%' AND len(string_split(v, '.')) = 3", "false"),
    "lat_lon": ("abs(coalesce(TRY_CAST(trim(regexp_split_to_array(v, '[,，]')[1]) AS DOUBLE), 999)) <= 90 AND abs(coalesce(TRY_CAST(trim(regexp_split_to_array(v, '[,，]')[2]) AS DOUBLE), 999)) <= 180", "false"),
    "not_placeholder": (
        "NOT " + has("v", r"\A[${<%(\[&:]") + " AND NOT " + has("v", r"\A[A-Za-z_][A-Za-z0-9_.:]+\(") + " AND NOT " + has("v", r"\A[*xX•●]*\z")
        + f" AND lower(v) NOT IN ({listed(NO_SECRETS)})", "false",
    ),
    "not_common_user": (f"lower(trim(v)) NOT IN ({listed(COMMON_USERS)})", "false"),
    "hostname_ok": (f"lower(v) NOT IN ({listed(NO_HOSTS)})", "false"),
    "domain_user": (
        "upper(split_part(v, '\\', 1)) NOT LIKE 'HKEY\\_%' ESCAPE '\\' AND upper(split_part(v, '\\', 1)) NOT IN ("
        + listed(NO_DOMAINS) + ")", "false",
    ),
    "credit_card": (f"length({D}) BETWEEN 13 AND 19 AND {LUHN} AND ({D} LIKE '4%' OR {TWO} BETWEEN 51 AND 55 OR {TWO} IN (34, 37, 36, 38, 39, 65, 62) OR {FOUR} BETWEEN 2221 AND 2720 OR {FOUR} BETWEEN 3528 AND 3589 OR {FOUR} BETWEEN 3000 AND 3059 OR {FOUR} = 6011)", "false"),
    "my_number": (
        f"length({D}) = 12 AND len(list_distinct({N})) > 1 AND (CASE WHEN list_sum([x * (CASE WHEN i <= 6 THEN i + 1 ELSE i - 5 END) FOR x, i IN list_reverse({N}[1:11])]) % 11 <= 1 THEN 0 "
        f"ELSE 11 - list_sum([x * (CASE WHEN i <= 6 THEN i + 1 ELSE i - 5 END) FOR x, i IN list_reverse({N}[1:11])]) % 11 END) = {N}[12]", "false",
    ),
    "corporate_number": (f"length({D}) = 13 AND 9 - list_sum([x * (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END) FOR x, i IN list_reverse({N}[2:13])]) % 9 = {N}[1]", has("v", r"\A\s*[TＴ]")),
    "phone_jp": (
        f"(CASE WHEN v LIKE '+%' THEN {D} LIKE '81%' ELSE {D} LIKE '0%' END) AND regexp_matches(CASE WHEN v LIKE '+%' THEN (CASE WHEN substr({D}, 3) LIKE '0%' THEN '' ELSE '0' END) || substr({D}, 3) ELSE {D} END, "
        + lit(r"\A(?:0[1-9][0-9]{8}|(?:070|080|090|050|060|020)[0-9]{8})\z") + ")", "v LIKE '+%' OR " + has("v", "[^0-9０-９+]"),
    ),
    "address_jp": (has("v", "[0-9０-９一二三四五六七八九十]") + " AND NOT " + has("regexp_extract(v, '(?s)\\A(.*?)[0-9０-９一二三四五六七八九十]', 1)", r"から|まで|では|には|での|より|にて|について|[でにをはがともへや第約計]\z"), "false"),
}

BOUNDARY = {
    "none": "true",
    "alnum": f"NOT {has('b', '[A-Za-z0-9_]$')} AND NOT {has('a', '^[A-Za-z0-9_]')}",
    "digit": f"(NOT {has('b', DIGIT_BAD + '$')} OR {has('b', KANA + '[ーｰ]$')} OR {has('b', rf'(?i)(?:^|[^A-Za-z])(?:{DIGIT_LABELS})$')}) AND (NOT {has('a', '^' + DIGIT_BAD)} OR {has('a', '^[ーｰ]' + KANA)} OR {has('a', rf'(?i)^(?:{DIGIT_LABELS})(?:[^A-Za-z]|$)')})",
    "ip": f"(NOT {has('b', r'[A-Za-z0-9_\-]$')} OR {has('b', rf'(?i)(?:^|[^A-Za-z])(?:{IP_LABELS})$')}) AND NOT {has('a', r'^[A-Za-z0-9_\-]')} AND NOT {has('b', r'[0-9]\.$')} AND NOT {has('a', r'^\.[A-Za-z0-9]')}",
    "hex": f"NOT {has('b', '[A-Za-z0-9_:]$')} AND NOT {has('a', '^[A-Za-z0-9_:]')}",
    "path": f"NOT {has('b', r'[A-Za-z0-9_\\/:.]$')} AND NOT {has('a', '^[A-Za-z0-9_]')}",
}
BOUNDARY = {k: v.replace("$')", r"\z')").replace("'^", r"'\A").replace("(?i)^", r"(?i)\A").replace("(?:^|", r"(?:\A|").replace("|$)')", r"|\z)')") for k, v in BOUNDARY.items()}
assert DASHES


def expressible(d: Detector) -> bool:
    return bool(d.patterns) and (not d.validator or d.validator in VALID)


def refined(kind: str) -> str:
    """The steps that refiners take with s and v."""
    if kind == "phone_trailing_group":
        return r"SELECT * REPLACE (regexp_replace(v, '([\-.][^ \-.]*) [^ \-.]*\z', '\1') AS v) FROM placed"
    if kind == "drop_leading_date_unit":
        unit = r"(regexp_matches(v, '\A[年月日時分秒]') AND s > 0 AND regexp_matches(substr(text, s, 1), '[0-9０-９]'))"
        return f"SELECT * REPLACE (CASE WHEN {unit} THEN substr(v, 2) ELSE v END AS v, CASE WHEN {unit} THEN s + 1 ELSE s END AS s) FROM placed"
    if kind == "city_leading_place":
        head = r"regexp_extract(v, '\A([^市区町村郡]*)[市区町村郡]', 1)"
        known = ", ".join(map(lit, sorted(PLACES)))
        cut = f"coalesce(list_min([k FOR k IN range(0, length({head})::INTEGER) IF length({head}) - k >= 2 AND substr({head}, k + 1) IN ({known})]), 0)::INTEGER"
        return f"SELECT * REPLACE (substr(v, {cut} + 1) AS v, s + {cut} AS s) FROM placed"
    return "SELECT * FROM placed"


def detector_sql(id_: str, source: str = "SELECT doc_id, text FROM documents", least: float = 0.5) -> str:
    """doc_id, start, end, confidence, value of a detector's candidates at least as sure as `least`, over a subquery of doc_id and text."""
    d = BY_ID[id_]
    ok, strong = VALID[d.validator] if d.validator else ("true", "false")
    near = has(f"substr(text, greatest(s - {BEFORE}, 0) + 1, e + {AFTER} - greatest(s - {BEFORE}, 0))", "(?i)" + "|".join(d.context)) if d.context else "false"
    return f"""
WITH src AS (SELECT doc_id, coalesce(text, '') AS text FROM ({source})),
found AS ({matches([(re2(p), c) for p, c in d.patterns])}),
{PLACED},
fine AS ({refined(d.refine)}),
trimmed AS ({"SELECT * REPLACE (regexp_replace(v, '[.,;:!?)" + chr(92) + "]}''" + chr(34) + "]+" + chr(92) + "z', '') AS v) FROM fine" if d.trim else "SELECT * FROM fine"}),
ends AS (SELECT *, CAST(s + length(v) AS INTEGER) AS e FROM trimmed WHERE length(v) > 0),
sides AS (SELECT *, substr(text, greatest(s - 40, 0) + 1, least(s, 40)) AS b, substr(text, e + 1, 40) AS a FROM ends),
good AS (SELECT *, {near} AS near, ({strong}) AS strong FROM sides WHERE ({BOUNDARY[d.boundary]}) AND ({ok})),
sure AS (SELECT *, round(CASE WHEN strong THEN greatest(CASE WHEN near THEN least(base + {BOOST}, 1.0) ELSE base END, 0.9) WHEN near THEN least(base + {BOOST}, 1.0) ELSE base END, 4)::DOUBLE AS confidence
  FROM good WHERE {"near OR strong" if d.required else "true"})
SELECT doc_id, s::INTEGER AS "start", e AS "end", confidence, v AS value FROM sure WHERE confidence >= {least}
"""


def matches(patterns: list[tuple[str, float]]) -> str:
    """What patterns of three groups match: whole matches, heads, values, and the text between matches. Texts without a match are left out first."""
    one = "SELECT doc_id, text, {c} AS base, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, 1) AS h, regexp_extract_all(text, {p}, 2) AS vs, regexp_split_to_array(text, {p}) AS g FROM src WHERE regexp_matches(text, {p})"
    return " UNION ALL ".join(one.format(c=c, p=lit(p)) for p, c in patterns)


PLACED = """each AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM found WHERE len(m) > 0),
placed AS (SELECT doc_id, text, base, vs[i] AS v, CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) + length(h[i]) AS INTEGER) AS s FROM each)"""


def pattern_sql(pattern: str, source: str, confidence: float = 0.9) -> str:
    """doc_id, text, start, end, confidence, value of a pattern (with a group v or without), without any test."""
    return f"""
WITH src AS (SELECT doc_id, coalesce(text, '') AS text FROM ({source})),
found AS ({matches([(three_groups(pattern), confidence)])}),
{PLACED}
SELECT doc_id, text, s AS "start", CAST(s + length(v) AS INTEGER) AS "end", base::DOUBLE AS confidence, v AS value FROM placed WHERE length(v) > 0
"""


def line(text: str, at: str) -> str:
    return f"CAST(length(left({text}, {at})) - length(replace(left({text}, {at}), chr(10), '')) + 1 AS INTEGER)"


def column(text: str, at: str) -> str:
    return f"CAST(length(regexp_extract(left({text}, {at}), '[^\\n]*\\z')) + 1 AS INTEGER)"


def normalized(v: str) -> str:
    t = f"CASE WHEN strlen({v}) = length({v}) THEN {v} ELSE translate({v}, {lit(WIDE)}, {lit(PLAIN)}) END"
    digits = "regexp_replace(t, '[^0-9]', '', 'g')"
    letters = "length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g'))"
    return f"[CASE WHEN length({digits}) >= 6 AND length({digits}) * 10 >= {letters} * 8 THEN {digits} ELSE lower(regexp_replace(t, '[\\s\\x0B]', '', 'g')) END FOR t IN [{t}]][1]"


class Catalog:
    """SQL over all spans of some detectors: candidates, what overlaps leave, numbers, and the masked text.

    source: a subquery of doc_id and text. least: the confidence from which on a candidate counts."""

    def __init__(self, ids: list[str], source: str = "SELECT doc_id, text FROM documents", least: float = 0.5):
        self.ids, self.source, self.least = ids, source, least

    def with_(self, *more: str) -> str:
        """The common part: src, cand, meta, span (doc_id, text, det, s, e, conf, v), and more."""
        rows = ", ".join(f"({i}, {lit(x)}, {lit((d := BY_ID[x]).category)}, {lit(d.label)}, {lit(d.label_ja)}, {lit(d.name_en)}, {d.priority})" for i, x in enumerate(self.ids))
        cand = " UNION ALL ".join(f'SELECT doc_id, {i} AS det, "start" AS s, "end" AS e, confidence AS conf, value AS v FROM ({detector_sql(x, "SELECT * FROM source", self.least)})' for i, x in enumerate(self.ids))
        parts = [
            f"source AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM ({self.source}))",
            f"meta(det, id, category, label, label_ja, name, priority) AS (VALUES {rows})",
            f"cand AS MATERIALIZED ({cand})",
            "ranked AS (SELECT doc_id, list({'det': det, 's': s, 'e': e, 'conf': conf, 'v': v} ORDER BY priority DESC, conf DESC, e - s DESC, s, det) AS l FROM cand JOIN meta USING (det) GROUP BY doc_id)",
            "picked AS (SELECT doc_id, unnest(list_reduce(l, lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.s < x.e AND k.e > x.s)) > 0 THEN kept ELSE list_append(kept, x) END, "
            "[]::STRUCT(det INTEGER, s INTEGER, e INTEGER, conf DOUBLE, v VARCHAR)[])) AS k FROM ranked)",
            "span AS MATERIALIZED (SELECT p.doc_id, text, k.det, k.s, k.e, k.conf, k.v, id, category, label, label_ja, name, priority FROM picked p JOIN source USING (doc_id) JOIN meta ON meta.det = k.det)",
            *more,
        ]
        return "WITH " + ",\n".join(parts)

    def candidates(self) -> str:
        return self.with_() + ' SELECT doc_id, s AS "start", e AS "end", conf AS confidence, v AS value FROM cand'

    def spans(self, select: str) -> str:
        return f"{self.with_()} SELECT {select} FROM span"

    def numbers(self, shared: bool) -> str:
        """numbered: spans with norm and n, by first appearance in the document or over all of them."""
        scope, order = ("", "doc_id, s, det") if shared else ("doc_id, ", "s")
        return (
            f"normed AS (SELECT *, {normalized('v')} AS norm FROM span), firsts AS (SELECT {scope}label, norm, min({{'d': doc_id, 's': s, 'k': det}}) AS f FROM normed GROUP BY ALL), "
            f"order_ AS (SELECT * EXCLUDE (f), CAST(row_number() OVER (PARTITION BY {scope}label ORDER BY f) AS INTEGER) AS n FROM firsts), "
            f"numbered AS (SELECT normed.*, n FROM normed JOIN order_ USING ({scope}label, norm))"
        )

    def masked(self, replacement: str, select: str = "doc_id, masked, n", shared: bool | None = False) -> str:
        """A row for each document with its masked text and n, the number of spans. replacement may read label, v, n and id."""
        more = [self.numbers(bool(shared))] if shared is not None else ["numbered AS (SELECT *, 0 AS n FROM span)"]
        pieces = (
            f"piece AS (SELECT doc_id, s, e, {replacement} AS r, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS frm, text FROM numbered), "
            "joined AS (SELECT doc_id, string_agg(substr(text, frm + 1, s - frm) || r, '' ORDER BY s) || substr(any_value(text), max(e) + 1) AS masked, CAST(count(*) AS INTEGER) AS n FROM piece GROUP BY doc_id), "
            "done AS (SELECT source.doc_id, source.text, coalesce(masked, source.text) AS masked, coalesce(n, 0) AS n FROM source LEFT JOIN joined USING (doc_id))"
        )
        return f"{self.with_(*more, pieces)} SELECT {select} FROM done"


def shape(v: str, mark: str, keep: int) -> str:
    letter, other = r"'[\p{L}\p{N}]'", r"'[^\p{L}\p{N}]'"
    return f"array_to_string([CASE WHEN regexp_matches(c, {letter}) AND length(regexp_replace(substr({v}, i + 1), {other}, '', 'g')) >= {keep} THEN {lit(mark)} ELSE c END FOR c, i IN string_split({v}, '')], '')"


def hmac_hex(message: str, key: str = DEFAULT_KEY) -> str:
    k = key.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in k).hex() for pad in (0x36, 0x5C))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"
