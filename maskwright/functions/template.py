"""Replacement templates: parsed on the driver, rendered as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_KEY = "maskwright"
#: Splits a string into characters, without an empty one at the end.
CHARACTERS = r"(?!\A)(?!\z)"

# Ready-made templates, (template, description).
PRESETS = (
    ("<{label}_{n}>", "Numbered tag"),
    ("[{label}]", "Tag"),
    ("[{label_ja}]", "Japanese tag"),
    ("{fill:*}", "Fill with *"),
    ("{fill:●}", "Fill with ●"),
    ("{fill:█}", "Black bar"),
    ("{fill:*:8}", "Fixed ********"),
    ("{shape:*}", "Keep separators"),
    ("{shape:*:4}", "Keep last 4"),
    ("{label}_{hash:8}", "Hash"),
    ("{fake}", "Fake value"),
    ("■", "Single mark"),
    ("[REDACTED]", "Fixed word"),
)
#: Arguments of each variable with their defaults; None: no argument.
VARIABLES = {"label": (), "label_ja": (), "category": (), "category_ja": (), "id": (), "n": (), "len": (), "fake": (), "hash": (8,), "prefix": (1,), "suffix": (4,), "fill": ("*", -1), "shape": ("*", 0)}


class TemplateError(ValueError):
    """kind: unclosed, unknown or argument."""

    def __init__(self, kind: str, what: str):
        super().__init__(f"{kind}: {what}")
        self.kind = kind


@dataclass(frozen=True)
class Template:
    source: str
    parts: tuple[tuple[str, tuple], ...]

    @property
    def numbered(self) -> bool:
        """Whether rendering needs the number of a value."""
        return any(name in ("n", "fake") for name, _ in self.parts)


def parse(source: str) -> Template:
    parts: list[tuple[str, tuple]] = []
    literal, i = "", 0
    while i < len(source):
        c = source[i]
        if source[i : i + 2] in ("{{", "}}"):
            literal += c
            i += 2
        elif c == "{":
            end = source.find("}", i)
            if end < 0:
                raise TemplateError("unclosed", source)
            if literal:
                parts.append(("text", (literal,)))
                literal = ""
            parts.append(_variable(source[i + 1 : end]))
            i = end + 1
        else:
            literal += c
            i += 1
    if literal:
        parts.append(("text", (literal,)))
    return Template(source, tuple(parts))


def _variable(inner: str) -> tuple[str, tuple]:
    name, *given = inner.split(":", 2)
    name = name.strip()
    if name not in VARIABLES:
        raise TemplateError("unknown", name)
    args = []
    for k, default in enumerate(VARIABLES[name]):
        if k >= len(given) or (isinstance(default, str) and not given[k]):
            args.append(default)
        elif isinstance(default, str):
            args.append(given[k])
        else:
            try:
                args.append(int(given[k].strip()))
            except ValueError:
                raise TemplateError("argument", inner) from None
            if args[-1] < 0:
                raise TemplateError("argument", inner)
    if name == "hash":
        args[0] = min(max(args[0], 1), 64)
    return name, tuple(args)


def hmac_hex(key: str, message: Column) -> Column:
    """HMAC-SHA-256 in hex, from two SHA-256 with the key's pads folded into literals."""
    import hashlib

    k = (key or DEFAULT_KEY).encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


LETTER = r"[\p{L}\p{N}]"


def shape(value: Column, mark: str, keep: int) -> Column:
    """Letters and digits become mark, but for the last keep of them; the rest stays."""
    tail = rf"(?=(?:[^\p{{L}}\p{{N}}]*{LETTER}){{{keep}}})" if keep else ""
    return F.regexp_replace(value, LETTER + tail, mark.replace("\\", "\\\\").replace("$", "\\$"))


def preserving(value: Column, key: str, label: Column) -> Column:
    """Digits for digits and letters for letters of the same case, drawn from an HMAC stream; other letters become ○."""
    seed = hmac_hex(key, F.concat(label, F.lit(":"), value))

    def step(acc, c):
        used = acc["used"] >= 64
        seed_ = F.when(used, hmac_hex(key, F.concat(label, F.lit(":"), acc["seed"]))).otherwise(acc["seed"])
        at = F.when(used, 0).otherwise(acc["used"])
        draw = F.ascii(F.substring(seed_, at + 1, F.lit(1)))
        kind = lambda first, n: F.chr((F.lit(ord(first)) + draw % n).cast("long"))
        wide = F.element_at(F.array(*[F.lit(x) for x in "０１２３４５６７８９"]), (draw % 10 + 1).cast("int"))
        drawn = F.when(c.rlike("[0-9]"), kind("0", 10)).when(c.rlike("[０-９]"), wide).when(c.rlike("[a-z]"), kind("a", 26)).when(c.rlike("[A-Z]"), kind("A", 26))
        out = F.coalesce(drawn, F.when(c.rlike(r"\p{L}"), F.lit("○")).otherwise(c))
        return F.struct(
            F.concat(acc["out"], out).alias("out"), (at + F.when(drawn.isNotNull(), 1).otherwise(0)).cast("int").alias("used"), seed_.alias("seed")
        )

    return F.aggregate(F.split(value, CHARACTERS), F.struct(F.lit("").alias("out"), F.lit(0).alias("used"), seed.alias("seed")), step, lambda acc: acc["out"])


def fake(value: Column, id_: Column, n: Column, key: str, label: Column) -> Column:
    """A value that cannot be real: from ranges reserved for documentation, or of the same form."""
    number = n.cast("string")
    pad = lambda m, w: F.lpad((n % m).cast("string"), w, "0")
    pick = lambda names: F.concat(
        F.element_at(F.array(*map(F.lit, names)), ((n - 1) % len(names) + 1).cast("int")), F.when(n > len(names), ((n - 1) / len(names) + 1).cast("int").cast("string")).otherwise("")
    )
    # fixed values: the forms of made-up values
    card = F.aggregate(
        F.split(value, CHARACTERS), F.lit(""), lambda a, c: F.concat(a, F.when(c.rlike("[0-9０-９]"), F.when(F.length(F.regexp_replace(a, "[^0-9]", "")) == 0, "4").otherwise("1")).otherwise(c))
    )
    return (
        F.when(id_ == "email", F.concat(F.lit("user"), number, F.lit("@example.com")))
        .when(id_ == "phone_jp", F.concat(F.lit("090-0000-"), pad(10000, 4)))
        .when(id_ == "phone_intl", F.concat(F.lit("+1-555-01"), pad(100, 2)))
        .when(id_ == "postal_code_jp", F.concat(F.when(value.startswith("〒"), "〒").otherwise(""), F.lit("000-"), pad(10000, 4)))
        .when(id_ == "ipv4", F.concat(F.lit("192.0.2."), ((n - 1) % 254 + 1).cast("string")))
        .when(id_ == "ipv6", F.concat(F.lit("2001:db8::"), F.lower(F.hex(n.cast("long")))))
        .when(id_ == "mac_address", F.concat(F.lit("00:00:5E:00:53:"), F.lpad(F.hex((n % 256).cast("long")), 2, "0")))
        .when(id_.isin("hostname", "unc_path"), F.concat(F.lit("host"), number, F.lit(".example.com")))
        .when(id_ == "url", F.concat(F.lit("https://example.com/path"), number))
        .when(id_ == "person_name", F.when(F.octet_length(value) == F.length(value), pick(("John Doe", "Jane Roe", "Richard Roe", "Alex Example", "Sam Sample", "Pat Placeholder"))).otherwise(pick(("甲野一郎", "乙川花子", "丙田次郎", "丁村桜", "戊山三郎", "己沢陽子", "庚野四郎", "辛島直美"))))
        .when(id_ == "company_jp", F.concat(F.lit("株式会社サンプル"), number))
        .when(id_ == "company_en", F.concat(F.lit("Example Corp "), number))
        .when(id_.isin("address_jp", "address_jp_city"), F.concat(F.lit("東京都架空区見本町"), number, F.lit("-"), number))
        .when(id_ == "address_en", F.concat(number, F.lit(" Example Street")))
        .when(id_.isin("windows_user_path", "unix_home_path", "domain_user"), F.concat(F.lit("user"), number))
        .when(id_ == "credit_card", card)
        .otherwise(preserving(value, key, label))
    )


def render(template: Template, value: Column, n: Column, meta: dict[str, Column], key: str = "") -> Column:
    """meta: label, label_ja, category, category_ja, id."""
    out = []
    for name, args in template.parts:
        if name == "text":
            out.append(F.lit(args[0]))
        elif name == "n":
            out.append(n.cast("string"))
        elif name == "len":
            out.append(F.length(value).cast("string"))
        elif name == "hash":
            out.append(F.substring(hmac_hex(key, F.concat(meta["label"], F.lit(":"), value)), 1, args[0]))
        elif name == "prefix":
            out.append(F.left(value, F.lit(args[0])))
        elif name == "suffix":
            out.append(F.right(value, F.lit(args[0])))
        elif name == "fill":
            out.append(F.repeat(F.lit(args[0]), F.length(value) if args[1] < 0 else F.lit(args[1])))
        elif name == "shape":
            out.append(shape(value, *args))
        elif name == "fake":
            out.append(fake(value, meta["id"], F.greatest(n, F.lit(1)), key, meta["label"]))
        else:
            out.append(meta[name])
    return F.concat(*out) if out else F.lit("")
