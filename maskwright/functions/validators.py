"""Validators and refiners of matches as column expressions.

A validator gives 0 (reject), 1 (accept) or 2 (strong: no context word is needed, and confidence is 0.9 at least)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.spans import before, let

#: Splits a string into characters, without an empty one at the end.
CHARACTERS = r"(?!\A)(?!\z)"
# What stands for a secret without being one, account names that everybody has, abbreviations that look like
# host names, and registry roots and folder names.
NO_SECRETS = ("null", "none", "true", "false", "nil", "undefined", "required", "optional", "string", '""', "''")
COMMON_USERS = ("public", "default", "default user", "all users", "defaultuser0", "%username%", "<user>", "username", "user", "name")
NO_HOSTS = ("asp.net", "vb.net", "ado.net", "e.co", "i.e", "e.g")
NO_DOMAINS = (
    "HKLM HKCU HKCR HKU HKCC BUILTIN SYSTEM SOFTWARE HARDWARE SAM SECURITY NT WINDOWS PROGRA USERS CONTROL SRC LIB BIN DOCS APP APPS "
    "TEST TESTS DATA TEMP TMP OBJ BUILD DIST TARGET"
).split()
WIDE, ASCII = "０１２３４５６７８９", "0123456789"


def digits(v: Column) -> Column:
    """The digits, full-width ones as ASCII."""
    return F.regexp_replace(F.translate(v, WIDE, ASCII), "[^0-9]", "")


def ok(c: Column, strong: Column | None = None) -> Column:
    best = F.when(strong, 2).otherwise(1) if strong is not None else F.lit(1)
    return F.when(F.coalesce(c, F.lit(False)), best).otherwise(0)


def _digit(d: Column, i: int) -> Column:
    return F.substring(d, i, 1).try_cast("int")


def credit_card(v: Column) -> Column:
    return let(digits(v), _credit_card)


def _credit_card(d: Column) -> Column:
    two, four = F.substring(d, 1, 2).try_cast("int"), F.substring(d, 1, 4).try_cast("int")
    # fixed values: the ranges in which issuers number cards
    known = d.startswith("4") | two.between(51, 55) | two.isin(34, 37, 36, 38, 39, 65, 62) | four.between(2221, 2720) | four.between(3528, 3589) | four.between(3000, 3059) | (four == 6011)
    return F.when(F.length(d).between(13, 19), ok(F.call_function("luhn_check", d) & known)).otherwise(0)


def my_number(v: Column) -> Column:
    return let(digits(v), _my_number)


def _my_number(d: Column) -> Column:
    total = sum(_digit(d, 12 - n) * (n + 1 if n <= 6 else n - 5) for n in range(1, 12))
    rest = total % 11
    return F.when(F.length(d) == 12, ok(~d.rlike(r"\A(.)\1*\z") & (F.when(rest <= 1, 0).otherwise(11 - rest) == _digit(d, 12)))).otherwise(0)


def corporate_number(v: Column) -> Column:
    return let(digits(v), lambda d: _corporate_number(v, d))


def _corporate_number(v: Column, d: Column) -> Column:
    total = sum(_digit(d, 13 - i) * (1 if i % 2 == 0 else 2) for i in range(12))
    return F.when(F.length(d) == 13, ok(9 - total % 9 == _digit(d, 1), v.rlike(r"\A\s*[TＴ]"))).otherwise(0)


def iban(v: Column) -> Column:
    c = F.regexp_replace(v, r"\s", "")
    turned = F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))
    code = lambda ch: F.when(ch.between("0", "9"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
    rest = F.aggregate(F.split(turned, CHARACTERS), F.lit(0), lambda r, ch: (r * F.when(ch.between("0", "9"), 10).otherwise(100) + code(ch)) % 97)
    return F.when(F.length(c).between(15, 34) & c.rlike(r"\A[0-9A-Z]*\z"), ok(rest == 1, F.lit(True))).otherwise(0)


def us_ssn(v: Column) -> Column:
    return let(digits(v), _us_ssn)


def _us_ssn(d: Column) -> Column:
    area = F.substring(d, 1, 3)
    return ok((F.length(d) == 9) & ~area.isin("000", "666") & ~d.startswith("9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000"))


def phone_jp(v: Column) -> Column:
    t = F.trim(v)
    d, abroad = digits(t), t.startswith("+")
    rest = F.substring(d, 3, 40)
    d = F.when(abroad, F.when(d.startswith("81"), F.when(rest.startswith("0"), rest).otherwise(F.concat(F.lit("0"), rest))).otherwise("")).otherwise(d)
    # fixed values: ten digits, or eleven in certain ranges
    return ok(d.rlike(r"\A(?:0[1-9][0-9]{8}|(?:070|080|090|050|060|020)[0-9]{8})\z"), abroad | t.rlike("[^0-9０-９+]"))


def phone_intl(v: Column) -> Column:
    return ok(F.length(digits(v)).between(8, 15))


def ipv4(v: Column) -> Column:
    address = F.substring_index(v, "/", 1)
    parts = F.split(address, r"\.")
    return ok((F.size(parts) == 4) & ~F.exists(parts, lambda p: (F.length(p) > 1) & p.startswith("0")) & ~address.startswith("127.") & ~address.isin("0.0.0.0", "255.255.255.255"))


def ipv6(v: Column) -> Column:
    colons = F.length(v) - F.length(F.replace(v, F.lit(":")))
    full = v.contains("::") | (colons == 7) | v.contains(".")
    return ok(~v.isin("::", "::1") & (colons >= 2) & full & (F.length(F.regexp_replace(v, "[^0-9A-Fa-f]", "")) >= 4))


def jwt(v: Column) -> Column:
    return ok((F.size(F.split(v, r"\.")) == 3) & v.startswith("eyJ"))


def entropy(v: Column) -> Column:
    """Bits of each character."""
    chars = F.split(v, CHARACTERS)
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def high_entropy(v: Column) -> Column:
    hexes = v.rlike(r"\A[0-9A-Fa-f]*\z")
    classes = sum(v.rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]"))
    return F.when(F.octet_length(v) < 20, 0).when(hexes, ok((F.octet_length(v) >= 32) & v.rlike("[0-9]") & (entropy(v) >= 3.0))).otherwise(ok((classes >= 3) & (entropy(v) >= 4.0)))


def lat_lon(v: Column) -> Column:
    part = lambda i: F.abs(F.coalesce(F.trim(F.split(v, "[,，]")[i]).try_cast("double"), F.lit(999.0)))
    return ok((part(0) <= 90) & (part(1) <= 180))


def address_jp(v: Column) -> Column:
    # fixed values: a number, and words that make the text before it a sentence
    number = "[0-9０-９一二三四五六七八九十]"
    middle = F.regexp_extract(v, rf"(?s)\A(.*?){number}", 1)
    return ok(v.rlike(number) & ~middle.rlike("から|まで|では|には|での|より|にて|について") & ~middle.rlike(r"[でにをはがともへや第約計]\z"))


def not_placeholder(v: Column) -> Column:
    return ok(~v.rlike(r"\A[${<%(\[&:]") & ~v.rlike(r"\A[A-Za-z_][A-Za-z0-9_.:]+\(") & ~v.rlike(r"\A[*xX•●]*\z") & ~F.lower(v).isin(*NO_SECRETS))


def not_common_user(v: Column) -> Column:
    return ok(~F.lower(F.trim(v)).isin(*COMMON_USERS))


def hostname_ok(v: Column) -> Column:
    return ok(~F.lower(v).isin(*NO_HOSTS))


def domain_user(v: Column) -> Column:
    domain = F.upper(F.substring_index(v, "\\", 1))
    return ok(~domain.startswith("HKEY_") & ~domain.isin(*NO_DOMAINS))


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    f.__name__: f
    for f in (
        credit_card, my_number, corporate_number, iban, us_ssn, phone_jp, phone_intl, ipv4, ipv6, jwt, high_entropy, lat_lon, address_jp,
        not_placeholder, not_common_user, hostname_ok, domain_user,
    )
}


def phone_trailing_group(text: Column, value: Column, start: Column, end: Column, places: frozenset) -> tuple[Column, Column]:
    """Without a last group that a space sets off, where the separator before it is no space (a year after a number)."""
    return start, start + F.length(F.regexp_replace(value, r"([\-.][^ \-.]*) [^ \-.]*\z", "$1"))


def drop_leading_date_unit(text: Column, value: Column, start: Column, end: Column, places: frozenset) -> tuple[Column, Column]:
    """Without a date unit in front, after a digit."""
    unit = value.rlike(r"\A[年月日時分秒]") & before(text, start, 1).rlike("[0-9０-９]")
    return start + F.when(unit, 1).otherwise(0), end


def city_leading_place(text: Column, value: Column, start: Column, end: Column, places: frozenset) -> tuple[Column, Column]:
    """From the longest known place before the first word for a municipality on, if there is one."""
    head = F.regexp_extract(value, r"\A([^市区町村郡]*)[市区町村郡]", 1)
    later = F.filter(F.sequence(F.lit(0), F.length(head)), lambda i: (F.length(head) - i >= 2) & F.substring(head, i + 1, F.length(head)).isin(*sorted(places)))
    return start + F.coalesce(F.get(later, 0), F.lit(0)), end


REFINERS: dict[str, Callable] = {f.__name__: f for f in (phone_trailing_group, drop_leading_date_unit, city_leading_place)}
