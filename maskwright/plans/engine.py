"""The engine: settings become one column expression that finds, filters and resolves spans.

detect: text -> array of spans, a narrow projection without a shuffle. Detectors that are off are not in the expression.
Each has a necessary literal that is tested first. Name, place and company detectors read a lexicon in one Arrow UDF.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cache, reduce
from re import _parser

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions import template as T
from maskwright.functions.validators import REFINERS, VALIDATORS
from maskwright.operators import names
from maskwright.plans.catalog import AFTER, BEFORE, BOOST, CATALOG, CATEGORIES, DIGITS, HYPHENS, LEXICAL, PREFECTURES, Detector, java_pattern
from maskwright.plans.config import Config

#: The columns that detectors read: the text, and what their conditions share.
TEXT, GATES = "__text", "__gates"
#: A resolved span: det is the index into the engine's detectors.
RESOLVED = "array<struct<start:int,end:int,conf:double,det:int>>"
#: Letters of western Europe, white space and punctuation, which most of a prose text is made of.
PLAIN = "".join(map(chr, [*range(9, 14), 32, *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)])) + ".,;!)\"'«»¡¿"
#: One of the signs of each.
SIGNS = {f"sign{i}": own for i, own in enumerate((":", "/", "\\", "=", "_", "-", ":=", "?&", ":-"))}
#: Kinds of characters: whether one is of it, and how a text is tested for one. The tests read `rare`, which is the first.
KINDS: dict[str, tuple[Callable[[str], bool], str]] = {
    "rare": (lambda c: c not in PLAIN, f"{TEXT} RLIKE {S.sql_text('[^' + re.escape(PLAIN) + ']')}"),
    "digit": (lambda c: c in "0123456789０１２３４５６７８９", f"{TEXT} RLIKE '[0-9０-９]'"),
    "wide": (lambda c: c >= "\u2e80", f"octet_length({TEXT}) > length({TEXT}) AND {TEXT} RLIKE '[\u2e80-\U0010ffff]'"),
    **{k: (lambda c, own=own: c in own, " OR ".join(f"contains({TEXT}, {S.sql_text(x)})" for x in own)) for k, own in SIGNS.items()},
}


@cache
def kinds_of(patterns: tuple[tuple[str, float], ...]) -> tuple[str, ...]:
    """Kinds of which every match of a detector's patterns holds a character, read off their parse trees."""
    trees = []
    for p, _ in patterns:
        for own, one in (("{DC}", DIGITS), ("{HC}", HYPHENS), ("{PREF}", PREFECTURES), (r"\p{Han}", "一"), (r"\p{Katakana}", "ア"), (r"\p{Hiragana}", "あ")):
            p = p.replace(own, one)
        trees.append(_parser.parse(p))
    found = [k for k, (held, _) in KINDS.items() if not any(_without(t, held) for t in trees)]
    return tuple(k for k in found if not any(o in found and set(SIGNS[o]) < set(SIGNS[k]) for o in SIGNS if k in SIGNS))


def _without(tree, held: Callable[[str], bool]) -> bool:
    """Whether a pattern may match a text that has no character of a kind. Where a node is not known, it may."""
    for op, arg in tree:
        if op is _parser.LITERAL:
            may = not held(chr(arg))
        elif op is _parser.IN:
            may = any(o is _parser.LITERAL and not held(chr(a)) or o is _parser.RANGE and any(not held(chr(c)) for c in range(a[0], a[1] + 1)) or o not in (_parser.LITERAL, _parser.RANGE) for o, a in arg)
        elif op is _parser.BRANCH:
            may = any(_without(x, held) for x in arg[1])
        elif op is _parser.SUBPATTERN:
            may = _without(arg[-1], held)
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            may = arg[0] == 0 or _without(arg[2], held)
        else:
            may = True
        if not may:
            return False
    return True


@dataclass(frozen=True)
class Need:
    """A necessary condition for a detector beside the kinds of characters of its patterns: a digit, a character from East Asia on,
    a dot before a letter or digit, one of some literals, a pattern.

    Literals are looked for in UTF-8 bytes; a pattern makes Spark decode the text, so it comes last."""

    words: tuple[str, ...] = ()  # in the text in lower case
    exact: tuple[str, ...] = ()  # in the text as it is
    digit: bool = False
    wide: bool = False
    dotted: bool = False
    pattern: str | None = None

    def sql(self, kinds: tuple[str, ...] = ()) -> str | None:
        flags = [k for k in KINDS if k in kinds or getattr(self, k, False) is True]
        tests = [f"{GATES}.{k}" for k in flags if k != "rare" or len(flags) == 1] + [f"{GATES}.dotted"] * self.dotted
        any_of = [f"contains({GATES}.low, {S.sql_text(w)})" for w in self.words] + [f"contains({TEXT}, {S.sql_text(w)})" for w in self.exact]
        if any_of and not flags:  # plain texts, which are most, were searched for all such literals at once
            tests.append(f"{GATES}.{'hinted' if self.exact else 'worded'}")
        if any_of:
            tests.append("(" + " OR ".join(any_of) + ")")
        if self.pattern:
            tests.append(f"{TEXT} RLIKE {S.sql_text(self.pattern)}")
        return " AND ".join(tests) or None


def any_literal(words: list[str], either_case: bool = False) -> str:
    """A pattern for literals that looks at their first characters before it tries one after the other."""
    cased = lambda c: f"[{c.upper()}{c}]" if either_case and c.isascii() and c.isalpha() else re.escape(c)
    firsts = "".join(sorted({x for w in words for x in ((w[0].upper(), w[0].lower()) if either_case else w[0])}))
    return f"(?=[{re.escape(firsts)}])(?:" + "|".join("".join(map(cased, w)) for w in words) + ")"


def gates_of(hints: list[str], words: list[str]) -> Column:
    """What the conditions share, computed once for each text: the kinds of its characters, the text in lower case if a condition
    may read it, and whether literals of detectors are there that plain texts may hold too (hints: as they are, words: in either case)."""
    kinds = ", ".join(f"'{k}', {'r' if k == 'rare' else f'r AND ({test})'}" for k, (_, test) in KINDS.items())
    has = lambda words, pattern: f"{TEXT} RLIKE {S.sql_text(pattern)}" if words else "false"
    return F.expr(
        f"transform(array({KINDS['rare'][1]}), r -> transform(array({has(words, any_literal(words, True) if words else '')}), w -> named_struct({kinds}, 'worded', r OR w, "
        f"'hinted', {has(hints, any_literal(hints) if hints else '')}, 'dotted', {TEXT} RLIKE '[.][0-9A-Za-z]', 'low', CASE WHEN r OR w THEN lower({TEXT}) ELSE '' END))[0])[0]"
    )


MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
#: A digit and what stands beside it in all forms of dates.
DATED = rf"[{DIGITS}](?:[/\-.年][ 　]?[{DIGITS}]|(?s:.){MONTHS})|[{DIGITS}元]年|(?=[JFMASOND]){MONTHS}[a-z]*[.]?(?s:.)[0-9]"
FOURS = rf"[{DIGITS}]{{4}}[ 　{HYPHENS}]?[{DIGITS}]{{4}}"
#: Without what these ask for there is no match of the detector.
NEEDS = {
    "email": Need(("@", "＠", "%40", "(at)", "(at]", "[at)", "[at]")),
    "phone_jp": Need(digit=True, pattern=rf"(?:\+81|[0０][{DIGITS}])[{DIGITS}()（） 　{HYPHENS}]{{4}}"),
    "phone_intl": Need(("+",), digit=True),
    "postal_code_jp": Need(digit=True, pattern=rf"〒|郵便番号|[0-9０-９]{{3}}[{S.DASHES}][0-9０-９]{{4}}"),
    "address_jp": Need(("都", "道", "府", "県"), wide=True),
    "address_jp_city": Need(("市", "区", "町", "村", "郡"), wide=True),
    "address_en": Need(digit=True, pattern=r"[0-9](?:\s[A-Z]|-[0-9])"),
    "birthdate": Need(digit=True, pattern=DATED),
    "date": Need(digit=True, pattern=DATED),
    "age": Need(("歳", "才", "age"), digit=True),
    "employee_id": Need(("社員", "従業員", "職員", "スタッフ", "emp")),
    "my_number": Need(digit=True, pattern=FOURS),
    "corporate_number": Need(digit=True, pattern="[0-9０-９]{13}"),
    "residence_card_jp": Need(digit=True, pattern="[A-Z]{2}[0-9]{8}"),
    "health_insurance_jp": Need(("記号", "番号"), wide=True),
    "bank_account_jp": Need(("口座", "普通", "当座", "貯蓄", "支店番号", "店番"), wide=True),
    "us_ssn": Need(("-",), digit=True, pattern="[0-9]-[0-9]{2}-[0-9]"),
    "iban": Need(digit=True, pattern="[A-Z]{2}[0-9]{2}"),
    "credit_card": Need(digit=True, pattern=FOURS),
    "card_cvv": Need(("cvv", "cvc", "セキュリティコード", "security code"), digit=True),
    "money": Need(exact=("¥", "￥", "＄", "$", "€", "£", "円", "ドル", "USD", "JPY", "EUR"), digit=True),
    "ipv4": Need(digit=True, dotted=True, pattern=r"[0-9]\.[0-9]"),
    "ipv6": Need((":",), pattern=":[0-9A-Fa-f]{0,4}:"),
    "mac_address": Need(pattern=r"(?=[:\-.])(?:[:\-][0-9A-Fa-f]{2}[:\-]|\.[0-9A-Fa-f]{4}\.)"),
    "url": Need(("://",)),
    "url_credentials": Need(("://",)),
    "url_secret_params": Need(("?", "&")),
    "hostname": Need(dotted=True, pattern=r"(?i)\.(?:com|net|org|jp|io|dev|app|cloud|ai|biz|info|co|us|uk|de|cn|kr|tw|local|internal|intranet|corp|lan|home|test|aws|gcp)"),
    "windows_user_path": Need((":\\", ":/")),
    "unix_home_path": Need(exact=("/home/", "/Users/")),
    "unc_path": Need(("\\\\",)),
    "domain_user": Need(("\\",)),
    "windows_sid": Need(exact=("S-1-5-21",)),
    "uuid": Need(("-",), pattern="-[0-9a-fA-F]{4}-"),
    "private_key": Need(exact=("-----BEGIN",)),
    "aws_access_key": Need(exact=("AKIA", "ASIA", "ABIA", "ACCA", "AGPA", "AIDA", "AIPA", "ANPA", "ANVA", "AROA", "APKA", "ASCA")),
    "aws_secret_key": Need(("secret",)),
    "github_token": Need(exact=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    "gitlab_token": Need(exact=("glpat-",)),
    "slack_token": Need(exact=("xox",)),
    "slack_webhook": Need(exact=("https://hooks",)),
    "google_api_key": Need(exact=("AIza",)),
    "google_oauth_secret": Need(exact=("GOCSPX-",)),
    "azure_key": Need(("accountkey", "sharedaccesskey", "primarykey", "secondarykey")),
    "stripe_key": Need(exact=("k_live_", "k_test_")),
    "anthropic_key": Need(exact=("sk-ant-",)),
    "openai_key": Need(exact=("sk-",)),
    "huggingface_token": Need(exact=("hf_",)),
    "npm_token": Need(exact=("npm_",)),
    "sendgrid_key": Need(exact=("SG.",)),
    "jwt": Need(exact=("eyJ",)),
    "bearer_token": Need(("bearer",)),
    "basic_auth": Need(("basic",)),
    "password_kv": Need(("passw", "pass_", "passp", "pwd", "secret", "api", "token", "private")),
    "password_ja": Need(("パス", "暗証番号", "ＰＷ", "ｐｗ", "ﾊﾟｽﾜｰﾄﾞ"), wide=True),
    "high_entropy": Need(digit=True, pattern=r"[0-9](?:(?=[A-Za-z0-9+/_\-]{10})|(?<=[A-Za-z0-9+/_\-]{10}[0-9]))"),  # as its validator asks for a digit, ten of the others are on one side
    "lat_lon": Need(digit=True, dotted=True, pattern=r"[0-9]\.[0-9]{4}"),
    "jp_plate": Need(digit=True, wide=True),
    "company_en": Need(exact=("Inc", "Corp", "LLC", "Ltd", "Limited", "GmbH", "K.K", "PLC", "LLP")),
}


#: What has to follow at the place where a match begins, so that a word is read once and not again from each way to divide it.
AHEAD = {"hostname": r"(?=[a-z0-9\-]++\.[a-z0-9])"}


@dataclass(frozen=True)
class Active:
    """A detector that runs, with what the settings give it. spec is None for custom rules and keywords."""

    id: str
    category: str
    label: str
    label_ja: str
    name: str
    priority: int
    min_conf: float
    template: T.Template
    spec: Detector | None = None
    patterns: tuple[tuple[str, float], ...] = ()
    boundary: str = "none"


def keyword_pattern(words: tuple[str, ...], case_sensitive: bool) -> str:
    """One alternation, longest words first."""
    ordered = sorted({w for w in words if w.strip()}, key=lambda w: (-len(w), w))
    return ("" if case_sensitive else "(?i)") + "|".join(re.sub(r"([\\.\[\]{}()*+?^$|\-#&~])", r"\\\1", w) for w in ordered)


def rule_pattern(pattern: str, group: str | None) -> str:
    """A user's pattern with the group to mask renamed v; other capturing groups stop capturing."""
    out, i, number, inside, found = [], 0, 0, False, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = (inside or c == "[") and c != "]"
        if c == "(" and not inside:
            named = re.match(r"\(\?P?<([A-Za-z]\w*)>", pattern[i:])
            if named or pattern[i + 1 : i + 2] != "?":
                number += 1
                wanted = group is not None and group in ((named or [None, ""])[1] if named else "", str(number)) or group is None and bool(named) and named[1] == "v"
                out.append("(?<v>" if wanted and not found else "(?:")
                found |= wanted
                i += len(named[0]) if named else 1
                continue
        out.append(c)
        i += 1
    return "".join(out)


#: Columns of engines, by session and settings: building them takes thousands of calls into the JVM.
_BUILT: dict[tuple, Column] = {}


class Meta(dict):
    """Columns with what is known of the detector at an index: id, label, label_ja, category, category_ja, name and priority,
    each made when it is asked for."""

    def __init__(self, detectors: list[Active], det: Column):
        super().__init__()
        self.detectors, self.det = detectors or [Active("", "custom", "", "", "", 0, 0.0, T.parse(""))], det

    def __missing__(self, field: str) -> Column:
        if field == "category_ja":
            known = {c: ja for c, _, ja in CATEGORIES}
            values = [known.get(d.category, d.category) for d in self.detectors]
        else:
            values = [getattr(d, field) for d in self.detectors]
        literals = ", ".join(str(v) if isinstance(v, int) else S.sql_text(v) for v in values)
        self[field] = F.get(F.expr(f"array({literals})"), self.det)
        return self[field]


class Engine:
    """What a configuration detects and how it renders what it finds."""

    def __init__(self, config: Config | None = None, lexicon: names.Lexicon | None = None, morphology: names.Morphology | None = None):
        self.config = c = config or Config()
        self.lexicon = lexicon or names.SEED
        self.morphology = morphology
        self.warnings = list(c.warnings)
        if c.use_morphology and morphology is None:
            self.warnings.append("there is no morphological analysis; names are found by cues and the lexicon")
        default = self._template(c.template, "masking") or T.parse("<{label}_{n}>")
        self.detectors: list[Active] = []
        for d in CATALOG:
            if c.detector_enabled(d.id):
                own, cat = c.detectors.get(d.id, {}), c.categories.get(d.category, {})
                t = self._template(own.get("template"), d.id) or self._template(cat.get("template"), d.category) or default
                patterns = tuple((re.sub(r"\A(\(\?[a-z]+\))?", lambda m: m[0] + AHEAD.get(d.id, ""), java_pattern(p)), conf) for p, conf in d.patterns)
                self.detectors.append(Active(d.id, d.category, own.get("label", d.label), d.label_ja, d.name_en, int(own.get("priority", d.priority)), float(own.get("min_confidence", c.min_confidence)), t, d, patterns, d.boundary))
        for r in c.rules:
            if r.enabled and r.pattern and c.category_enabled(r.category):
                try:
                    re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", r.pattern).replace(r"\z", r"\Z"))
                except re.error as e:
                    self.warnings.append(f"custom rule {r.id}: {e}")
                    continue
                t = self._template(r.template, r.id) or self._template(c.categories.get(r.category, {}).get("template"), r.category) or default
                pattern = ("(?i)" if r.case_insensitive else "") + rule_pattern(r.pattern, r.group)
                self.detectors.append(Active(r.id, r.category, r.label, r.label, r.name or r.id, r.priority, 0.0, t, None, ((pattern, r.confidence),)))
        for k in c.keywords:
            if k.enabled and any(w.strip() for w in k.words) and c.category_enabled("custom"):
                t = self._template(k.template, k.label) or self._template(c.categories.get("custom", {}).get("template"), "custom") or default
                self.detectors.append(Active("keyword:" + k.label, "custom", k.label, k.label, k.name or k.label, 97, 0.0, t, None, ((keyword_pattern(k.words, k.case_sensitive), 1.0),), "alnum" if k.whole_word else "none"))

    def _template(self, source: str | None, where: str) -> T.Template | None:
        if not source:
            return None
        try:
            return T.parse(source)
        except T.TemplateError as e:
            self.warnings.append(f"template of {where}: {e}")
            return None

    # ---- detection ----

    def _kinds(self, d: Active) -> tuple[str, ...]:
        return kinds_of(d.spec.patterns) if d.spec else ()

    def _need(self, d: Active) -> Need:
        if not d.spec:
            return Need()
        own = NEEDS.get(d.id, Need())
        return replace(own, words=d.spec.context) if d.spec.required and not d.spec.validator else own

    def _gates(self) -> Column:
        """Of detectors that plain texts may hold too, the literals are looked for in all texts, together."""
        own = [n for d in self.detectors if d.patterns and not self._kinds(d) and not (n := self._need(d)).digit and not n.wide]
        words = sorted({w for n in own for w in n.words if not set(w) - set(PLAIN)})
        return gates_of(sorted({w for n in own for w in n.exact}), words)

    def _raw(self) -> str:
        """SQL for what the patterns match, with the index of their detector. A detector whose condition a text does not meet is
        not looked for in it."""
        out = []
        for i, d in enumerate(self.detectors):
            if not d.patterns:
                continue
            found = ", ".join(S.pattern_sql(TEXT, p, conf, i) for p, conf in d.patterns)
            found = f"concat({found})" if len(d.patterns) > 1 else found
            test = self._need(d).sql(self._kinds(d))
            out.append(f"CASE WHEN {test} THEN {found} ELSE cast(array() AS {S.FOUND}) END" if test else found)
        return f"flatten(array({', '.join(out)}))" if out else f"cast(array() AS {S.FOUND})"

    def _by(self, key) -> dict:
        """Indexes of detectors by what key says of their catalog rows, if it says anything."""
        out: dict = {}
        for i, d in enumerate(self.detectors):
            if d.spec and (k := key(d)):
                out.setdefault(k, []).append(i)
        return out

    def _tested(self, text: Column, found: Column) -> Column:
        """What is left of matches after refining, boundaries, validators and contexts, with their confidence. Each kind of test is
        in the expression once, whatever the number of detectors that use it."""
        cut: dict[int, Callable] = {}
        for name, rows in self._by(lambda d: d.spec.refine).items():
            for i in rows:
                cut[i] = lambda x, name=name: REFINERS[name](text, S.value_of(text, x), x["start"], x["end"], self.lexicon.places)
        for i in self._by(lambda d: d.spec.trim).get(True, ()):
            cut[i] = lambda x: (x["start"], x["start"] + F.length(F.regexp_replace(S.value_of(text, x), r"""[.,;:!?)\]}'"]+\z""", "")))
        if cut:

            def adjusted(x):
                begin, end = x["start"], x["end"]
                for i, by in cut.items():
                    b, e = by(x)
                    begin, end = F.when(x["det"] == i, b).otherwise(begin), F.when(x["det"] == i, e).otherwise(end)
                return F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), x["conf"].alias("conf"), x["det"].alias("det"))

            some = F.exists(found, lambda x: x["det"].isin(*cut))
            found = F.when(some, F.transform(found, adjusted)).otherwise(found)
        kinds: dict[str, list[int]] = {}
        for i, d in enumerate(self.detectors):
            if d.boundary != "none":
                kinds.setdefault(d.boundary, []).append(i)

        def bounded(x):
            good = F.lit(True)
            for kind, rows in kinds.items():
                good = F.when(x["det"].isin(*rows), S.BOUNDARIES[kind](S.before(text, x["start"]), S.after(text, x["end"]))).otherwise(good)
            return (x["end"] > x["start"]) & good

        found = F.filter(found, bounded)
        contexts, validators = self._by(lambda d: d.spec.context), self._by(lambda d: d.spec.validator)
        required = [i for i, d in enumerate(self.detectors) if d.spec and d.spec.required]
        if not contexts and not validators:
            return found

        def judged(x):
            verdict, near = F.lit(1), F.lit(False)
            for name, rows in validators.items():
                verdict = F.when(x["det"].isin(*rows), VALIDATORS[name](S.value_of(text, x))).otherwise(verdict)
            for words, rows in contexts.items():
                near = F.when(x["det"].isin(*rows), S.has_context(text, x, words, BEFORE, AFTER)).otherwise(near)

            def weighed(y):
                conf = F.when(y["near"], F.least(x["conf"] + BOOST, F.lit(1.0))).otherwise(x["conf"])
                conf = F.when(y["verdict"] == 2, F.greatest(conf, F.lit(0.9))).otherwise(conf)
                good = y["verdict"] > 0
                if required:
                    good &= ~x["det"].isin(*required) | y["near"] | (y["verdict"] == 2)
                tested = x["det"].isin(*{i for rows in (*validators.values(), *contexts.values()) for i in rows})
                return F.struct(*[x[c].alias(c) for c in ("start", "end")], F.when(good, F.when(tested, F.round(conf, 4)).otherwise(conf)).otherwise(-1.0).alias("conf"), x["det"].alias("det"))

            return S.let(F.struct(verdict.alias("verdict"), near.alias("near")), weighed)

        return F.filter(F.transform(found, judged), lambda x: x["conf"] >= 0)

    def _allowed(self, text: Column, x: Column, extra: Column | None) -> Column | None:
        """Whether the allowlist takes a span out; None if nothing can."""
        c, value = self.config, S.value_of(text, x)
        tests = [value.rlike(rf"\A(?:{p})\z") for p in c.allow_patterns]
        if c.allow_values:
            tests.append(F.lower(value).isin(*[v.lower() for v in c.allow_values]))
        if extra is not None:
            tests.append(F.array_contains(extra, F.lower(value)))
        hosts = [i for i, d in enumerate(self.detectors) if d.id in ("email", "hostname", "url", "unc_path")]
        if c.allow_domains and hosts:
            host = F.regexp_replace(F.regexp_replace(F.lower(value), r"\A(?s:.*)@", ""), r"\A(?s:.*?)://", "")
            host = F.regexp_extract(host, r"\A([^/:?#]*)", 1)
            under = S.let(host, lambda h: reduce(lambda a, b: a | b, [(h == w.lower()) | h.endswith("." + w.lower()) for w in c.allow_domains]))
            tests.append(F.when(x["det"].isin(*hosts), under).otherwise(False))
        return reduce(lambda a, b: a | b, tests) if tests else None

    def _sure(self, text: Column, found: Column, named: Column | None, extra: Column | None) -> Column:
        """Tested matches and names that are sure enough and not allowed."""
        if named is not None:
            own = [(i, d.id) for i, d in enumerate(self.detectors) if d.id in LEXICAL and d.spec]
            index = lambda x: reduce(lambda a, b: F.when(x["id"] == b[1], b[0]).otherwise(a), own, F.lit(-1))
            found = F.concat(found, F.transform(named, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["conf"].alias("conf"), index(x).alias("det"))))
        least = {d.min_conf for d in self.detectors}
        if least != {0.0}:
            bound = F.lit(min(least)) if len(least) == 1 else None
            found = F.filter(found, lambda x: x["conf"] >= (bound if bound is not None else F.get(F.expr("array(" + ", ".join(f"{d.min_conf!r}D" for d in self.detectors) + ")"), x["det"])))
        return F.filter(found, lambda x: ~self._allowed(text, x, extra)) if self._allowed(text, F.col("x"), extra) is not None else found

    def resolve(self, found: str) -> Column:
        """A disjoint set by start: priority, confidence, length, start and the detectors' order decide. found: a column.

        Candidates in the order of starts are cut where the next start is as far off as the longest candidate is long, since
        nothing reaches over such a gap; each group is resolved on its own."""
        priority = "array(" + ", ".join(str(-d.priority) for d in self.detectors or (Active("", "", "", "", "", 0, 0.0, T.parse("")),)) + ")"
        rank = f"named_struct('p', get({priority}, x.det), 'c', -x.conf, 'l', x.start - x.end, 'start', x.start, 'det', x.det, 'end', x.end)"
        kept = "named_struct('start', x.start, 'end', x.end, 'conf', -x.c, 'det', x.det)"
        one = (
            f"CASE WHEN size(g) = 1 THEN g ELSE array_sort(aggregate(array_sort(transform(g, x -> {rank})), cast(array() AS {RESOLVED}), "
            f"(acc, x) -> CASE WHEN exists(acc, k -> k.start < x.end AND k.end > x.start) THEN acc ELSE array_append(acc, {kept}) END)) END"
        )
        cuts = "concat(array(0), filter(sequence(1, size(s) - 1), i -> s[i].start - s[i - 1].start >= array_max(transform(s, x -> x.end - x.start))), array(size(s)))"
        groups = f"transform(array({cuts}), b -> transform(sequence(1, size(b) - 1), i -> slice(s, b[i - 1] + 1, b[i] - b[i - 1])))[0]"
        return F.expr(f"CASE WHEN size({found}) <= 1 THEN {found} ELSE transform(array(array_sort({found})), s -> flatten(transform({groups}, g -> {one})))[0] END")

    def _names(self, text: Column) -> Column | None:
        wanted = [d.id for d in self.detectors if d.id in LEXICAL and d.spec]
        return names.detector(self.lexicon, wanted, self.config, text, self.morphology) if wanted else None

    def detect(self, df: DataFrame, text_col: str = "text", extra_col: str | None = None, spans_col: str = "spans", resolve: bool = True) -> DataFrame:
        """df with spans: array<struct<start, end, conf, det>>. extra_col: array<string> of lower-case values to leave out."""
        text = F.col(TEXT)
        own = S.once(S.once(df, TEXT, S.clean(F.col(text_col))), GATES, self._gates())
        named = self._names(text)
        if named is not None:
            own = own.withColumn("__names", named)
        own = S.once(own, "__raw", F.expr(self._raw()))
        names_col, extra = F.col("__names") if named is not None else None, F.col(extra_col) if extra_col else None
        raw = self._cached("tested", lambda: F.when(F.size("__raw") > 0, self._tested(text, F.col("__raw"))).otherwise(F.col("__raw")))
        found = self._cached(f"sure {named is not None} {extra_col}", lambda: self._sure(text, raw, names_col, extra))
        if not resolve:
            return S.once(own, spans_col, found).drop(TEXT, GATES, "__names", "__raw")
        own = S.once(S.once(own, "__found", found), spans_col, self.resolve("__found"))
        person = next((i for i, d in enumerate(self.detectors) if d.id == "person_name"), None)
        if self.config.propagate and person is not None and named is not None:
            sure = F.exists(F.col(spans_col), lambda x: (x["det"] == person) & (x["conf"] >= 0.7))
            own = own.withColumn("__more", names.propagation(self.lexicon, person, self.config)(F.when(sure, text), F.when(sure, F.col(spans_col))))
            own = S.once(own, spans_col, F.when(F.size("__more") > 0, F.array_sort(F.concat(F.col(spans_col), F.col("__more")))).otherwise(F.col(spans_col)))
        return own.drop(TEXT, GATES, "__names", "__raw", "__found", "__more")

    def _cached(self, what: str, build: Callable[[], Column]) -> Column:
        c = self.config
        own = tuple((d.id, d.patterns, d.boundary, d.min_conf, d.spec) for d in self.detectors)
        key = (SparkContext._active_spark_context.applicationId, what, own, c.allow_values, c.allow_patterns, c.allow_domains, self.lexicon.places)
        if key not in _BUILT:
            _BUILT[key] = build()
        return _BUILT[key]

    # ---- meta data ----

    def meta(self, det: Column) -> Meta:
        return Meta(self.detectors, det)

    def numbered(self) -> bool:
        return any(d.template.numbered for d in self.detectors)

    def rendered(self, det: Column, value: Column, n: Column) -> Column:
        """The replacement of a value by the template of its detector; equal templates share one branch."""
        by: dict[str, list[int]] = {}
        for i, d in enumerate(self.detectors):
            by.setdefault(d.template.source, []).append(i)
        meta = self.meta(det)
        out = None
        for rows in by.values():
            r = T.render(self.detectors[rows[0]].template, value, n, meta, self.config.hash_salt)
            if len(by) == 1:
                return r
            out = F.when(det.isin(rows), r) if out is None else out.when(det.isin(rows), r)
        return out if out is not None else F.lit("")


def list_detectors(spark: SparkSession, config: Config | None = None) -> DataFrame:
    """The catalog with the settings' flags, a small dimension table."""
    c = config or Config()
    rows = [(i, d.id, d.category, d.label, d.label_ja, d.name_en, d.name_ja, d.priority, d.enabled, c.detector_enabled(d.id)) for i, d in enumerate(CATALOG)]
    return spark.createDataFrame(rows, "det_index int, id string, category string, label string, label_ja string, name_en string, name_ja string, priority int, default_enabled boolean, enabled boolean")


def list_categories(spark: SparkSession, config: Config | None = None) -> DataFrame:
    c = config or Config()
    return spark.createDataFrame([(i, en, ja, c.category_enabled(i)) for i, en, ja in CATEGORIES], "id string, name_en string, name_ja string, enabled boolean")
