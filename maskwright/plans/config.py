"""Settings: defaults, TOML files with includes and profiles, merging, and checks. All of it runs on the driver."""

from __future__ import annotations

import copy
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from maskwright.functions import template as templates
from maskwright.plans.catalog import BY_ID, CATALOG, CATEGORIES

DEFAULT_TEMPLATE = "<{label}_{n}>"
#: Tables of lists that grow when settings are merged; other lists are replaced.
APPENDED = ("custom_rules", "keywords", "allowlist.values", "allowlist.patterns", "allowlist.domains")

# Default allowlist, file names and profiles.
DOMAINS = ("example.com", "example.org", "example.net", "example.jp", "localhost")
INCLUDE = tuple(
    f"*.{x}"
    for x in (
        "txt log csv tsv json jsonl ndjson xml yaml yml har md markdown mdx rst adoc html htm ini conf cfg config properties toml env sql "
        "py js ts java cs go rb php ps1 sh bat eml msg docx xlsx pptx pdf"
    ).split()
)
PROFILES: dict[str, dict] = {
    "llm": {"description": "numbered tags that keep context", "masking": {"template": "<{label}_{n}>"}, "detectors": {"date": {"enabled": False}}},
    "log_share": {
        "description": "logs: addresses, hosts, paths and secrets, keeping their form",
        "masking": {"template": "{shape:x}"},
        "categories": {"personal": {"enabled": True}},
        "detectors": {"uuid": {"enabled": True}, "ipv4": {"template": "{fake}"}, "ipv6": {"template": "{fake}"}},
    },
    "strict": {
        "description": "dates, amounts, URLs, places and high-entropy strings too",
        "masking": {"template": "[{label_ja}]", "min_confidence": 0.4},
        "names": {"dictionary_threshold": 0.5},
        "detectors": {x: {"enabled": True} for x in ("date", "age", "money", "url", "uuid", "place_name", "high_entropy")},
    },
}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    """A custom pattern (Java dialect). group: name or number of the group to mask, else a group v, else all of it."""

    id: str
    pattern: str
    name: str = ""
    label: str = "CUSTOM"
    group: str | None = None
    category: str = "custom"
    priority: int = 70
    confidence: float = 0.9
    template: str | None = None
    case_insensitive: bool = False
    enabled: bool = True


@dataclass(frozen=True)
class Keywords:
    """Words to mask as they are."""

    words: tuple[str, ...]
    label: str = "KEYWORD"
    name: str = ""
    case_sensitive: bool = False
    whole_word: bool = False
    template: str | None = None
    enabled: bool = True


@dataclass
class Config:
    template: str = DEFAULT_TEMPLATE
    min_confidence: float = 0.5
    hash_salt: str = ""
    propagate: bool = True
    use_dictionary: bool = True
    dictionary_threshold: float = 0.6
    use_morphology: bool = False
    categories: dict[str, dict] = field(default_factory=dict)
    detectors: dict[str, dict] = field(default_factory=dict)
    allow_values: tuple[str, ...] = ()
    allow_patterns: tuple[str, ...] = ()
    allow_domains: tuple[str, ...] = DOMAINS
    rules: tuple[Rule, ...] = ()
    keywords: tuple[Keywords, ...] = ()
    include: tuple[str, ...] = INCLUDE
    exclude: tuple[str, ...] = ()
    suffix: str = ".masked"
    output_encoding: str = "same"
    properties: str = "ask"
    warnings: tuple[str, ...] = ()

    def detector_enabled(self, id_: str) -> bool:
        d = BY_ID[id_]
        on = self.detectors.get(id_, {}).get("enabled")
        return self.category_enabled(d.category) and (d.enabled if on is None else bool(on))

    def category_enabled(self, id_: str) -> bool:
        return bool(self.categories.get(id_, {}).get("enabled", True))

    def only(self, *ids: str) -> Config:
        """A copy in which just these detectors run."""
        for i in ids:
            if i not in BY_ID:
                raise ConfigError(f"no detector {i}")
        out = copy.deepcopy(self)
        for d in CATALOG:
            out.detectors[d.id] = out.detectors.get(d.id, {}) | {"enabled": d.id in ids}
        for i in ids:
            out.categories[BY_ID[i].category] = out.categories.get(BY_ID[i].category, {}) | {"enabled": True}
        return out

    def changed(self, **values) -> Config:
        out = copy.deepcopy(self)
        for k, v in values.items():
            setattr(out, k, v)
        return out


def merge(base: dict, over: dict, at: str = "") -> dict:
    """over on top of base: tables deeply, the lists of APPENDED by what is new, else the value of over."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        path = f"{at}.{k}" if at else k
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merge(out[k], v, path)
        elif isinstance(v, list) and isinstance(out.get(k), list) and path in APPENDED:
            out[k] = out[k] + [x for x in v if x not in out[k]]
        else:
            out[k] = copy.deepcopy(v)
    return out


def load(path: str | Path, profile: str | None = None) -> Config:
    return resolve(_table(Path(path), 0), profile)


def loads(text: str, profile: str | None = None) -> Config:
    try:
        return resolve(tomllib.loads(text), profile)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from None


def _table(path: Path, depth: int) -> dict:
    """A file on top of the files it includes."""
    if depth > 8:
        raise ConfigError(f"includes are nested too deeply at {path}")
    try:
        own = tomllib.loads(path.read_text(encoding="utf-8-sig"))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from None
    below: dict = {}
    for name in own.pop("include", []):
        expanded = re.sub(r"%([^%]+)%", lambda m: os.environ.get(m[1], m[0]), name)
        below = merge(below, _table(path.parent / expanded, depth + 1))
    return merge(below, own)


def resolve(table: dict, profile: str | None = None) -> Config:
    profiles = merge(PROFILES, table.get("profiles", {}))
    name = profile or table.get("general", {}).get("active_profile", "default")
    if name != "default":
        if name not in profiles:
            raise ConfigError(f"no profile {name}")
        table = merge(table, {k: v for k, v in profiles[name].items() if k != "description"})
    masking, names, allow, batch = (table.get(k, {}) for k in ("masking", "names", "allowlist", "batch"))
    known = lambda cls, d: cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k in cls.__dataclass_fields__})
    c = Config(
        template=masking.get("template", DEFAULT_TEMPLATE),
        min_confidence=float(masking.get("min_confidence", 0.5)),
        hash_salt=masking.get("hash_salt", ""),
        propagate=names.get("propagate", True),
        use_dictionary=names.get("use_dictionary", True),
        dictionary_threshold=float(names.get("dictionary_threshold", 0.6)),
        use_morphology=names.get("use_morphology", False),
        categories=table.get("categories", {}),
        detectors=table.get("detectors", {}),
        allow_values=tuple(allow.get("values", ())),
        allow_patterns=tuple(allow.get("patterns", ())),
        allow_domains=tuple(allow.get("domains", DOMAINS)),
        rules=tuple(known(Rule, {"id": "", "pattern": ""} | d) for d in table.get("custom_rules", [])),
        keywords=tuple(known(Keywords, {"words": []} | d) for d in table.get("keywords", [])),
        include=tuple(batch.get("include", INCLUDE)),
        exclude=tuple(batch.get("exclude", ())),
        suffix=batch.get("suffix", ".masked"),
        output_encoding=batch.get("output_encoding", "same"),
        properties=table.get("files", {}).get("properties", "ask"),
    )
    c.warnings = tuple(validate(c))
    return c


def validate(c: Config) -> list[str]:
    """What is wrong with the settings without stopping them from working."""
    out = []
    categories = {x[0] for x in CATEGORIES}
    out += [f"unknown detector {x}" for x in c.detectors if x not in BY_ID]
    out += [f"unknown category {x}" for x in c.categories if x not in categories]
    given = [("masking", c.template)] + [(k, d["template"]) for t in (c.categories, c.detectors) for k, d in t.items() if d.get("template")]
    given += [(r.id, r.template) for r in c.rules if r.template] + [(k.label, k.template) for k in c.keywords if k.template]
    for where, source in given:
        try:
            templates.parse(source)
        except templates.TemplateError as e:
            out.append(f"template of {where}: {e}")
    if not 0 <= c.min_confidence <= 1:
        out.append("min_confidence is outside 0 to 1")
    seen: set[str] = set()
    for r in c.rules:
        if not r.pattern:
            out.append(f"custom rule {r.id or '?'} has no pattern")
        if r.id in seen:
            out.append(f"custom rule {r.id} is there twice")
        seen.add(r.id)
    out += [f"keyword group {k.label} has no words" for k in c.keywords if not any(w.strip() for w in k.words)]
    if c.properties not in ("ask", "mask", "clear", "keep"):
        out.append(f"unknown way with properties: {c.properties}")
    return out


def with_terms(c: Config, *terms: tuple[str, bool, bool]) -> Config:
    """c with ad-hoc terms (text, case matters, is a pattern), and the custom category on."""
    words = tuple(Keywords((t,), label="TERM", case_sensitive=case) for t, case, pattern in terms if t and not pattern)
    rules = tuple(Rule(f"term_{i}", t, label="TERM", case_insensitive=not case, priority=97) for i, (t, case, pattern) in enumerate(terms) if t and pattern)
    return c.changed(keywords=c.keywords + words, rules=c.rules + rules, categories=c.categories | {"custom": c.categories.get("custom", {}) | {"enabled": True}})


def register_term(c: Config, text: str, case: bool = False, pattern: bool = False) -> Config:
    """c with the term for good; registering it again changes nothing."""
    if pattern:
        rule = Rule(f"term_{len(c.rules) + 1}", text, label="TERM", case_insensitive=not case)
        return c if any((r.pattern, r.case_insensitive) == (text, not case) for r in c.rules) else c.changed(rules=c.rules + (rule,))
    for i, g in enumerate(c.keywords):
        if g.label == "TERM" and g.case_sensitive == case:
            if text in g.words:
                return c
            return c.changed(keywords=c.keywords[:i] + (Keywords(g.words + (text,), "TERM", g.name, case),) + c.keywords[i + 1 :])
    return c.changed(keywords=c.keywords + (Keywords((text,), "TERM", case_sensitive=case),))
