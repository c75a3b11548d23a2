"""Numbering, templates, overlaps, allowlists, rules, propagation and shared numbers."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from maskwright.functions import template as T
from maskwright.operators import mask as M
from maskwright.operators import report as R
from maskwright.operators import search as Q
from maskwright.plans.config import Config, ConfigError, Keywords, Rule, loads, register_term, with_terms
from maskwright.plans.engine import Engine, list_detectors

OPEN = Config(allow_domains=())


def masked(spark, config, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r["masked"] for r in M.mask(Engine(config), df).orderBy("i").collect()]


def test_numbers_follow_values(spark):
    c = OPEN.only("email", "phone_jp", "phone_intl")
    assert masked(spark, c, "A@b.co a@B.CO c@d.co 090-1111-2222 / 09011112222 / +44 20 7946 0958") == [
        "<EMAIL_1> <EMAIL_1> <EMAIL_2> <PHONE_1> / <PHONE_1> / <PHONE_2>"
    ]


def test_null_and_empty(spark):
    assert masked(spark, OPEN.only("email"), None, "", "none") == [None, "", "none"]


def test_templates(spark):
    text = "card 4111-1111-1111-1111"
    for template, want in {
        "[{label}]": "[CREDIT_CARD]", "{label_ja}": "カード番号", "{category}:{id}": "finance:credit_card", "{len}": "19", "{prefix:2}..{suffix:4}": "41..1111",
        "{fill:*:3}": "***", "{fill:#}": "#" * 19, "{shape:*:4}": "****-****-****-1111", "{{x}}": "{x}", "{fake}": "4111-1111-1111-1111",
        "{hash:10}": hmac.new(b"salt", b"CREDIT_CARD:4111-1111-1111-1111", hashlib.sha256).hexdigest()[:10],
    }.items():
        assert masked(spark, OPEN.only("credit_card").changed(template=template, hash_salt="salt"), text) == ["card " + want], template


@pytest.mark.parametrize(("source", "kind"), [("{label", "unclosed"), ("{nope}", "unknown"), ("{hash:x}", "argument"), ("{fill:*:-1}", "argument")])
def test_template_errors(source, kind):
    with pytest.raises(T.TemplateError) as e:
        T.parse(source)
    assert e.value.kind == kind


def test_bad_template_is_a_warning(spark):
    c = OPEN.only("email")
    c.detectors["email"]["template"] = "{nope}"
    assert any("email" in w for w in Engine(c).warnings)
    assert masked(spark, c, "a@b.co") == ["<EMAIL_1>"]


def test_fake_keeps_the_form(spark):
    out = masked(spark, OPEN.only("us_ssn", "email", "ipv4").changed(template="{fake}"), "SSN 219-09-9999 a@b.co 10.1.2.3")[0]
    import re

    assert re.fullmatch(r"SSN \d{3}-\d\d-\d{4} user1@example\.com 192\.0\.2\.1", out) and "219-09-9999" not in out


def test_overlaps_and_offsets(spark):
    df = spark.createDataFrame([(1, "see postgres://bob:pw12345@db.corp.local/x and b@c.de.")], "i long, text string")
    rows = M.mask(Engine(OPEN), df).select(F.explode(M.with_offsets(F.col("replacements"))).alias("x"), "masked").select("x.*", "masked").collect()
    assert [(r["label"], r["original"]) for r in rows] == [("URL_CREDENTIALS", "bob:pw12345"), ("HOST", "db.corp.local"), ("EMAIL", "b@c.de")]
    assert all(r["masked"][r["out_start"] : r["out_end"]] == r["replacement"] for r in rows)


def test_allowlist_precedes_overlaps(spark):
    c = OPEN.only("email", "hostname").changed(allow_values=("B@C.de",))
    assert masked(spark, c, "b@c.de x@c.de") == ["b@<HOST_1> <EMAIL_1>"]
    assert masked(spark, OPEN.only("email").changed(allow_patterns=("x@.*",)), "b@c.de x@c.de") == ["<EMAIL_1> x@c.de"]


def test_rules_and_keywords(spark):
    c = OPEN.only().changed(
        rules=(Rule("ticket", r"(ID)-(?<v>[0-9]+)", label="TICKET"), Rule("bad", "(")), keywords=(Keywords(("New York", "York", "a.b"), whole_word=True, template="[{label}]"),)
    )
    engine = Engine(c)
    assert any("bad" in w for w in engine.warnings)
    assert masked(spark, c, "ID-77 in new york, York; axb a.b Yorks") == ["ID-<TICKET_1> in [KEYWORD], [KEYWORD]; axb [KEYWORD] Yorks"]
    assert masked(spark, OPEN.only().changed(rules=(Rule("g", "(a)(b)", group="2"),)), "ab") == ["a<CUSTOM_1>"]


def test_names_and_propagation(spark):
    c = OPEN.only("person_name", "company_jp").changed(template="[{label}]")
    assert masked(spark, c, "Dear Alice Smith,\nAlice asked.", "鈴木花子様、花子さんと鈴木", "株式会社見本製作所 御中", "皆様、お客様") == [
        "Dear [NAME],\n[NAME] asked.", "[NAME]様、[NAME]さんと[NAME]", "[COMPANY] 御中", "皆様、お客様",
    ]


def test_shared_numbers(spark):
    texts = ["b@x.co", "a@x.co b@x.co", None, "c@x.co A@X.co", ""]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i long, text string, label string").repartition(3)
    got = M.mask_shared(Engine(OPEN.only("email")), df, "i", "i").orderBy("i").collect()
    assert [r["masked"] for r in got] == ["<EMAIL_1>", "<EMAIL_2> <EMAIL_1>", None, "<EMAIL_3> <EMAIL_2>", ""]


def test_config():
    c = loads('[masking]\ntemplate = "[{label}]"\n[detectors.email]\nenabled = false\n[allowlist]\nvalues = ["x"]\n[profiles.strict.allowlist]\nvalues = ["y"]\n[detectors.nope]\nenabled = true', "strict")
    assert c.min_confidence == 0.4 and c.template == "[{label_ja}]" and c.allow_values == ("x", "y")
    assert not c.detector_enabled("email") and c.detector_enabled("date") and c.warnings == ("unknown detector nope",)
    with pytest.raises(ConfigError):
        loads("", "nope")
    with pytest.raises(ConfigError):
        loads("[")


def test_includes(tmp_path):
    from maskwright.plans.config import load

    (tmp_path / "base.toml").write_text('[allowlist]\nvalues = ["a"]\n[masking]\nmin_confidence = 0.9\n')
    (tmp_path / "main.toml").write_text('include = ["base.toml"]\n[allowlist]\nvalues = ["b"]\n')
    c = load(tmp_path / "main.toml")
    assert c.allow_values == ("a", "b") and c.min_confidence == 0.9
    (tmp_path / "loop.toml").write_text('include = ["loop.toml"]\n')
    with pytest.raises(ConfigError):
        load(tmp_path / "loop.toml")


def test_terms(spark):
    c = with_terms(OPEN.only(), ("secret plan", False, False), ("p[0-9]+", True, True))
    assert masked(spark, c, "Secret Plan p12 P12") == ["<TERM_1> <TERM_2> P12"]
    once = register_term(OPEN, "abc")
    assert register_term(once, "abc") is once and register_term(once, "d").keywords[0].words == ("abc", "d")


def test_search(spark):
    df = spark.createDataFrame([(1, "one Two\ntwo three"), (2, "none"), (3, None)], "i long, text string")
    hits = Q.search(df, Q.Query("two"), "i").orderBy("start").collect()
    assert [(r["i"], r["start"], r["line"], r["column"], r["snippet"]) for r in hits] == [(1, 4, 1, 5, "one Two two three"), (1, 8, 2, 1, "one Two two three")]
    assert Q.search(df, Q.Query("two", case=True), "i").count() == 1
    assert Q.search(df, Q.Query("^t(w|h)", pattern=True), "i").count() == 1
    assert Q.search(df, Q.Query("o", case=True), "i", limit=1).where("truncated").count() == 1
    assert Q.search(df, Q.Query(""), "i").count() == 0
    with pytest.raises(ValueError):
        Q.Query("(", pattern=True).java()


def test_reports(spark, tmp_path):
    engine = Engine(OPEN.only("email", "ipv4"))
    df = spark.createDataFrame([("f1", 'x\na@b.co, 10.0.0.7 "a@b.co"'), ("f2", "clean"), ("f3", None)], "f string, text string")
    rows = M.span_rows(engine, df, ["f"])
    assert {(r["kind"], r["name"], r["n"]) for r in R.statistics(rows).collect()} == {("detector", "email", 2), ("detector", "ipv4", 1), ("category", "contact", 2), ("category", "network", 1), ("total", "total", 3)}
    assert R.gate(rows).first() == (True, 1) and R.gate(rows.limit(0)).first() == (False, 0)
    import json

    report = {r["f"]: json.loads(r["report"]) for r in R.json_report(engine, df, "f", values=True).collect()}
    assert report["f1"]["stats"] == {"total": 3, "by_detector": {"email": 2, "ipv4": 1}, "by_category": {"contact": 2, "network": 1}} and report["f3"]["stats"]["total"] == 0
    assert (report["f1"]["detections"][0]["line"], report["f1"]["detections"][0]["column"], report["f1"]["detections"][0]["original"]) == (2, 1, "a@b.co")
    R.write_csv(R.csv_rows(engine, df, "f"), str(tmp_path / "csv"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert data.startswith("﻿file,line,column,id,category,name,confidence,replacement\r\n".encode()) and data.count(b"\r\n") == 4
    assert [tuple(r) for r in R.difference(M.mask(engine, df), "f").collect()] == [("f1", 2, 'a@b.co, 10.0.0.7 "a@b.co"', '<EMAIL_1>, <IPV4_1> "<EMAIL_1>"')]
    assert R.listing(rows, "f").orderBy("start").first()["line_text"] == "f1:2:1: email [Email address] 0.95"


def test_alignment_over_removed_lines(spark):
    engine = Engine(OPEN.only("private_key"))
    df = spark.createDataFrame([(1, "a\n-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----\nb")], "i long, text string")
    rows = M.mask(engine, df).select(F.explode(R.aligned(F.col("text"), F.col("masked"), F.col("replacements"))).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in rows] == [(1, 1), (2, 2), (3, None), (4, None), (5, 3)]


def test_list_detectors(spark):
    assert list_detectors(spark, OPEN.only("email")).where("enabled").select("id").collect()[0][0] == "email"


def test_lines_are_counted_once(spark):
    """Not for each line: the lines of a text and of its masked form are each counted in one place of the expression."""
    said = R.aligned(F.col("t"), F.col("m"), F.col("s"))._jc.toString()
    assert said.count("replace(t, ") == said.count("replace(m, ") == 1
