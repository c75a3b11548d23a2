"""The command line, editing of settings, and the registered queries against their SQL."""

import io

import duckdb
import pytest

from maskwright import __main__ as cli
from maskwright.plans import settings
from maskwright.plans.config import Config, ConfigError, loads
from maskwright.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def call(spark, *argv, stdin=None, monkeypatch=None):
    out = io.StringIO()
    if stdin is not None:
        monkeypatch.setattr("sys.stdin", io.StringIO(stdin))
    code = cli.run(spark, cli.arguments(list(argv)), out)
    return code, out.getvalue()


def test_command_line(spark, tmp_path, monkeypatch):
    assert call(spark, "mask", "-t", "a@b.co x@y.zz a@b.co", "--only", "email") == (0, "<EMAIL_1> <EMAIL_2> <EMAIL_1>\n")
    lines = "a@b.co\nnone\nc@d.co a@b.co\n"
    assert call(spark, "mask", "--lines", "--only", "email", stdin=lines, monkeypatch=monkeypatch) == (0, "<EMAIL_1>\nnone\n<EMAIL_2> <EMAIL_1>\n")
    assert call(spark, "mask", "--lines", "--per-document", "--only", "email", stdin=lines, monkeypatch=monkeypatch)[1].endswith("<EMAIL_1> <EMAIL_2>\n")
    assert call(spark, "mask", "-t", "a@b.co", "--only", "email", "--template", "[{label}]")[1] == "[EMAIL]\n"
    assert call(spark, "detect", "-t", "x\n a@b.co", "--only", "email", "--values")[1] == "-:2:2: email [Email address] 0.95 a@b.co\n"
    assert call(spark, "check", "-t", "a@b.co", "--only", "email") == (1, "found\n") and call(spark, "check", "-t", "no", "--only", "email") == (0, "nothing found\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("10.1.2.3")
    assert call(spark, "mask", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--only", "ipv4")[1].strip().endswith("a.masked.txt")
    assert (tmp_path / "out" / "a.masked.txt").read_text() == "<IPV4_1>"
    assert call(spark, "check", str(tmp_path / "in" / "a.txt"), "--only", "ipv4")[0] == 1
    assert call(spark, "list")[1].count("\n") == 67


TEXT = '# ours\n[masking]\ntemplate = "[{label}]"  # short\n\n[allowlist]\nvalues = [\n  "a",\n  "b",\n]\n'


def test_editing_keeps_comments(tmp_path):
    new = settings.set_value(TEXT, "masking.template", "<{label}>")
    assert new == TEXT.replace('"[{label}]"', '"<{label}>"')
    new = settings.set_value(new, "masking.min_confidence", 0.7)
    new = settings.set_value(new, "allowlist.values", ["c"])
    new = settings.set_value(new, "detectors.email.enabled", False)
    c = loads(new)
    assert new.startswith("# ours\n") and "# short" in new and (c.template, c.min_confidence, c.allow_values, c.detector_enabled("email")) == ("<{label}>", 0.7, ("c",), False)
    assert settings.get(new, "masking.min_confidence") == 0.7 and settings.get(new, "no.such") is None
    assert loads(settings.unset(new, "detectors.email.enabled")).detector_enabled("email")
    assert settings.parse_value("0.5") == 0.5 and settings.parse_value("<x>") == "<x>"
    with pytest.raises(ConfigError):
        settings.set_value("[broken", "a.b", 1)
    merged = loads(settings.imported(TEXT, '[allowlist]\nvalues = ["b", "z"]\n[[custom_rules]]\nid = "r"\npattern = "x"\n'))
    assert merged.allow_values == ("a", "b", "z") and merged.rules[0].pattern == "x"
    path = tmp_path / "s.toml"
    path.write_text(TEXT)
    assert cli.edit(cli.arguments(["--config", str(path), "config", "set", "masking.min_confidence", "0.9"]), io.StringIO()) == 0 and loads(path.read_text()).min_confidence == 0.9


def test_diagnosis_has_no_values(spark):
    rows = settings.diagnose(spark, Config(allow_values=("secret value",), hash_salt="pepper"))
    assert not any("secret" in v or "pepper" in v for _, v in rows) and ("hash salt", "set") in rows


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: Queries that differ from another one here only in a template or a projection; the driver's comparison runs them too.
ALIKE = {"stats_by_category", "mask_fill", "mask_parts", "mask_patterns", "numbering_per_doc", "overlap_raw", "counts_by_document", "detection_filter", "csv_report", "labels_spans", "batch_summary", "conversations_masked"}


@pytest.mark.parametrize("name", [k for k in ORACLES if not k.startswith("det_") and k not in ALIKE])
def test_queries_equal_their_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = tables.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*[f"`{c}`" for c in cols]).collect()) and want
