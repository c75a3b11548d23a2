"""Names, companies and places: golden rows of our own over the seed lexicon, with negatives."""

import pytest

from maskwright.operators import companies, names
from maskwright.operators.names import SEED
from maskwright.plans.config import Config
from maskwright.plans.engine import Engine


def found(text, dictionary=0.6, **more):
    return sorted({text[s:e] for s, e, _ in names.persons(SEED, text, dictionary, **more)})


PERSONS = [
    ("中村様、先日はどうも", ["中村"]), ("経理部木村健太様", ["木村健太"]), ("井上 陽子さんから", ["井上 陽子"]), ("ブラウンさん", ["ブラウン"]), ("森様", ["森"]), ("清水様高橋様", ["清水", "高橋"]),
    ("3日小林様", ["小林"]), ("営業部長斎藤様", ["斎藤"]), ("矢部様", ["矢部"]), ("氏名：松本 直樹です", ["松本 直樹"]), ("口座名義： サトウ ハナコ", ["サトウ ハナコ"]),
    ("担当: アオバ商事株式会社営業部 田中", ["田中"]), ("経理の池田と申します。", ["池田"]), ("窓口の長谷川が対応します", ["長谷川"]), ("石井課長が来た", ["石井"]), ("係長の岡田に", ["岡田"]),
    ("営業部 前田まで", ["前田"]), ("本日遠藤が確認します", ["遠藤"]), ("以上、坂本より", ["坂本"]), ("三浦・中野・原田の3名", ["三浦", "中野", "原田"]), ("今日は高橋美咲が話す", ["高橋美咲"]),
    ("五百旗頭 太郎さんから", ["五百旗頭 太郎"]), ("商事 太郎さん", ["太郎"]), ("with Ms. Alice Green", ["Alice Green"]), ("Hi Emily,", ["Emily"]), ("Kind regards,\nPeter Stone\n", ["Peter Stone"]),
    ("Best regards, Peter Stone", ["Peter Stone"]), ("Reviewer: Anna B. Clark", ["Anna B. Clark"]), ("ask Yamada-san", ["Yamada"]), ("Ito san is in", ["Ito"]), ("Taro SUZUKI came", ["Taro SUZUKI"]),
    ("Meeting Susan Walker", ["Susan Walker"]), ("From: Jane Doe<jane@x.org>", ["Jane Doe"]), ("Customer: Paul Hill (Sales)", ["Paul Hill"]),
]
NEGATIVES = [
    "お客様へ", "皆様、ご担当者様", "申請様式と仕様", "顧客氏名の欄", "看護師さん", "お疲れ様です", "担当：未定", "八百屋さん", "本日の会議室は情報管理部で東京都庁の予定", "東京に連絡", "室内田園の部の森林",
    "Hi team,", "Hello World!", "Thanks, Bye", "const OWNER: Token = make();", "    owner: Option<String>,", "Puerto san", "THE END", "The quick brown fox jumps. A New Day in the Old Town.",
    "def f(name: str) -> None:\n    return {'to': 'b'}", "let user = Account::new();\nif x > 3 { run(\"Main Street\") }", "Estimados vecinos: la plaza queda lejos. Guten Tag, wie geht es Ihnen?",
]


@pytest.mark.parametrize(("text", "want"), PERSONS)
def test_persons(text, want):
    assert found(text) == want


@pytest.mark.parametrize("text", NEGATIVES)
def test_no_persons(text):
    assert found(text) == []


def test_surer_names_and_thresholds():
    t = "田中様と月影様"
    sure = {t[s:e]: c for s, e, c in names.persons(SEED, t, None)}
    assert sure == {"田中": 0.9, "月影": 0.75}
    assert found("佐藤") == [] and found("佐藤", 0.5) == ["佐藤"] and found("James Bond") == [] and found("James Bond", 0.5) == ["James Bond"]
    assert SEED.surname_like("月岡") is True and not SEED.surname_like("新規") and SEED.split("山田太郎") == 2


COMPANIES = [
    ("ミナト物産株式会社", ["ミナト物産株式会社"], []), ("株式会社ミナト物産", ["株式会社ミナト物産"], []), ("ミナト（有）と㈱カモメ", ["ミナト（有）", "㈱カモメ"], []), ("株式会社ミナト物産御中", ["株式会社ミナト物産"], []),
    ("株式会社ミナト物産総務部木村様", ["株式会社ミナト物産"], ["木村"]), ("ミナト物産株式会社大阪支店長", ["ミナト物産株式会社"], []), ("株式会社ミナト物産木村健太", ["株式会社ミナト物産"], ["木村健太"]),
    ("株式会社木村製作所", ["株式会社木村製作所"], []), ("株式会社Sea Gull Trading Asia", ["株式会社Sea Gull Trading Asia"], []), ("deal with Sea-Gull 株式会社", ["Sea-Gull 株式会社"], []),
    ("弊社ミナト物産株式会社", ["ミナト物産株式会社"], []), ("2023年度ミナト物産株式会社", ["ミナト物産株式会社"], []), ("木村様ミナト物産株式会社", ["ミナト物産株式会社"], []),
    ("カモメ通信株式会社ミナトシステム", ["カモメ通信株式会社ミナトシステム"], []), ("当社は株式会社です", [], []), ("株式会社とは", [], []), ("株式会社化", [], []), ("株式会社の設立", [], []),
]


@pytest.mark.parametrize(("text", "firms", "people"), COMPANIES)
def test_companies(text, firms, people):
    got = companies.analyze(SEED, text)
    assert ([text[s:e] for s, e, _ in got[0]], [text[s:e] for s, e, _ in got[1]]) == (firms, people)


def test_places_and_morphology():
    t = "横浜市に在住、渋谷駅から大阪府"
    assert [t[s:e] for s, e, _ in names.places(SEED, t)] == ["横浜市", "渋谷駅", "大阪府"]
    nouns = lambda line: [(0, 2, "surname"), (2, 4, "given"), (5, 7, "organisation")] if line.startswith("黒鉄") else []
    assert found("x\n黒鉄朱音、暁社", None, morphology=nouns) == ["黒鉄朱音"] and [c for _, _, c in names.firms(SEED, "黒鉄朱音、暁社", nouns)] == [0.55]
    assert any("morphological" in w for w in Engine(Config(use_morphology=True)).warnings) and not Engine(Config(use_morphology=True), morphology=nouns).warnings


def test_lexicon_from_files(tmp_path):
    (tmp_path / "s.txt").write_text("# ours\n黒鉄\n", encoding="utf-8")
    lx = names.Lexicon.read(surnames=str(tmp_path / "s.txt"))
    assert lx.surnames == {"黒鉄"} and lx.given == SEED.given


def test_the_choice_of_texts_loses_no_name(spark):
    """Whatever the readers find is in a text that the JVM lets through."""
    from pyspark.sql import functions as F

    texts = [t for t, _ in PERSONS] + NEGATIVES + [t for t, _, _ in COMPANIES]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    passed = {r["text"] for r in df.filter(names.worth_reading(SEED, F.col("text"), ["person_name"], True)).collect()}
    assert {t for t in texts if found(t, 0.0)} <= passed and "The quick brown fox jumps. A New Day in the Old Town." not in passed


def test_city_from_a_known_place(spark):
    from pyspark.sql import functions as F

    engine = Engine(Config(allow_domains=()).only("address_jp_city"))
    df = spark.createDataFrame([(0, "田中横浜市中区見本町1-2-3"), (1, "見本市中区見本町1-2-3")], "i long, text string")
    got = engine.detect(df).select("i", F.explode("spans").alias("x"), F.expr("substring(text, x.start + 1, x.end - x.start)").alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == ["横浜市中区見本町1-2-3", "見本市中区見本町1-2-3"]
