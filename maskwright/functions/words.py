"""Words of fixed meaning around names, companies and places, and the seed lexicon.

Fixed values: every list from HONORIFICS to OWN_GIVEN_WORDS has to hold just these words for right results, so each is
given whole and in its natural order. The seed lexicon below them is a small choice of our own, to be replaced by lists of any size.
"""

# Forms of address and what is no such form.
HONORIFICS = "様 さま さん くん 君 ちゃん 殿 氏 先生 先輩".split()
HONORIFIC_KANJI = "様殿氏"
COMPOUNDS = "様式 様子 様相 様態 様変 氏名 氏族 氏神 殿下 殿堂 殿方 殿様 君主 君臨 君子 先生方 先輩方".split()
ADDRESS_TERMS = "御中 各位 様 殿 宛 気付".split()
ROMAJI_HONORIFICS = "san sama sensei kun chan dono".split()
EN_TITLES = "Mr Mrs Ms Miss Mx Dr Prof".split()
GREETINGS = "Dear Hi Hello Hey".split()
CLOSINGS = ("Regards", "Best regards", "Kind regards", "Sincerely", "Best", "Cheers", "Thanks", "Thank you")

# Labels before a name, and phrases around one.
JP_LABELS = (
    "氏名 名前 お名前 担当者名 担当者 担当 宛先 宛名 差出人 送信者 作成者 記入者 承認者 申請者 依頼者 契約者 代表者 受取人 名義人 口座名義 "
    "フルネーム ご芳名 芳名 患者名 利用者名 顧客名 会員名 署名"
).split()
EN_LABELS = (
    "name", "full name", "contact person", "contact", "attn", "attention", "author", "reviewer", "assignee", "reporter", "owner", "requester", "approver",
    "customer", "client", "employee", "patient", "signed by", "from", "to", "cc",
)
AFTER_OWN_NAME = "と申します と申す者 でございます".split()
BEFORE_OWN_NAME = "担当の 担当者の 営業の 窓口の 担当は 担当者は 窓口は 私、 私は わたくし、 わたくしは".split()
AFTER_INTRODUCED = "です が担当 が対応 より から".split()
EXECUTIVES = "代表取締役社長 代表取締役 取締役 代表者 理事長".split()

# Titles, units of organisations and departments.
TITLES = (
    "代表取締役社長 代表取締役会長 代表取締役 取締役社長 取締役 執行役員 代表理事 理事長 理事 副社長 社長 会長 専務 常務 監査役 事業部長 本部長 支店長 支社長 工場長 "
    "所長 店長 部長代理 課長代理 部長 次長 課長 係長 室長 局長 主任 主査 院長 校長 園長 学長 館長 班長 組長 議長 署長 担当者 担当"
).split()
TITLE_SUFFIXES = "社長 会長 副社長 専務 常務 部長 次長 課長 係長 室長 所長 店長 局長 主任 支店長 支社長 工場長 本部長 事業部長".split()
ORG_TAILS = "部課係室社局店所班科会団省庁当者先宛各御貴弊"
ORG_UNITS = "本社 支社 支店 営業所 事業所 事業部 本部 出張所 工場 研究所".split()
UNIT_KANJI = "部課室係"
DEPARTMENTS = (
    "営業推進 営業企画 営業 総務 人事 経理 財務 会計 開発 研究開発 技術 製造 生産 企画 経営企画 広報 法務 知財 購買 調達 資材 物流 品質管理 品質保証 品質 情報システム "
    "システム 情報 管理 業務 事業 海外 国際 販売 マーケティング サポート カスタマーサポート 設計 施工 工務 第一 第二 第三 第四 第五 秘書 監査 内部監査 庶務 施設 保守 運用"
).split()

# Companies.
LEGAL_FORMS = (
    "株式会社 有限会社 合同会社 合資会社 合名会社 一般社団法人 一般財団法人 公益社団法人 公益財団法人 特定非営利活動法人 NPO法人 ＮＰＯ法人 医療法人社団 医療法人財団 "
    "医療法人 学校法人 社会福祉法人 独立行政法人 国立大学法人 宗教法人 社団法人 財団法人 (株) （株） ㈱ (有) （有） ㈲ (同) （同）"
).split()
NOT_COMPANY = (
    "弊社 当社 御社 貴社 同社 他社 各社 親会社 子会社 取引先 宛先 顧客 契約先 発注先 委託先 納品先 請求先 送付先 提出先 担当者 担当 本日 今回 前回 次回 新 旧 元 現"
).split()
FUNCTION_WORDS = "with and or to from for by at of the a an in on via dear attn is was are were be contact contract thanks thank you please".split()

# Words that show that a name is near, and words that are none.
PERSON_CONTEXT = "名 人 氏 様 さん 各位 殿 君 先生 担当 出席 参加 欠席 同席 メンバー 社員 職員 委員 以上 宛 参加者 出席者 欠席者 担当者 連名".split()
SEPARATORS = "・ 、 ， , ／ / と や 及び および".split()
PARTICLES = "が は に と から より へ も".split()
ACTIONS = (
    "担当 対応 連絡 確認 相談 依頼 報告 出席 参加 欠席 同席 同行 在席 不在 退職 入社 異動 休暇 返信 回答 承認 説明 発言 記入 作成 送付 提出 共有 電話 メール 伝え 話し "
    "話す 言っ 言う 聞い 聞く 申し 頼ん 頼む 会っ 会う お願い 宛て"
).split()
SINGLE_SURNAMES = "林森関東西南北堀辻泉岡原谷沢菊楠桜梅滝藤門丸角城島坂岩峰岸宮星牧杉柳桐榎柴畑浜嶋舘乾巽楓"
DATE_UNITS = "年月日時分秒"
BAD_ENDINGS = "師士員者人長家"
SHOPS = "八百屋 魚屋 花屋 本屋 酒屋 肉屋 米屋 床屋 薬屋 問屋 部屋 茶屋 質屋 古本屋 パン屋".split()
NO_NAME = (
    "皆 各位 客 関係者 担当者 担当 利用者 管理者 先方 貴社 御社 弊社 当社 同社 他社 読者 奥 神 王 仏 母 父 兄 姉 弟 妹 息子 娘 子 孫 夫 妻 嫁 旦那 彼 彼女 相手 上司 部下 同僚 "
    "後輩 先輩 学生 生徒 患者 医者 業者 店員 社員 職員 会員 苦労 世話 馳走 愁傷 陰 嬢 主人 家族 殿 様 貴殿 貴方 貴女 本人 当人 同氏 自分 私 僕 俺 我 人 方 大家 家主 住人 隣人 "
    "友人 恋人 先生 教授 顧客 顧問 役員 代表 取引先 講師 作者 著者 筆者 選手 監督 知事 大臣 総理 議員 天皇 陛下 殿下 王子 姫 菩薩 如来 地蔵 看護師 運転手 医師 弁護士 税理士 "
    "会計士 技師 職人 配達員 警察 駅員 営業 管理人 未定 不明 同上 無し なし 空欄 省略 様式 仕様 同様 模様 多様 異様 有様 一様 お客 お疲れ ご苦労 ユーザー ゲスト オーナー "
    "メンバー スタッフ ドクター マスター クライアント カスタマー パパ ママ ボス プロ ファン サポート チーム ベンダー パートナー"
).split()
NO_EN_NAME = (
    "Team", "All", "Everyone", "There", "World", "Sir", "Madam", "Guys", "Folks", "Customer", "Support", "Admin", "Sales", "Friends", "Colleagues", "Hello",
    "Thanks", "Best", "Regards", "Hiring Manager", "Team Members", "Me", "You", "Us", "The", "This", "That", "It", "Unknown", "None", "Null", "Yes", "No",
    "Please", "Subject", "Re", "Fwd", "Date", "Sent", "Mr", "Mrs", "Ms", "Miss", "Mx", "Dr", "Prof", "String", "Str", "Option", "Some", "Vec", "Box", "Result",
    "Ok", "Err", "Self", "Token", "Value", "Object", "Integer", "Boolean", "Number", "Int", "Bool", "Char", "Byte", "Bytes", "Array", "List", "Map", "HashMap",
    "Dict", "Any", "Void",
)
CODE_STARTS = ("const ", "static ", "let ", "var ", "val ", "pub ", "fn ", "def ", "private ", "public ", "protected ", "readonly ", "type ")
NO_EN_GIVEN = (
    "Will May June April August Mark Bill Grant Chase Hope Faith Joy Grace Page Guy Art Don Ray Frank Rich Sky Star Dawn Major Royal Price Case Long Young Else Van Del "
    "Son Man An In Le La Lu Ok Sun Page Sterling Hunter Miles Dean Lane Rose Summer Winter Autumn Crystal Amber Destiny Harmony Trinity Unique Precious Justice King Duke "
    "Earl Baby Sunny Honey Angel Mercy Patience Constance Christian Norman Wade Drew Gene Carol Ben Tom Jean Lou Ed Al Mac Max Rob"
).split()
NO_EN_SURNAME = (
    "The And For With From This That Street Avenue Road Inc Corp Ltd Company University College School Hospital Center Centre Group Team Department Office"
).split()
NO_SURNAME_KANJI = "事業社所部課係室局店班科会団院校園省庁署員者人長師士様殿氏的性化型式用等及並又其此彼何毎各全諸第約計件予定済可否無非未再新旧最超"
ORG_KANJI = "事社所業部課会店局団院校園"

# Places.
PLACE_ENDS = "在住 出身 市 区 町 村 郡 駅 県 府".split()
MAJOR_PLACES = (
    "日本 北海道 青森 岩手 宮城 秋田 山形 福島 茨城 栃木 群馬 埼玉 千葉 東京 神奈川 新潟 富山 石川 福井 山梨 長野 岐阜 静岡 愛知 三重 滋賀 京都 大阪 兵庫 奈良 和歌山 鳥取 "
    "島根 岡山 広島 山口 徳島 香川 愛媛 高知 福岡 佐賀 長崎 熊本 大分 宮崎 鹿児島 沖縄 札幌 仙台 横浜 川崎 名古屋 神戸 北九州 那覇 関東 関西 東北 九州 四国 中部 近畿 北陸 "
    "東海 山陰 山陽 首都 都内 県内 市内 国内 海外 中国 韓国 米国 英国 台湾 香港 欧州"
).split()
OWN_GIVEN_WORDS = (
    "未来 大地 真実 勝利 正義 光明 和平 健康 希望 平和 自由 栄光 青空 太陽 元気 正直 誠実 昭和 平成 令和 大正 明治 慶応 文化 文政 天保 安政 一番 大和 日本 永遠 満天"
).split()

# The seed lexicon: a small choice of common names and places.
SURNAMES = (
    "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 林 斎藤 清水 山崎 森 池田 橋本 阿部 石川 山下 中島 "
    "石井 小川 前田 岡田 長谷川 藤田 後藤 近藤 村上 遠藤 青木 坂本 斉藤 福田 太田 西村 藤井 金子 岡本 藤原 三浦 中野 中川 原田 松田 竹内 小野 田村 "
    "月岡 里見 五島 百田 旗手 石頭 大久保 東海林 矢部 服部 阿久津 堀"
).split()
GIVEN = (
    "太郎 次郎 三郎 一郎 花子 健一 健太 大輔 翔太 直樹 和也 誠 隆 浩 明 学 剛 正 美咲 陽子 恵子 由美 直美 桜 葵 結衣 愛 優子 真由美 さくら 裕子 智子 亮 拓也 翼 蓮 未来"
).split()
EN_GIVEN = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Paul Steven Andrew George Kevin Brian Edward Peter Alice "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Emily Emma Anna Laura Julia Maria Sophie Hans Klaus Pierre Marie Carlos Ana"
).split()
EN_SURNAMES = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Wilson Anderson Taylor Thomas Moore Jackson Martin Lee Thompson White Harris Clark "
    "Lewis Robinson Walker Allen Wright Scott Green Baker Adams Nelson Hill Campbell Mitchell Roberts Carter Phillips Evans Turner Parker Collins Edwards Stewart Morris"
).split()
ROMAJI_SURNAMES = "sato suzuki takahashi tanaka ito watanabe yamamoto nakamura kobayashi kato yoshida yamada sasaki yamaguchi matsumoto inoue kimura hayashi saito shimizu mori ikeda".split()
ROMAJI_GIVEN = "taro jiro ichiro hanako kenji kenichi kenta daisuke shota naoki kazuya makoto takashi hiroshi akira misaki yoko keiko yumi naomi sakura aoi yui yuko".split()
PLACES = "東京 横浜 大阪 名古屋 札幌 神戸 京都 福岡 川崎 広島 仙台 千葉 埼玉 新宿 渋谷 品川 池袋 上野 銀座 梅田 難波 博多 天神 千代田 中央 世田谷 練馬".split()
