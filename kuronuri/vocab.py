"""Patterns, word lists and limits that decide which spans exist.

Everything in this module is data.  The values have to stay exactly as they are
for results to be right, so they are written out plainly, in their natural
order, and the code that uses them lives elsewhere.
"""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    """One detection pattern, in Python ``re`` syntax."""

    entity: str
    name: str
    regex: str
    score: float
    #: A text can only match when it holds at least one literal of every group.
    #: Used to skip the regex engine; never changes the result.
    needs: tuple[tuple[str, ...], ...] = ()
    #: A cheap pattern that every match contains, whatever the letter case.  Used
    #: as a filter in place of the pattern itself; never changes the result.
    hint: str = ""
    #: What every match begins with, whatever the letter case.  Tried before what the pattern looks
    #: back at; never changes the result.
    first: str = ""


CORPORATE = ("株式会社", "有限会社", "合同会社")

# The 19 detection patterns, in registration order.
PATTERNS: dict[str, Pattern] = {
    "det_email": Pattern(
        "EMAIL", "email_regex",
        r"(?<![\w\-\.])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})(?![\w\-\.])",
        0.99, (("@",),), first="[A-Za-z0-9._%+-]"),
    "det_phone": Pattern(
        "PHONE", "phone_regex",
        r"(?<!\d)(0\d{1,4}[-ー]?\d{1,4}[-ー]?\d{3,4})(?!\d)", 0.85, (("0",),),
        r"0\d{1,4}[-ー]?\d{1,4}[-ー]?\d{3}", "0"),
    "det_postal": Pattern(
        "ID", "jp_postal", r"(?<!\d)(\d{3}[-ー]?\d{4})(?!\d)", 0.95,
        (), r"\d{3}[-ー]?\d{4}", r"\d{3}"),
    "det_compact_id": Pattern(
        "ID", "compact_id", r"(?<![A-Za-z0-9])([A-Z]{1,3}\d{2,6})(?![A-Za-z0-9])", 0.80,
        (), r"[A-Za-zſ\u212a]\d{2}", "[A-Z]"),
    "det_hyphen_id": Pattern(
        "ID", "hyphenated_id",
        r"(?<![A-Za-z0-9])([A-Z]{2,10}-\d{2,4}(?:-[A-Z0-9]{1,6}){1,6})(?![A-Za-z0-9])",
        0.85, (("-",),), r"-\d{2,4}-", "[A-Z]{2}"),
    "det_name_line": Pattern(
        "PERSON", "jp_name_line_with_space",
        r"(?m)^[\t \u3000]*[一-龥]{1,4}[\t \u0020\u3000]+[一-龥]{1,4}[\t \u3000]*$", 0.86,
        (), r"[一-龥]"),
    "det_contact": Pattern(
        "PERSON", "tanto_single_surname", r"(?<=担当[:：])[一-龥]{2,4}", 0.82, (("担当",),)),
    "det_contact_paren": Pattern(
        "PERSON", "tanto_single_surname_paren",
        r"(?<=\(担当[:：])[一-龥]{2,4}(?=\))", 0.80, (("(担当",),)),
    "det_contact_fwparen": Pattern(
        "PERSON", "tanto_single_surname_fwparen",
        r"(?<=（担当[:：])[一-龥]{2,4}(?=）)", 0.80, (("（担当",),)),
    "det_age_colon": Pattern(
        "ID", "age_after_colon", r"(?<=年齢[:：])\d{1,3}", 0.75, (("年齢",),)),
    "det_age_line": Pattern(
        "ID", "age_standalone_line_before_gender",
        r"(?m)(?<=\n)\d{1,3}(?=\n(?:男|女)\n)", 0.78, (("\n男\n", "\n女\n"),)),
    "det_money": Pattern(
        "MONEY", "money_amount",
        r"(?:(?:[¥￥]\s*(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"
        r"|(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*(?:円|万円|千円|百万円)))",
        0.85, (("¥", "￥", "円"),), first=r"[¥￥\d]"),
    "det_ymd": Pattern(
        "DATE", "ymd",
        r"\d{4}[\/\.\-年]\s*\d{1,2}[\/\.\-月]\s*\d{1,2}\s*(日)?", 0.80,
        (), r"\d{4}[\/\.\-年]"),
    "det_wareki": Pattern(
        "DATE", "wareki", r"(令和|平成|昭和|R|H|S)\s*(\d{1,2}|元)\s*年", 0.75, (("年",),), first="[令平昭RHS]"),
    "det_address": Pattern(
        "ADDRESS", "addr_hint",
        r"(..??[都道府県].{1,30}?[市区町村].{0,40})", 0.55,
        (("都", "道", "府", "県"), ("市", "区", "町", "村"))),
    "det_company_prefix": Pattern(
        "COMPANY", "kabushiki_1", r"(株式会社|有限会社|合同会社)\s*\S{1,30}", 0.70,
        (CORPORATE,)),
    "det_company_suffix": Pattern(
        "COMPANY", "kabushiki_2", r"\S{1,30}\s*(株式会社|有限会社|合同会社)", 0.70,
        (CORPORATE,)),
    "det_company_abbr": Pattern(
        "COMPANY", "abbr", r"(（株）|\(株\))\s*\S{1,30}", 0.65, (("（株）", "(株)"),)),
    "det_parties": Pattern(
        "PARTIES", "parties", r"(?<!\w)(甲|乙|丙|丁)(?!\w)", 0.99,
        (("甲", "乙", "丙", "丁"),), first="[甲乙丙丁]"),
}

# Party definitions in a contract header.
PARTY_DEFINE = (
    r"(?m)(?:^|[。、，,\n・と])\s*(?P<entity>(?:[^\s（(「『。、，,]{2,60}?))\s*(?:（|\()\s*"
    r"以下\s*[「『｢\"](?P<label>[^」』｣\"]{1,20})[」』｣\"]\s*という\s*(?:。|）|\))"
)
PARTY_REVERSE = (
    r"(?m)[「『｢\"](?P<label>[^」』｣\"]{1,10})[」』｣\"]\s*(?:（|\()\s*(?P<entity>.{2,60}?)\s*(?:）|\))"
)
PARTY_ROLE = r"(?m)以下\s*[「『｢\"](?P<label>[^」』｣\"]{1,20})[」』｣\"]\s*という"

# Labels that stay readable in a masked contract.
TRADITIONAL_LABELS = ("甲", "乙", "丙", "丁", "戊", "己", "庚", "辛", "壬", "癸")
ROLE_NAMES = (
    "委託者", "受託者", "甲", "乙", "丙", "丁", "売主", "買主", "貸主", "借主", "賃貸人", "賃借人",
    "注文者", "請負人", "委任者", "受任者", "ライセンサー", "ライセンシー", "開示者", "受領者",
    "雇用者", "被雇用者", "出資者", "運営者", "本ベンダー", "本クライアント", "サービス提供者", "利用者",
)
STRUCTURAL_TERMS = (
    "本契約", "本覚書", "本合意書", "本協定", "本規約", "本約款", "本誓約書", "本件", "本取引",
    "本業務", "本サービス", "本製品", "本ソフトウェア", "本システム", "本書", "本条", "本項",
)
# Role words in front of a name, and particles around it.
NAME_ROLE_PREFIXES = ("委託者", "受託者", "売主", "買主", "貸主", "借主", "甲", "乙")
NAME_LEADING = ("と", "及び", "および", "・", "、", "，", "）", ")")
NAME_TRAILING = ("は", "が", "の", "を", "に", "と")

# Words that mark an amount of money.
MONEY_WORDS = (
    "円", "¥", "￥", "税込", "税抜", "合計", "総額", "対価", "報酬", "単価", "金額",
    "支払", "請求", "入金", "振込", "売買代金", "委託料", "利用料", "料金",
)
MONEY_WINDOW = 12

# The 47 prefectures, names with a three-character stem first.
PREFECTURES = (
    "神奈川県", "和歌山県", "鹿児島県", "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県",
    "福島県", "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "新潟県", "富山県",
    "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県", "滋賀県",
    "京都府", "大阪府", "兵庫県", "奈良県", "鳥取県", "島根県", "岡山県", "広島県", "山口県",
    "徳島県", "香川県", "愛媛県", "高知県", "福岡県", "佐賀県", "長崎県", "熊本県", "大分県",
    "宮崎県", "沖縄県",
)
# The default municipality list; order decides ties.
MUNICIPALITIES = (
    "東京都千代田区", "東京都中央区", "東京都港区", "東京都新宿区", "東京都文京区", "東京都台東区",
    "東京都墨田区", "東京都江東区", "東京都品川区", "東京都目黒区", "東京都大田区", "東京都世田谷区",
    "東京都渋谷区", "東京都中野区", "東京都杉並区", "東京都豊島区", "東京都北区", "東京都荒川区",
    "東京都板橋区", "東京都練馬区", "東京都足立区", "東京都葛飾区", "東京都江戸川区", "大阪府大阪市",
    "大阪府堺市", "神奈川県横浜市", "神奈川県川崎市", "愛知県名古屋市", "福岡県福岡市", "北海道札幌市",
)
ADDRESS_SPLIT = r"(..??[都道府県])(.*)"
ADDRESS_CITY = r"^(.{1,10}?[市区町村])"
DATE_WAREKI = r"(令和|平成|昭和|R|H|S)\s*(\d{1,2}|元)\s*年"
DATE_YMD = r"(\d{4})[\/\.\-年]\s*(\d{1,2})[\/\.\-月]\s*(\d{1,2})\s*(日)?"

# Company designators and the characters that end a company name.
COMPANY_DESIGNATORS = ("株式会社", "有限会社", "合同会社", "合名会社", "合資会社", "(株)", "（株）")
COMPANY_BOUNDARIES = " \t\r\n、。,.，．:：;；()（）[]［］{}｛｝<>＜＞《》【】「」『』\"'“”‘’・/\\|?!？!"
COMPANY_BODY_MAX = 80
MANUAL_LEFT = ("株式会社", "有限会社", "合同会社", "（株）", "(株)", "㈱")
MANUAL_RIGHT = ("株式会社", "有限会社", "合同会社")

# Entity priority for overlaps; anything else counts 0.
PRIORITIES = {
    "EMAIL": 100, "PHONE": 100, "ID": 100, "PERSON": 90, "ADDRESS": 90, "COMPANY": 80,
    "MONEY": 70, "DATE": 70, "KEYWORD": 60, "PARTIES": 10,
}
# Label templates; an entity without one gets ``[ENTITY_nn]``.
LABEL_FORMATS = {
    "PERSON": "[PERSON_{n:02d}]", "COMPANY": "[COMPANY_{n:02d}]", "ADDRESS": "[ADDRESS]",
    "EMAIL": "[EMAIL]", "PHONE": "[PHONE]", "MONEY": "[MONEY]", "DATE": "[DATE]", "ID": "[ID]",
    "PARTIES": "",
}

BLACK = "■"
HEAD_CHARS = 8000
DICT_COMPANY_SCORE = 0.995
DICT_KEYWORD_SCORE = 0.99
RECT_PAD = 0.5
SAME_LINE = 2.0
CONTEXT_WINDOW = 24
PREVIEW_CHARS = 28
RELOCATE_WINDOW = 200
