"""Header texts to canonical column names. Only header strings are handled here, on the driver."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

# The headers that name each canonical column; where one stands twice, the later column has it.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "name": ("氏名", "名前", "氏名(漢字)"),
    "kana": ("ﾌﾘｶﾞﾅ", "フリガナ", "ふりがな", "ｶﾅ"),
    "birth_date": ("生年月日", "生年月日(西暦)"),
    "birth_year_west": ("生年・西暦", "（生年・西暦）", "生年", "生年(西暦)", "生年（西暦）"),
    "license_no": ("登録番号", "免許番号", "資格番号", "登録No.", "登録№", "証明番号", "証明書番号", "証書番号", "認定番号", "番号", "No", "No."),
    "category": ("区分", "資格種類"),
    "registration_date": ("登録年月日", "登録日"),
    "continuation_status": ("継続",),
    "next_stage_label": ("次回区分",),
    "next_exam_period": ("次回サーベイランス/再評価受験期間", "次回サーベイランス期間", "次回ｻｰﾍﾞｲﾗﾝｽ/再評価受験期間", "次回／再評価受験期間", "次回受験期間"),
    "next_procedure_status": ("次回手続き状況",),
    "qualification": ("資格", "資格種別", "資格名称"),
    "process": ("溶接方法", "プロセス"),
    "material": ("材質", "材料", "母材"),
    "thickness": ("板厚", "径"),
    "test_date": ("試験日",),
    "issue_date": ("継続年月日", "交付年月日", "交付日", "発行日", "更新日", "発行年月日"),
    "expiry_date": ("有効年月日", "有効期限", "有効期限日", "有効期間", "有効期間満了日", "満了日"),
    "result": ("試験結果", "結果", "合否"),
    "notes": ("備考", "メモ"),
    "address": ("自宅住所", "住所", "住所（自宅）"),
    "web_publish_no": ("WEB申込番号", "WEB公開番号", "WEB申込No.", "WEB申込No"),
    "first_issue_date": ("取得年月日", "登録日", "取得日", "初回取得日"),
    "row_no": ("No.",),
}
DATE_COLUMNS = ("birth_date", "test_date", "first_issue_date", "issue_date", "expiry_date", "registration_date")

# What a header that no synonym fits must hold, each group of alternatives once; the first rule that fits.
RULES: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("name", (("氏名", "名前"),)),
    ("category", (("資格種別",),)),
    ("qualification", (("資格",),)),
    ("web_control_no", (("web",), ("番号",))),
    ("license_no", (("番号",), ("免許", "資格", "登録", "証"))),
    ("license_no", (("ライセンス",),)),
    ("test_date", (("試験",),)),
    ("first_issue_date", (("取得", "登録"), ("日",))),
    ("issue_date", (("継続", "交付"), ("日",))),
    ("expiry_date", (("有効",), ("年月日", "期限", "満了"))),
    ("issue_date", (("交付", "発行"),)),
    ("birth_date", (("生年月日",),)),
    ("birth_year_west", (("西暦", "生年"),)),
)


def header_token(text: str) -> str:
    """NFKC in lower case, without white space and bracketed parts."""
    return re.sub(r"\s+", "", re.sub(r"\(.*?\)|\[.*?\]", "", unicodedata.normalize("NFKC", text))).lower()


def header_map(extra: dict[str, Iterable[str]] | None = None) -> dict[str, str]:
    """Header text, and its token, to canonical name. extra: more headers for canonical columns, which come after the others."""
    out: dict[str, str] = {}
    for table in (SYNONYMS, extra or {}):
        for name, headers in table.items():
            for header in headers:
                out[header] = name
                out[header_token(header) or header] = name
    return out


def canonical_name(header: str, known: dict[str, str]) -> str:
    """The canonical name of a header, or the header itself."""
    text = header.strip()
    token = header_token(text)
    if text in known:
        return known[text]
    if token in known:
        return known[token]
    if token in ("no", "no."):
        return "row_no"
    for name, groups in RULES:
        if all(any(word in token for word in group) for group in groups):
            return name
    return text
