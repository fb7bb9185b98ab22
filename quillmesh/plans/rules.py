"""The rule pack of bond explanatory documents: word lists, patterns and thresholds, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# The terms that stand for a document's own date.
DATE_TERMS = (
    "本募集说明书签署之日", "本募集说明书签署日", "募集说明书签署之日", "募集说明书签署日",
    "本募集说明书出具之日", "本募集说明书出具日", "募集说明书出具之日", "募集说明书出具日",
    "本说明性文件出具之日", "本说明性文件出具日", "说明性文件出具之日", "说明性文件出具日",
    "本说明出具之日", "本说明出具日", "说明出具之日", "说明出具日",
)
DATE_WORDS = ("签署", "出具")  # one of them is in each term
# Voice words and what they become in a document of the issuer's own.
OWN_DATE = "本说明性文件出具日"
THIS_SOURCE, SOURCE = "本募集说明书", "募集说明书"
ISSUER_WORDS = ("发行人", "本公司")
COMPANY = "公司"
# Phrases that mark the body, facts, and tables that the target owns.
BODY_STARTS, BODY_ENDS, SEAL = "说明如下", "特此说明", "本页无正文"
FACT_WORDS = ("截至", "报告期", "具体情况如下", "情况如下表", "不存在已发行", "存在已注册", "累计发行")
FACT_ENDS = ("。", "；", ";", "：", ":")
STRONG_PHRASES = ("表决权", "控股股东及实际控制人", "持股比例", "注册资本", "资产负债率", "营业收入", "净利润")
TARGET_TABLE_WORDS = ("同行业", "同业对比", "可比公司", "平均水平", "项目组", "核查结论")
# Patterns of numbering shells and number forms.
HAN_DIGITS = "一二三四五六七八九十百"
LEAD = rf"^[\t-\r \x{{3000}}]*(?:[（(][{HAN_DIGITS}0-9]+[）)]|[{HAN_DIGITS}]+[、.]|[0-9]+[、.)）])[\t-\r \x{{3000}}]*"
LONG_LEAD = rf"^[\t-\r \x{{3000}}]*(?:第[{HAN_DIGITS}0-9]+[章节部分]|[（(][{HAN_DIGITS}0-9]+[）)]|[{HAN_DIGITS}]+[、.．]|[0-9]+(?:[.．][0-9]+)*[、.．)）])[\t-\r \x{{3000}}]*"
HEADING_START = rf"^(?:第[{HAN_DIGITS}0-9]+[章节]|[{HAN_DIGITS}]+[、.]|[（(][{HAN_DIGITS}0-9]+[）)]|[0-9]+[、.)）])"
PERCENTAGE = r"(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+\.[0-9]+|[0-9]+)%"
SELF_DATE = r"截至(?:本)?(?:募集说明书|说明性文件|说明)(?:签署|出具)?(?:之)?日"
PUNCTUATION = r"[\t-\r \x{3000}，。；：、“”‘’（）()《》]+"
UNIT_LINE = r"^[\t-\r \x{3000}]*单位[\t-\r \x{3000}]*[:：]"
CLAUSE = r"[^。；;]+[。；;]?"
TRAILING_HEADING = rf"[。；;][\t-\r \x{{3000}}]*([（(][{HAN_DIGITS}0-9]+[）)].{{2,100}})$"
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: The characters of SPACE.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Heading patterns by level, with the longest text of a heading of that level.
HEADING_LEVELS = (
    (0, rf"^第[{HAN_DIGITS}0-9]+[章节]", 160),
    (1, rf"^[{HAN_DIGITS}]+[、．.]", 89),
    (2, rf"^[（(][{HAN_DIGITS}]+[）)]", 89),
    (3, r"^[0-9]+[、．.][\t-\r \x{3000}]*[^0-9]", 79),
    (4, r"^[（(][0-9]+[）)]", 79),
    (5, r"^[0-9]+[)）]", 69),
)
NOT_HEADING = rf"^[\t-\r \x{{3000}}]*(?:单位[\t-\r \x{{3000}}]*[:：]|表[\t-\r \x{{3000}}]*[:：]|注[一二三四五0-9]*[:：])"


@dataclass(frozen=True)
class Thresholds:
    """Every number that decides something."""

    gram: int = 4
    index_chars: int = 4_000_000  # an index takes some 20 bytes for each
    candidates_by_hits: int = 45
    candidates: int = 8
    size_ratio: float = 4.0
    literal_weight: float = 0.88
    heading_chars: int = 55
    heading_literal: float = 0.76
    table_header: float = 0.58
    table_literal: float = 0.78
    table_weight: float = 0.72
    least_score: float = 0.30
    paragraph: float = 0.80
    short_paragraph: float = 0.88
    short_chars: int = 110
    context_paragraph: float = 0.82
    table: float = 0.67
    heading_context: float = 0.70
    near_blocks: int = 36
    close_blocks: int = 12
    behind_blocks: int = 15
    near_score: float = 0.45
    near_margin: float = 0.18
    close_bonus: float = 0.18
    near_bonus: float = 0.10
    behind_penalty: float = 0.03
    containment: float = 0.82
    drift_coverage: float = 0.78
    drift_ratio: float = 0.72
    drift_margin: float = 0.035
    phrase_bonus: float = 0.04
    clause_ratio: float = 0.95
    clause_length: float = 1.15
    clause_margin: float = 0.02
    clause_window: int = 10
    clause_chars: int = 20
    gap_blocks: int = 8
    unit_ratio: float = 0.92
    action_coverage: float = 0.72
    action_length: float = 0.78
    action_score: float = 0.60
    action_chars: int = 10
    fact_chars: int = 18
    fact_grams: int = 8


@dataclass(frozen=True)
class Units:
    """Money units and their value in ten thousand yuan."""

    scale: dict[str, str] = field(default_factory=lambda: {"亿元": "10000", "万元": "1", "元": "0.0001"})


THRESHOLDS = Thresholds()
