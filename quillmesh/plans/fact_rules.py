"""Financial metrics, units and guards of the rule pack: fixed values, as the documents word them."""

from __future__ import annotations

# How prose names a metric.
METRICS = {
    "投资现金净额": "投资活动(?:产生的)?(?:现金流量|净现金流|现金流)(?:量)?净额",
    "经营现金净额": "经营活动(?:产生的)?(?:现金流量|现金流)净额",
    "筹资现金净额": "筹资活动(?:产生的)?(?:现金流量|现金流)净额",
    "资产总额": "(?:资产总计|总资产|(?<!流动)资产合计)",
    "负债总额": "(?:(?<!流动)负债合计|总负债)",
    "净资产": "(?:所有者权益(?:合计)?|净资产)",
    "净利润": "(?<!扣除非经常性损益后)(?<!归属于母公司的)(?<!归属于母公司所有者的)(?<!归母)(?<!扣非)净利润",
    "营业收入": "(?:营业总收入|营业收入)",
    "营业成本": "营业成本",
    "毛利润": "(?:综合毛利润|营业毛利润|毛利润合计)",
    "资产负债率": "资产负债率",
    "流动比率": "流动比率",
}
# How table rows name a metric.
ROW_LABELS = {
    "资产总计": "资产总额", "资产总额": "资产总额", "总资产": "资产总额", "负债合计": "负债总额", "总负债": "负债总额",
    "所有者权益合计": "净资产", "所有者权益": "净资产", "净资产": "净资产", "营业收入": "营业收入", "营业收入合计": "营业收入",
    "营业总收入": "营业收入", "营业成本": "营业成本", "营业成本合计": "营业成本", "净利润": "净利润", "毛利润合计": "毛利润",
    "投资活动产生的现金流量净额": "投资现金净额", "经营活动产生的现金流量净额": "经营现金净额",
    "筹资活动产生的现金流量净额": "筹资现金净额", "资产负债率": "资产负债率", "流动比率": "流动比率",
}
RATIOS = {"资产负债率": "%", "流动比率": "倍"}
NUMBER = r"-?(?:[0-9]{1,3}(?:[,，][0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
UNIT_IN_LINE = r"单位[:：][\t-\r ]*(亿元|万元|元)"
# Words that decide whose figure it is.
SCENARIO = "发行后|模拟|调整后"
SHARE_COLUMN = "占比|比例|比重"
IMPACT_HEADINGS = "募集资金运用对.*财务|本次发行对.*财务|财务结构的影响|模拟"
OTHER_HEADINGS = "主要子公司|参股公司|关联方"
PARENT_HEADINGS = "母公司|本部"
BOTH_STATEMENTS = "合并[及和与]|合并.*母公司"
GUARANTOR_HEADINGS = "保证人|担保人"
SEGMENT_END = "(?:业务|板块|子公司).{0,12}$"
OWN_WORDS = "发行人|公司|集团|截至|年度|年末|月末|报告期"
# What a negative sentence denies.
DENIALS = "不存在|未发生|没有|不涉及|无重大"
DENIED = {"重大承诺": "重大承诺", "诉讼仲裁": "诉讼|仲裁|行政处罚", "违规担保": "违规担保", "对外担保": "对外担保", "关联担保": "关联.{0,5}担保|担保.{0,5}关联", "股权质押": "股权.{0,8}质押"}
CONTROLLERS = ("控股股东", "实际控制人")
# What a table is about, by its caption, title and header.
TABLE_MEASURES = {
    "资产负债表": "资产负债表",
    "现金流量表": "现金流量表",
    "利润表": "(?<!毛)利润表",
    "营业收入": "营业收入|主营业务收入",
    "营业成本": "营业成本|主营业务成本",
    "毛利润": "毛利润|毛利情况",
    "毛利率": "毛利率",
}
# What a sentence measures, by the words before its amounts.
LEADING_MEASURES = {
    **{name: name for name in ("其他业务收入", "其他业务成本", "其他业务毛利", "营业外收入", "其他收益", "资产处置收益", "公允价值变动收益", "投资收益", "营业收入", "营业成本", "净利润", "营业利润", "毛利润", "毛利率")},
    "资产总计": "总资产|资产总计",
    "负债总计": "总负债|负债总计|负债合计",
    "净资产": "净资产|所有者权益|股东权益",
}
AMOUNT_VERB = "分别(?:为|是)|(?:账面价值|余额|金额)(?:分别)?(?:为|是)"
BUSINESSES = {name: name for name in ("电力", "食品", "物业", "供水", "屠宰", "房地产", "住宅", "商业", "工程建设", "担保业务")}
PARTIES = {"客户": "客户|销售对象", "供应商": "供应商|采购对象"}
UNIT_WORD = "元|%|％|倍|平方|瓦|头|吨"
# Lines around a table, header cells and titles that say nothing of their own.
TABLE_CAPTION = r"^[\t-\r ]*表(?:[\t-\r ]*[:：]|[\t-\r ]*[0-9]+[\t-\r ]*[:：、.．]?)"
UNIT_LINE = r"^[\t-\r ]*单位[\t-\r ]*[:：]"
HEADER_CELL = r"^(?:项目|科目|指标|金额|比例|占比|单位|名称|本期|上期|余额|年末|年度|期间|[\t-\r 0-9年\-/月日度末（）()%％、.]+)$"
GENERIC_HEADING = r"^(?:[一二三四五六七八九十0-9]+[、．.]|[（(][一二三四五六七八九十0-9]+[）)])?[\t-\r ]*(?:核查|调查|分析)(?:情况|记录|结果|过程|程序|意见|结论)?$"
# Whose figures a heading opens, the first rule that a heading meets; an empty name decides nothing.
PARENT_LEAD = "发行人(?:本部|母公司)|母公司(?:口径|本部)"
SCOPE_HEADINGS = {
    "会计调整": "会计政策变更|会计估计变更|调整影响",
    "": "(?=.*(?:母公司|本部))(?:.*合并[及和与]|.*合并.*母公司)",
    "保证人": r"^(?:(?:[一二三四五六七八九十0-9]+[、.．]|[（(][0-9]+[）)])?[\t-\r ]*(?:保证人|担保人|增信主体)(?:的|基本|主要|财务|资信|信用|情况|$)|(?:第.{1,6}[节章][\t-\r ]*)?增信机制$)",
    "控股股东": "^(?!.*实际控制人).*控股股东",
    "实际控制人": "^(?!.*控股股东).*实际控制人",
    "发行人本部": "母公司|发行人本部|本部财务",
    "发行人": "合并(?:财务|资产|利润|现金|报表)",
}
NAMED_COMPANY = r"^([\x{4e00}-\x{9fff}A-Za-z（）()]{4,55}(?:有限公司|有限责任公司|股份有限公司))"
PROFILE = "成立|注册资本|经营范围"
