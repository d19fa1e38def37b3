"""Level-1 industries and the rules that resolve a stock's industry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 31 level-1 industries; the last is the catch-all.
INDUSTRIES = (
    "银行", "非银金融", "电子", "计算机", "医药生物", "食品饮料", "电力设备", "机械设备", "汽车", "基础化工", "有色金属", "钢铁",
    "煤炭", "石油石化", "建筑装饰", "建筑材料", "通信", "传媒", "商贸零售", "社会服务", "家用电器", "纺织服饰", "轻工制造", "交通运输",
    "国防军工", "公用事业", "环保", "房地产", "农林牧渔", "美容护理", "综合",
)
OTHER = "综合"
# Fixed value: the heading of a scraped page's table of industry boards.
BOARD_MARK = "所属行业板块"

# Parts of names that decide an industry, in the order in which they are tried.
BANK_HINTS = ("银行", "农行", "工行", "建行", "交行", "中行", "招行", "浦发", "兴业", "民生", "平安", "光大", "华夏", "北京", "宁波", "江苏", "上海", "南京", "杭州", "成都", "邮储", "中信")
BANK_WORDS = ("银行", "商行")
RULES = (
    ("非银金融", ("证券", "中信建投", "海通", "华泰", "广发", "国泰君安", "申万宏源", "东方财富", "招商证券", "国信", "光大证券")),
    ("非银金融", ("人寿", "太保", "新华保险")),
    ("食品饮料", ("茅台", "五粮液", "泸州老窖", "汾酒", "洋河", "古井贡", "今世缘", "青岛啤酒", "海天", "伊利", "东鹏饮料")),
    ("电力设备", ("宁德时代", "隆基", "通威", "阳光电源", "晶澳", "天合", "特变电工", "亿纬锂能", "国轩高科", "德业股份")),
    ("汽车", ("比亚迪", "长城汽车", "长安汽车", "上汽", "广汽", "福耀玻璃", "赛力斯", "拓普集团")),
    ("电子", ("中芯国际", "海光信息", "寒武纪", "北方华创", "韦尔", "中微", "澜起", "立讯精密", "京东方", "歌尔", "传音控股")),
    ("医药生物", ("恒瑞医药", "迈瑞医疗", "药明康德", "片仔癀", "云南白药", "爱尔眼科", "复星医药", "联影医疗", "智飞生物", "百济神州", "长春高新", "华东医药")),
    ("通信", ("中国移动", "中国电信", "中国联通", "中兴通讯")),
    ("计算机", ("科大讯飞", "金山办公", "三六零", "恒生电子", "用友网络", "同花顺")),
    ("房地产", ("万科", "保利", "招商蛇口", "华侨城", "金地集团")),
    ("石油石化", ("中国石油", "中国石化", "中国海油")),
    ("煤炭", ("中国神华", "陕西煤业", "兖矿能源", "潞安环能", "山西焦煤")),
    ("有色金属", ("紫金矿业", "洛阳钼业", "江西铜业", "天齐锂业", "赣锋锂业", "山东黄金", "中金黄金", "中国铝业", "北方稀土", "华友钴业")),
    ("建筑装饰", ("中国建筑", "中国中铁", "中国铁建", "中国交建", "中国电建", "中国能建")),
    ("建筑材料", ("海螺水泥", "北新建材")),
    ("交通运输", ("顺丰控股", "中远海控", "京沪高铁", "上海机场", "白云机场", "招商轮船")),
    ("家用电器", ("美的集团", "格力电器", "海尔智家", "三花智控")),
    ("商贸零售", ("中国中免", "王府井", "永辉超市")),
    ("钢铁", ("宝钢股份", "包钢股份", "华菱钢铁")),
    ("基础化工", ("万华化学", "华鲁恒升", "恒力石化", "荣盛石化", "盐湖股份")),
    ("公用事业", ("长江电力", "中国广核", "中国核电", "华能国际", "国电电力", "华能水电", "国投电力")),
    ("国防军工", ("中航沈飞", "中航西飞", "航发动力", "中航光电", "中国船舶", "中航重机")),
    ("机械设备", ("三一重工", "中联重科", "徐工机械", "潍柴动力", "恒立液压")),
)

# The level-1 industry of a sub-industry, as scraped labels name it.
SUB_INDUSTRIES = {
    "白酒": "食品饮料",
    "啤酒": "食品饮料",
    "食品加工": "食品饮料",
    "调味发酵品": "食品饮料",
    "乳品": "食品饮料",
    "银行": "银行",
    "证券": "非银金融",
    "保险": "非银金融",
    "多元金融": "非银金融",
    "半导体": "电子",
    "消费电子": "电子",
    "元件": "电子",
    "光学光电子": "电子",
    "显示器件": "电子",
    "电子化学品": "电子",
    "软件开发": "计算机",
    "IT服务": "计算机",
    "计算机设备": "计算机",
    "化学制药": "医药生物",
    "中药": "医药生物",
    "生物制品": "医药生物",
    "医疗器械": "医药生物",
    "医疗服务": "医药生物",
    "医药商业": "医药生物",
    "电池": "电力设备",
    "光伏设备": "电力设备",
    "风电设备": "电力设备",
    "电网设备": "电力设备",
    "乘用车": "汽车",
    "汽车零部件": "汽车",
    "商用车": "汽车",
    "通用设备": "机械设备",
    "专用设备": "机械设备",
    "自动化设备": "机械设备",
    "工程机械": "机械设备",
    "基础化工": "基础化工",
    "化学原料": "基础化工",
    "化学制品": "基础化工",
    "农化制品": "基础化工",
    "涤纶": "基础化工",
    "钾肥": "基础化工",
    "工业金属": "有色金属",
    "贵金属": "有色金属",
    "小金属": "有色金属",
    "金属新材料": "有色金属",
    "黄金": "有色金属",
    "铝": "有色金属",
    "铜": "有色金属",
    "煤炭开采": "煤炭",
    "焦炭": "煤炭",
    "炼油化工": "石油石化",
    "油服工程": "石油石化",
    "通信设备": "通信",
    "通信服务": "通信",
    "游戏": "传媒",
    "数字媒体": "传媒",
    "广告营销": "传媒",
    "影视院线": "传媒",
    "房地产开发": "房地产",
    "房地产服务": "房地产",
    "白色家电": "家用电器",
    "小家电": "家用电器",
    "厨卫电器": "家用电器",
    "航空装备": "国防军工",
    "航天装备": "国防军工",
    "地面兵装": "国防军工",
    "军工电子": "国防军工",
    "电力": "公用事业",
    "燃气": "公用事业",
    "铁路公路": "交通运输",
    "航空机场": "交通运输",
    "航运港口": "交通运输",
    "物流": "交通运输",
    "普钢": "钢铁",
    "特钢": "钢铁",
    "水泥": "建筑材料",
    "玻璃玻纤": "建筑材料",
    "房屋建设": "建筑装饰",
    "基础建设": "建筑装饰",
    "一般零售": "商贸零售",
    "专业零售": "商贸零售",
    "免税": "商贸零售",
}


def of_sub_industry(label: Column) -> Column:
    """The level-1 industry of a sub-industry, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SUB_INDUSTRIES.items() for x in pair]), label)


def scraped(page: Column) -> Column:
    """The sub-industry that a landed page names: the second cell, blank ones aside, of its first
    table on industry boards that has two; else null. Cells are taken without markup and blanks."""
    tables = F.filter(F.regexp_extract_all(page, F.lit("(?is)<table.*?</table>"), F.lit(0)), lambda t: F.contains(t, F.lit(BOARD_MARK)))
    cells = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit("(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), _plain), lambda c: c != "")
    return F.element_at(F.get(F.filter(F.transform(tables, cells), lambda c: F.size(c) >= 2), F.lit(0)), 2)


def _plain(cell: Column) -> Column:
    return F.regexp_replace(F.replace(F.regexp_replace(cell, "(?s)<[^>]*>", ""), F.lit("&nbsp;"), F.lit(" ")), r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def _any(name: Column, words: tuple[str, ...]) -> Column:
    return F.rlike(name, F.lit("|".join(words)))


def by_name(name: Column) -> Column:
    """The first rule that the name meets, else null."""
    out = F.when(_any(name, BANK_HINTS) & _any(name, BANK_WORDS), "银行")
    for industry, words in RULES:
        out = out.when(_any(name, words), industry)
    return out


def resolve(stocks: DataFrame, landed: DataFrame | None = None) -> DataFrame:
    """stocks: ts_code, name. landed: ts_code, sub_industry (as scraped). A rule on the name wins;
    then the sub-industry's industry, or the label itself; else the catch-all."""
    df, label = stocks, F.lit(None).cast("string")
    if landed is not None:
        df, label = df.join(landed, "ts_code", "left"), F.coalesce(of_sub_industry(F.col("sub_industry")), "sub_industry")
    return df.withColumn("industry", F.coalesce(by_name(F.col("name")), label, F.lit(OTHER))).drop("sub_industry")
