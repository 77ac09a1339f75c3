"""Text functions and analyzers against token lists worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lexispark.functions import matching, pinyin, text, tokens
from lexispark.plans.compile import within

FOLDS = ("測試", "测试")


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v"))).first()[0]


MIXED = "阿萨德;个梵蒂冈;鬼 地方个;aBC%*測試"


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (lambda c: tokens.delimited(c, ";", False), MIXED, ["阿萨德", "个梵蒂冈", "鬼 地方个", "aBC%*測試"]),
        (lambda c: tokens.delimited(c, ";"), MIXED, ["阿萨德", "个梵蒂冈", "鬼地方个", "abc测试"]),
        (tokens.whole_keep, "Abc@$測試", ["abc@$测试"]),
        (tokens.whole_strip, "aBC%*測試", ["abc测试"]),
        (text.strip_form, "鬼 地方个aBC%*測試", "鬼地方个abc测试"),
        (tokens.ngrams, "我是长沙ren", ["我", "我是", "我是长", "是", "是长", "是长沙", "长", "长沙", "沙"]),
        (tokens.single, "我是长沙ren", ["我", "是", "长", "沙", "ren"]),
        (text.half_width, None, ""),
        (text.half_width_or_null, None, None),
        (text.half_width, "Ａｂ　１", "Ab　1"),
        (text.space_form, "A-b.c_d&e", "a-b.c d e"),
        (lambda c: text.cut(c, 3), "  abcdef", "abc"),
        (lambda c: text.cut(c, 2, True), "ab 12 中国", "ab 12"),
        (tokens.characters, "ab中", ["a", "b", "中"]),
    ],
)
def test_values(spark, make, value, want):
    assert one(spark, make, value) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("tiananbaoxian", "tian an bao xian"),
        ("woaibeijintiananmen", "wo ai bei jin tian an men"),
        ("fujianjinan", "fu jian jin an"),
        ("shandongjinan", "shan dong jin an"),
        ("jinanren", "jin an ren"),
        ("zhiku", "zhi ku"),
        ("", ""),
        (None, ""),
        ("AB12", "a b 12"),
    ],
)
def test_syllables(value, want):
    assert pinyin.split_syllables(value) == want.split()


def test_readings_come_from_icu(spark):
    assert one(spark, pinyin.full_pinyin, "中国A1b") == "zhongguob"
    assert one(spark, pinyin.initials, "中国") == "zg"
    assert len(one(spark, tokens.single_pinyin, "内蒙古京新药业有限公司")) == 11
    assert one(spark, pinyin.full_pinyin, "女") == "nv"


def test_patterns_and_rank(spark):
    assert one(spark, lambda c: matching.keyword_positions(c, ["公司", "勇"]), "公勇勇") == {"勇": [1, 2]}
    assert matching.rescore_value(tuple("东莞明翔智能科技有限公司"), "东莞市明鑫翔智能科技有限公司") == 24541099531960320
    assert matching.rescore_value(("x", "y", "z"), "abc") == 0


def test_segmenter():
    s = tokens.Segmenter(("有限公司", "公司", "长沙"))
    assert s.cut("长沙abc有限公司") == ["长沙", "abc", "有限公司"]
    assert s.cut("有限公司", smart=False) == ["有限公司", "公司"]
    assert s.cut(None) == []


def test_edit_distance():
    assert within("that", "taht", 1, True) and not within("that", "taht", 1, False)
    assert within("ca", "abc", 3, True) and not within("ca", "abc", 2, True)  # swapped letters are left alone afterwards
    assert within("", "ab", 2, False) and not within("", "abc", 2, False)
