"""Goldens of the scalar functions."""

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.arrow import nfc

CASES = [
    (lambda c: X.dz_normalize(c, ["ནང"]), "ང་ ཡིག་ཚང་ ནང་ མེད", "ང་ཡིག་ཚང་ནང་ མེད།"),
    (X.dz_normalize, "མེད།", "མེད།།"),
    (lambda c: X.dz_normalize(c, idempotent=True), "མེད།", "མེད།"),
    (X.dz_normalize, "ཤིང་", "ཤིང་།"),
    (lambda c: X.dz_normalize(c, shad_after_ga=False), "འདུག", "འདུག།"),
    (lambda c: X.dz_normalize(c, shad_after_ga=False), "འདུག ང", "འདུག ང་།"),
    (X.dz_normalize, "  ", ""),
    (X.en_normalize, "to be honest  i really do not know", "To be honest, I really do not know."),
    (X.en_normalize, "in bhutan  we walk", "In bhutan, we walk."),
    (lambda c: X.en_normalize(c, F.lit(True)), "is it. yes", "Is it. Yes?"),
    (X.en_normalize, " ", ""),
    (X.is_dz_question, "ང་ ག", True),
    (X.is_dz_question, "", False),
    (lambda c: F.array_join(X.digits_in(c), ","), "མི་ཊར་༣༥༠ དེ ༡༠", "10,350"),
    (lambda c: F.array_join(X.digits_in(c), ","), "350 metres and 4,500", "350,4,500"),
    (lambda c: X.digit_conflict(c, F.lit("Ten officers")), "༡༠", False),
    (lambda c: X.digit_conflict(c, F.lit("11 officers")), "༡༠", True),
    (X.has_repetition, "a b c d " * 3, False),
    (X.has_repetition, "a b c d " * 4, True),
    (X.has_repetition, "a a a a a a a", False),
    (X.host_of, "https://User@WWW.Dzkuensel.bt:80/a", "user@www.dzkuensel.bt:80"),
    (X.host_of, "nourl", ""),
    (lambda c: X.swap_english(c, F.lit("apple"), F.lit("mango")), "I ate an apple and two apples", "I ate a mango and two mangos"),
    (lambda c: X.swap_english(c, F.lit("grass"), F.lit("tree")), "the grass", "the trees"),
    (lambda c: X.swap_english(c, F.lit("apple"), F.lit("apple tree")), "an apple", "an apple tree"),
    (lambda c: X.swap_english(c, F.lit("apple"), F.lit("mango")), "APPLES and an APPLE", "mangos and a mango"),
    (lambda c: X.swap_english(c, F.lit("a.b"), F.lit("$1\\c")), "a.bs axb", "$1\\cs axb"),
    (lambda c: X.swap_english(c, F.lit("pea"), F.lit("peas pod")), "pea peas", "peas pod peas pods"),
    (X.clean_sentence, "", ""),
    (X.clean_sentence, " \u00a0|\u2022 ", ""),
    (X.clean_sentence, "a \u00a0b\tc\x1cd", "a b c d"),
    (X.spaces_per_syllable, "ཀ་ ཁ་ ག་", 2 / 3),
    (X.tail_syllable, "ཡིག་ཚང་", "ཚང"),
    (X.tail_syllable, "་", ""),
    (X.capitalize, "nEW york", "New york"),
    (lambda c: X.respace(c, ["b"]), "a་ b་ c", "a་b་ c"),
    (X.clean_sentence, "༄༅ |- x | y |", "x y"),
    (X.script_ratio, "ཀཁ ab", 0.5),
    (X.script_ratio, "  ", 0.0),
    (nfc, "é", "é"),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_golden(spark, n):
    f, given, expected = CASES[n]
    df = spark.createDataFrame([(given,)], "c string")
    assert df.select(f(F.col("c")).alias("r")).first()[0] == expected


def test_null_stays_or_has_a_value(spark):
    df = spark.createDataFrame([(None,)], "c string").select(X.dz_normalize(F.col("c")), X.is_dz_question(F.col("c")), F.coalesce(X.host_of(F.col("c")), F.lit("")))
    assert tuple(df.first()) == (None, False, "")


def test_substitution_is_simultaneous_and_whole(spark):
    long = "1234567890123456789012345"
    rows = [("༡༠ དེ ༣༥༠", "10 and 350"), ("10 ༣༥༠", "10 and 350"), ("ཀ", "no number"), ("༡༠", "11"), (None, "1"), (long.translate(str.maketrans("0123456789", X.TIBETAN_DIGITS)), long)]
    df = spark.createDataFrame(rows, "dz string, en string")
    got = [r.s for r in df.select(X.substitute_digits(F.col("dz"), F.col("en"), F.lit("k")).alias("s")).collect()]
    assert got[1:5] == [None] * 4  # an ASCII number on the first side can't be replaced there
    for (dz, en), new in ((rows[0], got[0]), (rows[5], got[5])):
        back = [t.translate(str.maketrans(X.TIBETAN_DIGITS, "0123456789")) for t in (new.dz, new.en)]
        old, now = re.findall(r"\d+", en), re.findall(r"\d+", back[1])
        assert re.findall(r"\d+", back[0]) == now and list(map(len, old)) == list(map(len, now)) and all(a != b for a, b in zip(old, now))
        assert re.sub(r"\d", "", new.en) == re.sub(r"\d", "", en) and not any(n[0] == "0" for n in now)
