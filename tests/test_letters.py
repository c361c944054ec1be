"""Addresses with letters of any script are masked whole."""

from pyspark.sql import functions as F

from duskloom.functions import patterns as P
from duskloom.functions import spans as S
from duskloom.operators import detect as D

ADDRESSES = {
    "mail dahlström3@post.example.org, ok": ["dahlström3@post.example.org"], "почта иван@пример.рф": ["иван@пример.рф"], "x@münchen.de": ["x@münchen.de"], "a@b.io": ["a@b.io"],
    "zoë.k@example.com": ["zoë.k@example.com"], "é@": [], "@пример.рф": [], "見@例.jp、u@v.io": ["見@例.jp", "u@v.io"],
}


def test_letters_of_any_script(spark):
    rows = spark.createDataFrame(list(enumerate(ADDRESSES)), "id int, text string").select("id", D.recognized(F.col("text"), P.EMAIL).alias("s")).collect()
    for row in rows:
        text = list(ADDRESSES)[row.id]
        assert [s.value for s in row.s] == ADDRESSES[text], text
        assert all(text[s.start : s.end] == s.value for s in row.s)


def test_groups_are_counted_as_the_jvm_does():
    assert [S._groups(p) for p in (r"(a)(\(b)(c)", r"(^|[^(])(\+?(?:x)?)", r"(?i)a", "", r"([)(\]]+)(\))")] == [3, 2, 0, 0, 2]
