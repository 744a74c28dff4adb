import pytest
from pyspark.sql import functions as F

from tidepool.functions import text as tx


def _one(spark, col_expr, value):
    return spark.createDataFrame([(value,)], "t string").select(col_expr.alias("x")).first()["x"]


def test_standard_tokens(spark):
    assert _one(spark, tx.tokens("t"), "Hello, World! 42x  café") == ["hello", "world", "42x", "café"]
    assert _one(spark, tx.tokens("t"), None) is None


def test_english_tokens_drop_stop_words_and_non_ascii(spark):
    assert _one(spark, tx.tokens("t", "english"), "The cat is on the café mat") == ["cat", "caf", "mat"]


def test_chinese_tokens(spark):
    assert _one(spark, tx.tokens("t", "chinese"), "数据湖底座") == ["数据", "据湖", "湖底", "底座"]
    assert _one(spark, tx.tokens("t", "chinese"), "湖") == ["湖"]
    assert _one(spark, tx.tokens("t", "chinese"), "Spark数据 lake") == ["spark", "数据", "lake"]
    assert tx.keyword_tokens("Spark数据 lake", "chinese") == ["spark", "数据", "lake"]
    assert tx.keyword_tokens("数据湖底座", "chinese") == ["数据", "据湖", "湖底", "底座"]


def test_keyword_refusal():
    with pytest.raises(ValueError):
        tx.keyword_tokens("")
    with pytest.raises(ValueError):
        tx.keyword_tokens("   ")
    with pytest.raises(ValueError):
        tx.keyword_tokens(" ,;! ")
    assert tx.keyword_tokens("It's  MIT   License") == ["it", "s", "mit", "license"]


def test_quote_in_keyword_is_data(spark):
    df = spark.createDataFrame([("o'brien said",), ("obrien",)], "t string")
    assert df.where(tx.match_any("t", "o'brien")).count() == 1  # tokens o, brien; "obrien" is one other token
    assert df.where(tx.like_search("t", "o'brien", "contains")).count() == 1


def test_regex_and_array_match_agree(spark):
    rows = [("Released under the MIT License.",), ("licensed under mit",), (None,), ("MIT-License",), ("",)]
    df = spark.createDataFrame(rows, "t string")
    toks = tx.keyword_tokens("MIT license")
    arr = F.coalesce(F.arrays_overlap(tx.tokens("t"), F.array(*[F.lit(t) for t in toks])), F.lit(False))
    allf = F.coalesce(F.size(F.array_except(F.array(*[F.lit(t) for t in toks]), tx.tokens("t"))) == 0, F.lit(False))
    got = df.select(tx.match_any("t", toks).alias("a"), arr.alias("b"), tx.match_all("t", toks).alias("c"),
                    allf.alias("d")).collect()
    for r in got:
        assert r["a"] == r["b"] and r["c"] == r["d"]
    assert [r["a"] for r in got] == [True, True, False, True, False]
    assert [r["c"] for r in got] == [True, False, False, True, False]


def test_null_field_never_matches_and_not_agrees(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.where(tx.match_any("t", "x")).count() == 0
    assert df.where(~tx.match_any("t", "x")).count() == 1


@pytest.mark.parametrize("n,expect_cut", [(99, False), (100, False), (101, True)])
def test_snippet_lengths(spark, n, expect_cut):
    text = "kw" + "a" * (n - 2)
    s = _one(spark, tx.snippet("t", "KW"), text)
    assert s == (text[:100] + "..." if expect_cut else text)


def test_snippet_multibyte_counts_characters(spark):
    text = "é" * 99 + "üx" + "kw"
    s = _one(spark, tx.snippet("t", "kw"), text)
    assert s == "é" * 99 + "ü" + "..."
    assert _one(spark, tx.snippet("t", "absent"), text) is None


def test_phrase_and_bool(spark):
    df = spark.createDataFrame([("the quick brown fox",), ("quick the brown",), ("quick, brown!",)], "t string")
    assert df.where(tx.match_phrase("t", "quick brown")).count() == 2
    assert df.where(tx.match_bool("t", must=["quick"], must_not=["fox"])).count() == 2
    assert df.where(tx.match_bool("t", must=["Quick!"], must_not=["FOX"])).count() == 2
    assert df.where(tx.match_bool("t", should=["fox", "nothing"])).count() == 1


def test_token_count(spark):
    assert _one(spark, tx.token_count("t", "mit license"), "MIT license, mit! licenses") == 3
