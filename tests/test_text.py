import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import functions as F

from labelloom.functions import text as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column.alias("y")).first()["y"]


def test_tweet_mention_ends_at_underscore_and_url_takes_its_comma(spark):
    out = one(spark, "@joe_x see http://a.b/c, I don't", T.clean_tweet(F.col("x")))
    assert out == "x see I don t"


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aZ9@_:/ \t\n'é #,.", max_size=30), min_size=1, max_size=20))
def test_tweet_cleaner_equals_python(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = rows.select("i", T.clean_tweet(F.col("x")).alias("y")).collect()
    for row in got:
        assert row["y"] == " ".join(re.sub(T.TWEET_NOISE, " ", texts[row["i"]]).split())


def test_review_cleaner_both_modes(spark):
    text = "It's (ok)? can't, they'll!"
    plain = one(spark, text, T.clean_review(F.col("x")))
    faithful = one(spark, text, T.clean_review(F.col("x"), faithful=True))
    assert plain == "it 's ( ok ) ? ca n't , they 'll !"
    assert faithful == r"it 's \( ok \) \? ca n't , they 'll !"


def test_stop_words_go_in_order_and_respect_case(spark):
    words = ["i", "the", "don", "don't", "t"]
    out = one(spark, "The the I i don't", T.strip_stop_words(F.col("x"), words))
    expected = "The the I i don't"
    for w in words:
        expected = re.sub(rf"\b{w}\b", "", expected)
    assert out == expected


def test_stop_words_equal_word_by_word_deletion(spark):
    text = "You're here, can't we've gone? I'd say that'll do: don't. über-the-top naïve t' a_the"
    expected = text
    for w in T.ENGLISH_STOP_WORDS:
        expected = re.sub(rf"\b{w}\b", "", expected)
    assert one(spark, text, T.strip_stop_words(F.col("x"))) == expected


def test_gap_tokens_are_phrases_word_tokens_are_words(spark):
    text = "Hello the world, so GOOD"
    assert one(spark, text, T.gap_tokens(F.col("x"))) == ["hello the world", " so good"]
    tokenizer = RegexTokenizer(inputCol="x", outputCol="w", pattern=T.TWEET_NOISE)
    df = spark.createDataFrame([(text,)], "x string")
    assert tokenizer.transform(df).first()["w"] == ["hello the world", " so good"]
    assert one(spark, text, T.word_tokens(F.col("x"))) == ["hello", "the", "world", "so", "good"]


def test_stop_words_match_any_case_and_keep_duplicates(spark):
    tokens = F.split("x", " ")
    out = one(spark, "The cat THE cat rt dog", T.drop_words(tokens, T.TOKENIZER_STOP_WORDS))
    assert out == ["cat", "cat", "dog"]


def test_lines_and_words_of_a_file(spark):
    text = "One two\r\n\r\nthree \rfour\n"
    assert one(spark, text, T.file_lines(F.col("x"))) == ["One two", "", "three ", "four"]
    assert one(spark, text, T.review_words(F.col("x"), faithful=True)) == [
        "one", "two", "", "three", "four",
    ]
    assert one(spark, text, T.review_words(F.col("x"))) == ["one", "two", "three", "four"]


def test_empty_file_has_no_lines_and_blank_file_one(spark):
    assert one(spark, "", T.file_lines(F.col("x"))) == []
    assert one(spark, "", T.review_words(F.col("x"), faithful=True)) == []
    assert one(spark, "\n", T.file_lines(F.col("x"))) == [""]
    assert one(spark, "\n", T.review_words(F.col("x"), faithful=True)) == [""]


def test_ngrams_of_short_lists(spark):
    grams = T.unigrams_bigrams(F.filter(F.split("x", " "), lambda w: w != ""))
    assert one(spark, "", grams) == []
    assert one(spark, "a", grams) == ["a"]
    assert one(spark, "a b c", grams) == ["a", "b", "c", "a b", "b c"]


def test_split_space_keeps_the_empty_token_only_when_faithful(spark):
    assert one(spark, "", T.split_space(F.col("x"), faithful=True)) == [""]
    assert one(spark, "", T.split_space(F.col("x"))) == []


@pytest.mark.parametrize("words,text", [(["t", "don't"], "I don't know t"), (["don", "don't", "t"], "I don't know")])
def test_stop_words_go_in_list_order(spark, words, text):
    want = text
    for w in words:
        want = re.sub(rf"(?<!\w){re.escape(w)}(?!\w)", "", want)
    got = spark.createDataFrame([(text,)], "x string").select(T.strip_stop_words(F.col("x"), words)).first()[0]
    assert got == want
    assert len(T.stop_word_passes(T.ENGLISH_STOP_WORDS)) == 1


def test_partition_cleaner_holds_the_words_of_one_text():
    import tracemalloc

    import pandas as pd

    from labelloom.plans.text import partition_cleaner

    text = "@who said: it's ok! " * 500
    frame = pd.DataFrame({"doc_id": range(300), "content": [text + str(i) for i in range(299)] + [None]})
    tracemalloc.start()
    out = next(partition_cleaner(T.TWEET_NOISE)(iter([frame])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["clean"][1].startswith("said it s ok said") and out["clean"][1].endswith(" 1") and out["clean"][299] is None
    assert peak < 2 * 300 * len(text)
