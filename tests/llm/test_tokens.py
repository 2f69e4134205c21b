import random

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import tokens as K

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(f"{K.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


TEXTS = [None, "", " ", "   ", "\n \n", "a  b   c", "<|endoftext|> x", "it's I'LL", "a" * 5000, "ab " * 500, "中文" * 800, "é​\x1c\x1d x\x85y", "𝟙𝟚 ٣ ²", "😀" * 90, "　　x", "tab\t\tend \r\n\r\n  z"]


def test_equals_the_public_library(spark, public):
    random.seed(4)
    made = ["".join(random.choice(" \n\t　\x85abAB1.,'中é٣²_-😀") for _ in range(random.randint(1, 80))) for _ in range(3000)]
    data = list(enumerate([*TEXTS, *made]))
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in K.encode_column(df, "doc_id", "text").collect()}
    for i, t in data:
        assert got[i] == (public.encode(t, add_special_tokens=False).ids if t else []), repr(t)


def test_round_trip_and_both_ways_of_merging(public):
    ranks = K.encoder().ranks
    back = {v: k for k, v in ranks.items()}
    for word in (b"abcabd" * 60, "你好世界".encode() * 40, bytes(range(256)) * 2, b"x"):
        assert K._scan(word, ranks) == K._heap(word, ranks)
        assert b"".join(back[i] for i in K.merge(word, ranks)) == word


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "b")], "doc_id bigint, text string")
    assert K.encode_column(df, "doc_id", "text").count() == 3
    assert K.encode_column(df.limit(0), "doc_id", "text").count() == 0
