"""Byte BPE against the published tokenizer."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from caseloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZER_FOLDER), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def ours():
    return bpe.Encoder(bpe.vocabulary_path("byte_bpe_50k"))


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZER_FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", "a", "Hello world", " two  spaces\n\n\ttab ", "don't I'LL 'VE", "<|endoftext|>", "日本語のテキスト", "é" * 50, "a" * 5000, "ab" * 3001, "🚗💥 brake", " x​", "1234567890" * 30, "तथा العربية"]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_published_tokenizer(ours, theirs, text):
    assert ours.encode(text) == theirs(text)


def test_random_texts(ours, theirs):
    rng = random.Random(0)
    alphabet = "abcdefgh '\n\tÄß日1!-"
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200)))
        assert ours.encode(text) == theirs(text)


def test_tree_finds_the_leftmost_least():
    tree = bpe.PairTree([5, 3, 9, 3])
    assert tree.leftmost_least() == 1
    tree.update(1, bpe.NEVER)
    assert tree.leftmost_least() == 3
    tree.update(3, bpe.NEVER)
    tree.update(0, bpe.NEVER)
    tree.update(2, bpe.NEVER)
    assert tree.leftmost_least() == -1
    assert bpe.PairTree([]).leftmost_least() == -1


def test_columns(spark, ours):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (3, "Hello world")], "doc_id long, text string")
    path = bpe.vocabulary_path("byte_bpe_50k")
    rows = df.select("doc_id", bpe.encode_column(F.col("text"), path).alias("ids"), bpe.count_column(F.col("text"), path).alias("n")).collect()
    assert [r["ids"] for r in rows] == [[], [], [15496, 995], [15496, 995]] and [r["n"] for r in rows] == [0, 0, 2, 2]
