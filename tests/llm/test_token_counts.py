import random

import pytest

from strataflow.llm import token_counts as T

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def both():
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece.SentencePieceProcessor(model_file=path), T.compiled(path)


def random_texts(n):
    rng = random.Random(3)
    letters = "ab  ethTH\n\t\r é ①梦▁<s>/[]INST 0123456789_-.,(){};    "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [" ", "  ", " " * 50, "a" * 3000, "</s>", "\x00", "=" * 500, " " * 33 + "x" + " " * 17, "xx▁ y"]


def test_counts_equal_the_library(both):
    model, counts = both
    texts = random_texts(2000)
    assert [T.count_tokens(counts, x) for x in texts] == [len(x) for x in model.encode(texts)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 50])
def test_chunk_maps_compose(both, chunk):
    model, counts = both
    texts = random_texts(400)
    assert [T.count_tokens(counts, x, chunk) for x in texts] == [len(x) for x in model.encode(texts)]


def test_nulls_empty_tables_and_extra_columns(spark, both):
    model, _ = both
    rows = spark.createDataFrame([(1, None, "x", 3), (2, "", "x", 3), (3, "ab cd", "x", 3), (3, "ab cd", "x", 3), (None, "é " * 5000, "x", 3)], "doc_id long, text string, n_tokens string, n_bytes int")
    out = sorted((tuple(r) for r in T.token_counts(rows).collect()), key=str)
    assert out == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 5, 2, False), (3, 5, 2, False), (None, 15000, len(model.encode("é " * 5000)), True)], key=str)
    assert T.token_counts(rows.limit(0)).count() == 0
