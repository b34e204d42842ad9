import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gneiss.llm.plan_tokens import TOKENIZERS
from gneiss.llm.tokenize import CorpusEncoder, encode_corpus

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def encoder():
    return CorpusEncoder(open(VOCABULARY, "rb").read())


def expected(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_whole_table_agrees_with_library(encoder):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].combine_chunks()
    assert encoder.encode(texts).to_pylist() == expected(texts.to_pylist())


def test_odd_texts(encoder):
    rng = random.Random(1)
    alphabet = "ab 'st\n\t\u00a0\u3000\x1c\x85é日本ひ한คำक्ष😀👨\u200d👩\u200d👧٣½<|endoftext|>...aaaa"
    texts = ["", None, "   ", "a" * 5000, "<|endoftext|>", "it's we'll", "x  \n y"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    assert encoder.encode(pa.array(texts, pa.string())).to_pylist() == expected(texts)
    assert encoder.encode(pa.array([], pa.string())).to_pylist() == []


def test_operator(spark):
    df = spark.createDataFrame([(1, "hello", [5]), (1, "hello", [5]), (None, None, None), (2, "", None)], "doc_id bigint, text string, ids array<int>")
    got = sorted((r.doc_id or -1, r.ids) for r in encode_corpus(df, "doc_id", "text", VOCABULARY).collect())
    assert got == [(-1, []), (1, [31373]), (1, [31373]), (2, [])]
    assert encode_corpus(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0
