import os
import random

import pytest

from foliospark.llm import tokenizer as tk

JSON = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(tk.DEFAULT_PATH), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def reference():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


ODD = ["", " ", "\n\n  x", "don't we'll I'M", "<|endoftext|> hi", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ΔE ≈ 3.2×10⁻⁵", "日本語のテスト", "👩‍🔬🧪", "\x00\x01\x7f​", "x" * 5000, " " * 300 + "y", "1234567890" * 30, "İıſ", "\r\n\t"]


@pytest.mark.parametrize("s", ODD)
def test_odd_texts(reference, s):
    assert tk.load_encoder(tk.DEFAULT_PATH).encode(s) == reference(s)


def test_random_texts(reference):
    rng, encode = random.Random(7), tk.load_encoder(tk.DEFAULT_PATH).encode
    for _ in range(1500):
        s = "".join(rng.choice("etaoinshrdluETAé日0129 .,'\n-_=") for _ in range(rng.randint(1, 60)))
        s = s.replace(" ", "") if rng.random() < 0.5 else s
        assert encode(s) == reference(s)


def test_pieces_without_memory(reference):
    e = tk.load_encoder(tk.DEFAULT_PATH)
    for w in ("antidisestablishmentarianism", "zzzzxqxqzzz", "internationalisation", "éèêëéèêë"):
        assert e.encode_piece(w.encode()) == reference(w)


def test_own_vocabulary_follows_the_merges():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259}
    e = tk.BytePairEncoder(ranks)
    assert e.encode_piece(b"abcd") == [258, 100]  # ab first, then abc, which ranks before cd
    assert e.encode_piece(b"abc") == [258]
    assert e.encode_piece(b"") == []


def test_documents(spark, reference):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (None, "x"), (1, "Hello world")], "doc_id bigint, text string").withColumnRenamed("doc_id", "doc_id")
    got = sorted(((r.doc_id, list(r.ids)) for r in tk.encode_documents(df).collect()), key=repr)
    assert got == sorted([(1, reference("Hello world"))] * 2 + [(2, []), (3, []), (None, reference("x"))], key=repr)
    assert tk.encode_documents(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert tk.encode_documents(df.limit(0)).count() == 0


def test_broken_bytes_and_missing_file(spark):
    df = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text")
    assert list(tk.encode_documents(df).first().ids) == tk.load_encoder(tk.DEFAULT_PATH).encode("a�b")
    with pytest.raises(FileNotFoundError, match="vocabulary_path"):
        tk.load_encoder("/nowhere")
