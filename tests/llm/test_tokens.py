import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from foliant.llm import tokens

NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def ranks():
    return tokens.load_ranks(P.path(NAME))


@pytest.fixture(scope="module")
def right(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder(ranks):
    return tokens.bpe_coder(ranks, P.PATTERN)


def texts():
    rng = random.Random(2)
    pools = ["abc de'sx", "aé ñß.,!", "  \n\t\r\x0b\x0c", "\x1c\x1d\x85\xa0 　 a", "0123 45²½", "日本語テキスト。 ", "🙂👩‍👩‍👧🏽 a", "the and ing tion er es "]
    made = ["", " ", "\n", "a", "'s't're", "don't I'll  we've", "<|endoftext|>", "x" * 3000, "ab" * 2000, " " * 1000 + "a", "é" * 999, "́á", "𝒳𝓎"]
    for _ in range(400):
        made.append("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 80))))
    return made


def test_encodes_as_the_library(coder, right):
    for text in texts():
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == right.encode_ordinary(text), text[:50]


def test_encodes_documents(coder, right):
    import pyarrow.parquet as pq

    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist():
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == right.encode_ordinary(text)


def test_random_bytes_and_few_states(ranks, right, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_STATES", 50)
    machine = tokens.BpeTransducer(ranks)
    rng = random.Random(4)
    for _ in range(300):
        piece = bytes(rng.choice(b"aeinrst \xc3\xa9\xe3\x81\xff0") for _ in range(rng.randint(1, 60)))
        assert machine.encode(piece) == right._core_bpe.encode_single_piece(piece)


def test_parts_code_as_whole_texts():
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    coder = tokens.json_coder(P.path("byte_bpe_50k.json"))
    for text in texts():
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, text[:50]


def test_parts_of_documents_code_as_the_library():
    import pyarrow.parquet as pq

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder = tokens.json_coder(P.path("byte_bpe_50k.json"))
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist():
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_stream_yields_whole_characters(ranks, right):
    table = {i: t for t, i in ranks.items()}
    text = "né 日本語 🙂👩‍👧 ok ß" * 5
    stream = tokens.Utf8Stream(table)
    single = [ranks[bytes([b])] for b in text.encode()]
    pieces = [stream.feed([i]) for i in single] + [stream.finish()]
    assert b"".join(pieces) == text.encode()
    assert "".join(p.decode() for p in pieces) == text
    damaged = [ranks[bytes([b])] for b in b"\xff\xe3\x81a\xc3"]
    stream = tokens.Utf8Stream(table)
    assert b"".join([stream.feed([i]) for i in damaged] + [stream.finish()]) == b"\xff\xe3\x81a\xc3"


def test_rows(spark, right):
    rows = [(i, t, 0, "x") for i, t in enumerate(texts())] + [(7, None, 1, "y"), (None, "a b", 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string").repartition(3)
    got = {(r.doc_id, r.decoded_sha256): r for r in tokens.encode_texts(df, P.path(NAME), P.PATTERN).collect()}
    for i, t, _, _ in rows:
        ids = np.array(right.encode_ordinary(t or ""), "<u4").tobytes()
        r = got[i, hashlib.sha256((t or "").encode()).hexdigest()]
        assert (r.n_tokens, r.ids_sha256, bytes(r.decoded)) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), (t or "").encode())
    assert tokens.encode_texts(df.limit(0), P.path(NAME), P.PATTERN).collect() == []
