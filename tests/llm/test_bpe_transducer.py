"""The byte-level encoder against the library, its decoder against Python's, and edge cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from recordlake.llm import bpe_transducer
from recordlake.llm.catalog import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids string, decoded string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe_transducer.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe_transducer.Encoder(bpe_transducer.read_ranks(RANKS), PATTERN)


def texts():
    rng = random.Random(3)
    alphabet = "aAeEoOtTnéßőώ́  \x85 \t\n\r''srevldm1239!%#中文😀._-\x00ſ€"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    made += ["".join(rng.choice("abcdehinorst"[: rng.choice([2, 4, 12])]) for _ in range(600)) for _ in range(60)]
    made += [c * n for c in ("a", " ", "-", "\n", "0", "ha", "é", "=-") for n in (1, 31, 255, 256, 257, 5000)]
    return [*made, "", "<|endoftext|>", "it's we'll I'M 'tis ''re", "word " * 3000 + "x" * 700_000 + " end"]


def test_equals_the_library(library, encoder):
    for t in texts():
        assert encoder.encode(t).tolist() == library.encode_ordinary(t)


def test_states_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(bpe_transducer, "MAX_STATES", 40)
    monkeypatch.setattr(bpe_transducer, "MEMO", 5)
    small = bpe_transducer.Encoder(bpe_transducer.read_ranks(RANKS), PATTERN)
    for t in texts()[::40]:
        if len(t) < 10_000:
            assert small.encode(t).tolist() == library.encode_ordinary(t)
    assert len(small) <= 5 and len(small.transducer.states) < 2000


def test_windows_change_no_match():
    pattern = bpe_transducer.regex.compile(PATTERN)
    for t in texts():
        if len(t) < 10_000:
            for window in (1, 4, 7, 50):
                assert [m for part in bpe_transducer.matches(pattern, t, window) for m in part] == pattern.findall(t)


def test_tokens_that_merging_never_makes(library):
    """A rank that no merge reaches is still the encoding of a match that equals it, and only there."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"xyz": 301, b"cab": 302}
    small = bpe_transducer.Encoder(ranks, r"\S+|\s+")
    want = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for t in ["xyz", "xyzxyz", "axyz", "abcabcab", *("".join(rng.choice("abcxyz ") for _ in range(20)) for _ in range(500))]:
        assert small.encode(t).tolist() == want.encode_ordinary(t)
    with pytest.raises(ValueError):
        bpe_transducer.Encoder({b"a": 0}, ".")


def test_emission_is_bounded(encoder):
    """On a match of 100,000 bytes no emission waits for more than a few strides."""
    rng = random.Random(9)
    data = bytes(rng.choice(b"abcdefghij") for _ in range(100_000))
    sizes = [sum(len(encoder.transducer.merges.token[i]) for i in part) for part in encoder.transducer.stream(data)]
    assert sum(sizes) == 100_000 and max(sizes) <= 3 * bpe_transducer.STRIDE


def test_streaming_decoder():
    rng = random.Random(4)
    good = "aé中😀\u0000߿ࠀ퟿\U0010ffff" * 5
    bad = bytes(rng.randrange(256) for _ in range(3000)) + b"\xe0\x80\xed\xa0\x80\xf4\x90\x80\x80\xf0\x9f\x98"
    for data in (good.encode(), bad, good.encode()[:-2], b"\xf0\x9f", b""):
        for size in (1, 2, 3, 5, 64, 10_000):
            stream = bpe_transducer.Utf8Stream()
            parts = [stream.feed(data[i : i + size]) for i in range(0, len(data), size)] + [stream.close()]
            assert "".join(parts) == data.decode("utf-8", "replace")


def test_columns_and_edges(spark, library):
    rows = [(1, "Straße 中文 😀", "x", "y"), (1, "Straße 中文 😀", "x", "y"), (None, None, None, None), (2, "", "", ""), (3, "a" * 300_000, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    coded = bpe_transducer.encode_texts(df, RANKS, PATTERN, ["doc_id", "ids", "decoded"])
    assert coded.columns == ["doc_id", "ids_", "decoded", "ids"]
    assert [r["ids"] for r in coded.collect()] == [library.encode_ordinary(t or "") for _, t, _, _ in rows]
    for as_text in (False, True):
        back = bpe_transducer.decode_ids(coded, RANKS, ["doc_id", "decoded"], as_text=as_text)
        assert back.columns == ["doc_id", "decoded_", "decoded"]
        assert [r["decoded"] if as_text else bytes(r["decoded"]).decode() for r in back.collect()] == [t or "" for _, t, _, _ in rows]
    assert bpe_transducer.encode_texts(df.limit(0), RANKS, PATTERN, ["doc_id"]).count() == 0
    none = df.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert {bytes(r["decoded"]) for r in bpe_transducer.decode_ids(none, RANKS, []).collect()} == {b""}
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe_transducer.decode_ids(df.select(F.array(F.lit(10**6)).alias("ids")), RANKS, []).collect()


def test_query_on_the_whole_table(spark, data, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op12_bpe_transducer"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode_bytes(ids)).hexdigest()
    assert np.all([r["n_tokens"] >= 0 for r in rows])
