import array
import hashlib
import random

import pytest

from embervane.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.DEFAULT_VOCABULARY))
    return bpe.codec(bpe.DEFAULT_VOCABULARY), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    out = array.array("I")
    out.frombytes(codec.encode_packed(text))
    return list(out)


def test_random_texts_equal_the_library(both):
    codec, enc = both
    r = random.Random(3)
    pools = ["abcdefgh ", "aab", "etaoin shrdlu", "日本語漢字", "привет мир", "é èêçü", " \n\t", "0123456789", "!?#$-_=+<|>", "😀👍🏽"]
    for _ in range(3000):
        pool = r.choice(pools) + r.choice(pools)
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 50)))
        assert ids(codec, text) == enc.encode_ordinary(text)


def test_long_pieces_are_emitted_as_they_are_read(both):
    codec, enc = both
    for text in ("a" * 20_000, " " * 9_000 + "x", "xyzzy" * 3_000, "é" * 7_000, "ab" * 2_049, "<|endoftext|>" * 50):
        assert ids(codec, text) == enc.encode_ordinary(text)
        assert "".join(codec.decode_text(codec.encode_packed(text))) == text


def test_follow_relation_is_what_merging_says(both):
    t = both[0].transducer
    r = random.Random(5)
    all_ids = list(t.bytes_of)
    for _ in range(4000):
        a, b = r.choice(all_ids), r.choice(all_ids)
        assert t.follows(a, b) == (t.merge(t.bytes_of[a] + t.bytes_of[b]) == [a, b])


def test_utf8_stream_at_every_cut():
    data = "aé漢😀z".encode() + b"\xff" + "é".encode()[:1]
    for cut in range(len(data) + 1):
        s = bpe.Utf8Stream()
        assert s.feed(data[:cut]) + s.feed(data[cut:]) + s.close() == data.decode("utf-8", "replace")


def test_frames(spark, docs_of, both):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (4, "x" * 5000), (4, "x" * 5000)]
    df = docs_of(rows)
    back = bpe.decode_frame(bpe.encode_frame(df.drop("ids"))).select("doc_id", "text", "decoded", "ids").collect()
    assert len(back) == 5 and all((r.text or "") == r.decoded for r in back)
    got = df.select("doc_id", "text").mapInArrow(bpe.digest_batches(bpe.DEFAULT_VOCABULARY), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").collect()
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        want = both[1].encode_ordinary(text)
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(array.array("I", want).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_frame(df.drop("ids").limit(0)).count() == 0
