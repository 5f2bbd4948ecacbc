"""The numpy merges and prefix counts against the tokenizers library."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from skylattice.llm import bpe  # noqa: E402

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
TEXTS = ["", " ", "Hello  world", "aaaaaaa aaaa", "it's we're THEY'LL 's", "  two\n\n three\t\tfour  ", "über Ärger ΑΣ ΣΑΣ. İstanbul ß", "<|endoftext|>x<|endoftext|>", "a<|endoftext|", "日本語 テスト 😀😀", "x" * 5000, "1234567 89,00!?!", "é combining", "\x1c\x1d \x85 　 z", "'r're'revolve 'v"]
ALPHABET = st.text(st.sampled_from("aabcdehlorst'é ΣßÜ12.!?\n\t 　日😀İ<|endoftext|>"), max_size=60)


@pytest.fixture(scope="module")
def word():
    return bpe.Vocabulary(open(WORD, "rb").read()), tokenizers.Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return bpe.PrefixCounts(open(BYTE, "rb").read()), tokenizers.Tokenizer.from_file(BYTE)


#: Libraries differ on characters of later Unicode versions than Python's.
ASSIGNED = st.characters(exclude_categories=["Cn", "Cs", "Co"])


def same(word, texts):
    ours, theirs = word
    for text, ids, enc in zip(texts, ours.encode(texts), theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == enc.ids, repr(text)
        assert ours.decode(ids) == theirs.decode(enc.ids, skip_special_tokens=False)


def test_encode_and_decode_as_the_library(word):
    same(word, TEXTS)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(ALPHABET, st.text(ASSIGNED, max_size=30)), max_size=4))
def test_encode_random(word, texts):
    same(word, texts)


def prefixes_hold(byte, text):
    ours, theirs = byte
    (counts,) = ours.prefixes([text])
    at = 0
    for i in range(len(text) + 1):
        assert counts[at] == len(theirs.encode(text[:i], add_special_tokens=False).ids), (text, i)
        at += len(text[i].encode()) if i < len(text) else 0
    assert len(counts) == len(text.encode()) + 1


@pytest.mark.parametrize("text", [t for t in TEXTS if len(t) < 100])
def test_every_prefix(byte, text):
    prefixes_hold(byte, text)


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(ALPHABET, st.text(ASSIGNED, max_size=25)))
def test_every_prefix_random(byte, text):
    prefixes_hold(byte, text)


def test_long_word(byte):
    ours, theirs = byte
    for text in ("x" * 3000, "ab" * 2000, "!?" * 999, " " * 777, "\n" * 501 + "a"):
        assert ours.prefixes([text])[0][-1] == len(theirs.encode(text, add_special_tokens=False).ids)


def test_cache_is_bounded(byte, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    ours, theirs = byte
    for i in range(5):
        text = " ".join(f"w{i}{k}q" for k in range(30))
        assert ours.prefixes([text])[0][-1] == len(theirs.encode(text).ids)
    assert len(ours.cache) < 40


def test_queries_over_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    word, byte = tokenizers.Tokenizer.from_file(WORD), tokenizers.Tokenizer.from_file(BYTE)
    import hashlib

    rows = bpe.op2_bpe(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {*docs}
    for r in rows:
        ids = word.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in bpe.op10_token_counts(spark, sf_dir).collect():
        text = docs[r.doc_id]
        n = len(byte.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)
        counts = bpe.unpacked_counts(r.counts)
        assert len(counts) == r.n_bytes + 1 and counts[-1] == n
        half = text[: len(text) // 2]
        assert counts[len(half.encode())] == len(byte.encode(half, add_special_tokens=False).ids)
        cut = text.encode()[: r.limit_bytes].decode()
        assert len(byte.encode(cut, add_special_tokens=False).ids) <= 1024


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "x", "b"), (2, "", "c")], "doc_id long, text string, ids string")
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in bpe.encode(df, WORD).collect()) == [(0, 1, "x</w>"), (1, 0, ""), (1, 0, ""), (2, 0, "")]
    stored = bpe.token_counts(df, BYTE, store=True)
    assert sorted((r.doc_id or 0, r.n_tokens, bpe.unpacked_counts(r.counts).tolist()) for r in stored.collect()) == [(0, 1, [0, 1]), (1, 0, [0]), (1, 0, [0]), (2, 0, [0])]
    assert bpe.encode(df.limit(0), WORD).count() == 0
    hello = spark.createDataFrame([(5, "Hello world, again")], "doc_id long, text string")
    assert bpe.truncated(bpe.token_counts(hello, BYTE, store=True), 2).collect()[0].n_bytes == len("Hello world")


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"unk_token": "?"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}])
def test_steps_that_are_not_known_are_refused(change):
    import json

    spec = json.loads(open(BYTE, "rb").read())
    spec |= {k: spec["model"] | v if k == "model" else v for k, v in change.items()}
    with pytest.raises(ValueError, match="isn't supported"):
        bpe.Vocabulary(json.dumps(spec).encode())


def test_long_text(spark):
    text = "A long text, again and again. " * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = bpe.token_counts(df, BYTE).collect()
    assert row.n_bytes == len(text) and row.n_tokens == len(tokenizers.Tokenizer.from_file(BYTE).encode(text).ids)
    assert len(bpe.encode(df, WORD).collect()[0].ids) == len(tokenizers.Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_character(name):
    """Each code point among letters and digits, those of newer tables included."""
    import unicodedata

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(name))
    lib.no_padding()
    lib.no_truncation()
    with open(public_tokenizers.path(name), "rb") as f:
        own = bpe.Vocabulary(f.read())
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Co"]
    for k in range(0, len(points), 10_000):
        texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} x" for c in points[k : k + 10_000]]
        want = lib.encode_batch(texts, add_special_tokens=False)
        assert [points[k + i] for i, (a, b) in enumerate(zip(own.encode(texts), want, strict=True)) if a.tolist() != b.ids] == []


def test_other_splits_are_refused_for_prefixes():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f, pytest.raises(ValueError, match="byte-level"):
        bpe.PrefixCounts(f.read())
