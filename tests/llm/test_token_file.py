"""Token files against the tokenizers library, codes against Huffman's own method."""

import heapq
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skylattice.llm import common, token_file

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a  b c", "a \n b", "x <|endoftext|> y", "a<|endoftext|> b", "é  b 　 c", "it's  'll   q", "a b ", " a", "End.\nStart, then; more!?", "日本 語 \x1c \x85 a", "word " * 3000, "日本語" * 4000]


@pytest.fixture(scope="module")
def library():
    lib = Tokenizer.from_file(PATH)
    lib.no_padding()
    lib.no_truncation()
    return lambda text: lib.encode(text or "", add_special_tokens=False).ids


def huffman(counts):
    heap, total = sorted(counts), 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


def test_lengths_are_the_best_within_the_limit():
    rng = np.random.default_rng(1)
    for _ in range(40):
        counts = rng.integers(1, 10 ** rng.integers(1, 6), rng.integers(2, 70))
        free, tight = token_file.code_lengths(counts, 40), token_file.code_lengths(counts, 7)
        assert (free * counts).sum() == huffman(counts.tolist())
        assert tight.max() <= 7 and (2.0**-tight).sum() <= 1 and (tight * counts).sum() >= (free * counts).sum()
    assert (token_file.code_lengths(np.array([7]), 20) == 1).all()
    with pytest.raises(ValueError):
        token_file.code_lengths(np.ones(9), 3)


def test_limited_lengths_are_the_best_of_all():
    """Against every choice of lengths for a few symbols."""
    from itertools import product

    for counts in ([1, 1, 2, 90, 200], [1, 2, 4, 8, 16], [5, 5, 5, 5, 5]):
        best = min(sum(n * k for n, k in zip(counts, x, strict=True)) for x in product((1, 2, 3), repeat=5) if sum(2.0**-k for k in x) <= 1)
        assert (token_file.code_lengths(np.array(counts), 3) * counts).sum() == best


@pytest.mark.parametrize("n", [1, 2, 3, 300, 50_000])
def test_code_reads_what_it_wrote(n):
    rng = np.random.default_rng(n)
    counts = np.maximum(1, 1e9 / np.arange(1, n + 1) ** 1.5).astype(np.int64)
    ids = np.sort(rng.choice(60_000, n, replace=False))
    code = token_file.Code(ids, token_file.code_lengths(counts))
    for many in (0, 1, 127, 128, 129, 20_000):
        given = rng.choice(ids, many)
        bits, offsets = code.write(given)
        assert code.read(bits, offsets, many).tolist() == given.tolist()
        for k in range(0, len(offsets), 50):  # from any checkpoint
            assert code.read(bits, offsets[k:], many - k * token_file.STEP).tolist() == given[k * token_file.STEP :].tolist()


def test_encoder_gives_the_librarys_ids(library):
    rng = np.random.default_rng(3)
    letters = [" ", "  ", "a", "b", "\n", "\n", "×", "ä", "ж", "?", "'s", "<|endoftext|>", "é", "1", " ", "　", ".", ",", "\x1c", "日"]
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    with open(PATH, "rb") as f:
        encoder = token_file.Encoder(f.read())
    assert encoder.cut
    for i in range(0, len(texts), 500):
        got = encoder.encode([x.encode() for x in texts[i : i + 500]])
        assert [x.tolist() for x in got] == [*map(library, texts[i : i + 500])]


def test_a_full_cache_is_emptied(library, monkeypatch):
    monkeypatch.setattr(token_file, "CACHE_BYTES", 50)
    with open(PATH, "rb") as f:
        encoder = token_file.Encoder(f.read())
    for x in ["one two three, four", "five six seven eight nine ten eleven", "one two. Nine"] * 3:
        assert encoder.encode([x.encode()])[0].tolist() == library(x)


def expected(rows, library):
    out, start = [], 0
    for k, text in rows:
        ids = np.array([*library(text), 2], "<u4")
        out.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_against_the_library(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_IDS", 2000)
    rows = [(3 * i - 7, x) for i, x in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string").selectExpr("*", "'x' AS ids", "0 AS part", "1 AS n_tokens").repartition(4)
    token_file.write(common.staged(token_file.token_ids(docs, PATH, end=2)), f"{tmp_path}/files")
    got = sorted(map(tuple, token_file.digests(spark, f"{tmp_path}/files").collect()))
    assert got == expected(rows, library)
    whole = {r.doc_id: r for r in token_file.read(spark, f"{tmp_path}/files").collect()}
    assert all(np.frombuffer(whole[k].ids, "<u4").tolist() == [*library(t), 2] for k, t in rows)
    assert spark.read.parquet(f"{tmp_path}/files/blocks").count() > 3


def test_null_and_repeated_keys_and_missing_ids(spark, tmp_path):
    pack = lambda *x: np.array(x, "<u4").tobytes()
    rows = [(None, pack(9)), (1, pack(5, 6)), (1, pack(5, 6)), (1, pack(7)), (0, None), (None, pack())]
    token_file.write(spark.createDataFrame(rows, "doc_id long, ids binary"), f"{tmp_path}/files")
    got = token_file.read(spark, f"{tmp_path}/files").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((k is None, k or 0, x or b"") for k, x in rows)
    order = sorted(got, key=lambda r: (r.start, r.n_tokens))
    assert order[0].doc_id == 0 and {r.doc_id for r in order if r.start >= 5} <= {None} and sum(r.n_tokens for r in got) == 6


def test_narrow_ids(spark, tmp_path, library):
    rows = [*enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_file.write(common.staged(token_file.token_ids(docs, PATH, end=2, width=2)), f"{tmp_path}/files", 2)
    assert sorted(map(tuple, token_file.digests(spark, f"{tmp_path}/files").collect())) == expected(rows, library)
    with pytest.raises(ValueError):
        token_file.token_ids(docs, PATH, end=65_536, width=2)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_file.write(common.staged(token_file.token_ids(docs, PATH)), f"{tmp_path}/files")
    assert token_file.read(spark, f"{tmp_path}/files").count() == 0


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, token_file.op11_token_files(spark, sf).collect())) == expected(rows, library)


def test_known_stretches_give_the_ids_of_the_library(monkeypatch):
    """Also those with a special token, and after the known ones were forgotten."""
    with open(PATH, "rb") as f:
        data = f.read()
    texts = ["", " ", "the cat, the café; the cat", "the<|endoftext|> cat the<|endoftext|>cat", "naïve 漢字  the\n\ncat × the", "x" * 300, " the cat"]
    library = Tokenizer.from_str(data.decode())
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    for most in (1, 20, token_file.CACHE_BYTES):
        monkeypatch.setattr(token_file, "CACHE_BYTES", most)
        encoder = token_file.Encoder(data)
        for _ in range(3):
            assert [x.tolist() for x in encoder.encode([x.encode() for x in texts])] == want
        assert len(encoder.n.data) == len(encoder.place) and len(encoder.text.data) == encoder.text_n.data.sum()
