"""Token ids in files: canonical Huffman codes of limited length, in blocks that
are decoded by table, each by itself.

A dataset of ids is a folder of Parquet tables:

    code      id, length                     one row for each id that occurs
    blocks    part, before, doc_id, n_ids, bits, offsets
    parts     part, first                    ids before each part

``blocks`` holds documents in order: those of ``part`` 0, 1, ..., and within a part
by ``before``, the ids of the part before the block.  A block holds whole documents (``doc_id`` and ``n_ids`` have an entry
for each), about ``BLOCK_IDS`` ids; a longer document is a block of its own.
``offsets`` has the bit at which every ``STEP``-th id of the block begins, so that
decoding starts at any of them and all of a block are decoded side by side.

Codes follow from their lengths alone: by length, then by id.  Lengths come from
the counts of the whole dataset (package-merge: the best code of at most
``limit`` bits), so reader and writer share a table of fixed size.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

#: Ids of a block, unless one document alone has more.
BLOCK_IDS = 1 << 17
#: Ids between two checkpoints.
STEP = 128
#: Bits of the longest code; the decoding table has 2 ** LIMIT entries.
LIMIT = 20
#: Ids that a partition of the written files holds.
PART_IDS = 1 << 24
#: Bytes of stretches whose ids a task keeps, besides those of the chunk at hand.
CACHE_BYTES = 14_000_000

# --- the code ----------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code for positive ``counts``: the least total of all
    prefix codes of at most ``limit`` bits.  One symbol alone gets one bit.

    Package-merge: ``limit`` times, pairs of the cheapest items become packages
    that are merged with the symbols again; a symbol's length is how often it is
    among the first 2n - 2 items.
    """
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)  # exact to 2**53 occurrences
    levels, items = [], weights
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        place = np.argsort(both, kind="stable")
        levels.append(place < n)
        items = both[place]
    # From the last level back: of the items taken, so many are packages of two below.
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for own in reversed([np.ones(n, bool), *levels]):
        leaves = int(own[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (min(take, len(own)) - leaves)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code of ids: tables for writing and reading."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.limit = int(self.lengths.max(initial=1))
        step = np.int64(1) << (self.limit - self.lengths)
        left = np.cumsum(step) - step  # codes as they begin a window of ``limit`` bits
        size = int(self.ids.max(initial=0)) + 1
        self.bits_of, self.code_of = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.bits_of[self.ids] = self.lengths
        self.code_of[self.ids] = (left >> (self.limit - self.lengths)).astype(np.uint64)
        self.symbol = np.zeros(1 << self.limit, np.uint32)
        self.length = np.ones(1 << self.limit, np.uint8)
        used = int(step.sum())
        self.symbol[:used] = np.repeat(self.ids, step)
        self.length[:used] = np.repeat(self.lengths, step)

    def write(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of the ids, and the bit at which every ``STEP``-th begins."""
        size = self.bits_of[ids]
        end = np.cumsum(size)
        at = end - size
        words = np.zeros(int(end[-1] if len(end) else 0) // 64 + 2, np.uint64)
        code, word, bit = self.code_of[ids], at >> 6, at & 63
        over = bit + size - 64  # bits that go on in the next word
        shifted = np.where(over <= 0, code << (-np.minimum(over, 0)).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
        if len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words[word[first]] = np.bitwise_or.reduceat(shifted, first)
            split = over > 0  # one code at most over each border
            words[word[split] + 1] |= code[split] << (64 - over[split]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (int(end[-1] if len(end) else 0) + 7) // 8], at[::STEP]

    def read(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids from the bits that begin at the first of ``offsets``: each
        stretch between two is a lane, and all lanes take one id a round."""
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint64)
        window = raw[:-4] << 32 | raw[1:-3] << 24 | raw[2:-2] << 16 | raw[3:-1] << 8 | raw[4:]  # 40 bits from each byte
        at = np.asarray(offsets, np.int64).copy()
        out = np.zeros((len(at), STEP), np.uint32)
        last = n - STEP * (len(at) - 1)
        mask, top = np.uint64((1 << self.limit) - 1), 40 - self.limit
        for k in range(min(STEP, n)):
            lanes = at if k < last else at[:-1]  # a view: what is taken moves on
            peek = window[lanes >> 3] >> (top - (lanes & 7)).astype(np.uint64) & mask
            out[: len(lanes), k] = self.symbol[peek]
            lanes += self.length[peek]
        return out.reshape(-1)[:n]


# --- ids of texts ------------------------------------------------------------

_is = lambda *spans: np.array([any(lo <= b <= hi for lo, hi in spans) for b in range(256)])
#: By byte: letters, and what else isn't white space for any engine, of ASCII; the first
#: bytes of U+00C0 to U+07FF, whose letters (or signs) have two; marks that end words.
_LETTER, _SOLID = _is((0x41, 0x5A), (0x61, 0x7A)), _is((0x21, 0x7E))
_LEAD, _STOP = _is((0xC3, 0xDF)), np.isin(np.arange(256), list(b".,;:!?"))
#: Part of the above: letters of U+00C0 to U+00FF but for the two signs among them.
_LATIN = _is((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))
#: All of them as bits: solid, lead, stop, letter, Latin, beyond ASCII, 0xC3.
_KIND = sum(flag.astype(np.uint8) << k for k, flag in enumerate((_SOLID, _LEAD, _STOP, _LETTER, _LATIN, _is((0x80, 0xFF)), _is((0xC3, 0xC3))))).astype(np.uint8).tobytes()


def certain_cuts(data: np.ndarray) -> np.ndarray:
    """Where a byte-level split cuts for certain, whatever stands around: before a lone
    space between solid characters, at both sides of such a line's end, and between a
    letter and a mark: a flag for each byte.  ``data`` has two spaces at both ends."""
    kind = np.frombuffer(data.tobytes().translate(_KIND), np.uint8)
    two, before, now, after = kind[:-3], kind[1:-2], kind[2:-1], kind[3:]
    solid = before | (two >> 1) & (before >> 5)
    letter = before >> 3 | (two >> 6) & (before >> 4)
    alone = solid & (after | after >> 1) & 1
    end = (data[2:-1] == 0x0A) & alone
    out = np.zeros(len(data), bool)
    out[2:-1] = (data[2:-1] == 0x20) & alone | end | (now >> 2) & letter & 1
    out[3:] |= end.view(bool)
    return out


class Encoder:
    """The tokenizers library over texts, each distinct stretch between certain cuts
    once.  Stretches are told apart by hashes, and then compared byte by byte.  A file
    with another split than the byte-level one is given whole texts."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.lib = Tokenizer.from_str(data.decode())
        self.lib.no_padding()
        self.lib.no_truncation()
        spec = json.loads(data)
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        odd = any({*x["content"]} & {*" \n.,;:!?"} or any(x.get(k) for k in ("lstrip", "rstrip", "single_word")) for x in spec["added_tokens"])
        self.cut = plain and not spec.get("normalizer") and not odd
        self.size = np.zeros(max(self.lib.get_vocab().values()) + 1, np.int64)
        for token, i in self.lib.get_vocab().items():
            self.size[i] = len(token)  # a letter for each byte
        self._forget()

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids (uint32) of each text, given in UTF-8."""
        if not self.cut:
            return self.library([x.decode("utf-8", "replace") for x in texts])
        sizes = np.array([len(x) for x in texts], np.int64)
        data = np.frombuffer(b"  " + b"".join(texts) + b"  ", np.uint8)
        begins = 2 + np.cumsum(sizes) - sizes
        cut = certain_cuts(data)
        cut[begins + sizes - 1] = False  # it would look into the next text
        cut[begins[sizes > 0]] = True
        cut[-2:] = False
        starts = np.flatnonzero(cut)
        if not len(starts):
            return [np.zeros(0, "<u4") for _ in texts]
        lengths = np.append(starts[1:], len(data) - 2) - starts
        code = common.Windows(common.BYTE_CODE[data]).at(starts, lengths) ^ common.mixed(lengths.astype(np.uint64))
        distinct, first, which = np.unique(code, return_index=True, return_inverse=True)
        self._same(data, starts, data, starts[first][which], lengths, np.flatnonzero(starts != starts[first][which]))
        place = self._known(data, distinct, starts[first], lengths[first])[which]
        many = self.n.data[place]
        to = np.cumsum(many)
        ids = self.ids.data[np.arange(to[-1]) + np.repeat(self.ids_at.data[place] - (to - many), many)]
        cuts = np.append(0, to)[np.searchsorted(starts, np.append(begins, len(data)))]
        return [ids[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    @staticmethod
    def _same(data: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> None:
        """Raises where stretches that share a hash differ: of ``which``, at ``a`` in
        ``data`` and at ``b`` in ``other``."""
        n = lengths[which]
        if len(n) and (_gathered(data, a[which], n) != _gathered(other, b[which], n)).any():
            raise ValueError("two stretches of text share a hash")

    def _forget(self) -> None:
        """Known stretches: the place of each by its hash; by place, its bytes and ids."""
        self.place: dict[int, int] = {}
        self.text, self.text_at, self.text_n = Growing(np.uint8), Growing(np.int64), Growing(np.int64)
        self.ids, self.ids_at, self.n = Growing("<u4"), Growing(np.int64), Growing(np.int64)

    def _known(self, data: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The places of distinct stretches, whose hashes are ``codes``."""
        if len(self.text.data) > CACHE_BYTES:
            self._forget()
        asked = codes.tolist()
        out = np.fromiter(map(self.place.get, asked, repeat(-1)), np.int64, len(asked))
        old, new = np.flatnonzero(out >= 0), np.flatnonzero(out < 0)
        if len(old):
            at, n = np.zeros(len(out), np.int64), self.text_n.data[out[old]]
            if (n != lengths[old]).any():
                raise ValueError("two stretches of text share a hash")
            at[old] = self.text_at.data[out[old]]
            self._same(data, starts, self.text.data, at, lengths, old)
        if len(new):
            joint = self._joint(_gathered(data, starts[new], lengths[new]), lengths[new])
            new = new[np.argsort(~joint, kind="stable")]
            base, held, own = len(self.n.data), (len(self.text.data), len(self.ids.data)), lengths[new]
            text = _gathered(data, starts[new], own)
            ids, n = self._ask(text.tobytes(), own, int(joint.sum()))
            for array, more in ((self.text, text), (self.text_at, held[0] + np.cumsum(own) - own), (self.text_n, own), (self.ids, ids), (self.ids_at, held[1] + np.cumsum(n) - n), (self.n, n)):
                array.append(more)
            out[new] = np.arange(base, base + len(new))
            self.place.update(zip(codes[new].tolist(), range(base, base + len(new)), strict=True))
        return out

    def _joint(self, text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether stretches, one after another in ``text``, are a space and solid
        characters without a special token."""
        ends = np.cumsum(lengths)
        starts = ends - lengths
        tail = (text >= 0x80) & (text < 0xC0)
        lead = _LEAD[text] & np.append(tail[1:], False)
        bad = np.append(0, np.cumsum(~(_SOLID[text] | lead | tail & np.append(False, lead[:-1])), dtype=np.int64))
        out = (text[starts] == 0x20) & (lengths > 1) & (bad[ends] == bad[starts + 1])
        whole = text.tobytes()
        if special := [x for x in self.special if x in whole]:
            out &= ~np.array([any(x in whole[a:z] for x in special) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)])
        return out

    def _ask(self, text: bytes, lengths: np.ndarray, joint: int) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of stretches that lie one after another, and how many each
        has.  The first ``joint``, between which it cuts for certain, go to it as one text,
        whose ids are told apart by their bytes."""
        ends = np.cumsum(lengths)
        n, out = np.zeros(len(ends), np.int64), []
        if joint:
            (got,) = self.library([text[: ends[joint - 1]].decode()])
            n[:joint] = np.diff(np.searchsorted(np.cumsum(self.size[got]), ends[:joint]) + 1, prepend=0)
            out.append(got)
        if joint < len(ends):
            got = self.library([text[e - k : e].decode("utf-8", "replace") for e, k in zip(ends[joint:].tolist(), lengths[joint:].tolist(), strict=True)])
            n[joint:] = [*map(len, got)]
            out += got
        return np.concatenate(out), n


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches one after another."""
    ends = np.cumsum(lengths)
    return data[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


class Growing:
    """An array to which more is added: ``data`` is what it has."""

    def __init__(self, kind):
        self._room = np.zeros(1 << 10, kind)
        self.data = self._room[:0]

    def append(self, more: np.ndarray) -> None:
        n = len(self.data) + len(more)
        if n > len(self._room):
            room = np.zeros(2 * n, self._room.dtype)
            room[: len(self.data)] = self.data
            self._room = room
        self._room[len(self.data) : n] = more
        self.data = self._room[:n]


_encoders: dict[bytes, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    key = hashlib.sha256(data).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


def token_ids(docs: DataFrame, path: str, end: int | None = None, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned integers of ``width`` bytes: 4, or 2
    if the vocabulary is that small) of each row, as the tokenizers library gives them,
    and ``end`` after them.  A null or empty text has only ``end``."""
    with open(path, "rb") as f:
        given = f.read()
    if width not in (2, 4) or width == 2 and max([end or 0, *Tokenizer.from_str(given.decode()).get_vocab().values()]) >> 16:
        raise ValueError(f"ids don't fit {width} bytes")
    data = docs.sparkSession.sparkContext.broadcast(given)  # a tokenizer's file: fixed size
    tail = b"" if end is None else np.array([end], f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data.value)
        for batch, raw in common.text_chunks(batches):
            ids = encoder.encode(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(f"<u{width}").tobytes() + tail for x in ids], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary")


# --- files -------------------------------------------------------------------


def _counts(ids: DataFrame, width: int) -> DataFrame:
    """id and how often it occurs; each task sends one row for an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.column(0).slice(i, 1000)
                n = np.bincount(np.frombuffer(b"".join(x for x in part.to_pylist() if x), f"<u{width}"), minlength=len(total))
                n[: len(total)] += total
                total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(ids: DataFrame, path: str, width: int = 4) -> None:
    """Writes rows (doc_id, ids) to a new folder in ascending doc_id order; ids are
    integers of ``width`` bytes, as ``token_ids`` gives them.

    Rows with a null doc_id come last; rows that share a doc_id are rows of their
    own, in the order of their ids' bytes.  Null ids count as none, and a row without
    ids is kept.  An empty table makes a dataset without blocks.  Rows are dealt in
    ranges of (doc_id, a hash of the ids), so no repeated or null doc_id fills a task
    alone; only equal rows stay together.  A row's ids are in one task's memory.
    ``ids`` is read three times, so it should be a written table.
    """
    spark = ids.sparkSession
    counts = _counts(ids, width).toPandas()  # one row for each id of the vocabulary
    lengths = code_lengths(counts["n"].to_numpy(np.int64), max(LIMIT, int(len(counts)).bit_length()))
    symbols = counts["id"].to_numpy(np.int64)
    spark.createDataFrame(pa.table({"id": symbols, "length": lengths}) if len(symbols) else [], "id long, length long").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((symbols, lengths))
    n = common.partitions(spark, int(counts["n"].sum()), PART_IDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = Code(*shared.value), TaskContext.get().partitionId()
        held: list[tuple[int | None, bytes]] = []
        size = before = 0

        def block() -> pa.RecordBatch:
            bits, offsets = code.write(np.frombuffer(b"".join(x for _, x in held), f"<u{width}").astype(np.int64))
            row = {"part": part, "before": before // width, "doc_id": [k for k, _ in held], "n_ids": [len(x) // width for _, x in held], "bits": bits, "offsets": offsets.tolist()}
            return pa.RecordBatch.from_pylist([row], _BLOCKS)

        for batch in batches:
            for k, x in zip(batch.column(0), batch.column(1), strict=True):
                x = x.as_py() or b""
                if held and size + len(x) > width * BLOCK_IDS:
                    yield block()
                    held, size, before = [], 0, before + size
                held.append((k.as_py(), x))
                size += len(x)
        if held:
            yield block()

    dealt = ids.select("doc_id", "ids", F.col("doc_id").isNull().alias("last"), F.xxhash64("ids").alias("h")).repartitionByRange(n, "last", "doc_id", "h")
    with common.setting(spark, common._CLEANUP, "true"):
        dealt.sortWithinPartitions("last", "doc_id", "h", "ids").select("doc_id", "ids").mapInArrow(run, _BLOCKS_SQL).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    sums = sorted(blocks.groupBy("part").agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())  # a row for each partition
    first = np.cumsum([0, *(s.n for s in sums)])
    spark.createDataFrame([(s.part, int(f)) for s, f in zip(sums, first, strict=False)], "part int, first long").coalesce(1).write.parquet(f"{path}/parts")


_BLOCKS_SQL = "part int, before long, doc_id array<long>, n_ids array<long>, bits binary, offsets array<long>"
_BLOCKS = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("bits", pa.binary()), ("offsets", pa.list_(pa.int64()))])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all rows before it), n_tokens and ids (binary) of written
    files.  Blocks are decoded wherever they lie; a row's ids are in memory at once."""

    def whole(docs: pa.Array, start: np.ndarray, sizes: np.ndarray, data: bytes) -> list[pa.Array]:
        ends = 4 * np.cumsum(sizes)
        return [docs, pa.array(start), pa.array(sizes), pa.array([data[e - 4 * s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary())]

    return _decoded(spark, path, whole, "doc_id long, start long, n_tokens long, ids binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read``, with ids_crc32, the crc32 of the ids as little-endian unsigned
    32-bit integers, in place of the ids."""

    def crc(docs: pa.Array, start: np.ndarray, sizes: np.ndarray, data: bytes) -> list[pa.Array]:
        ends = 4 * np.cumsum(sizes)
        return [docs, pa.array(start), pa.array(sizes), pa.array([zlib.crc32(data[e - 4 * s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.int64())]

    return _decoded(spark, path, crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _decoded(spark: SparkSession, path: str, columns: Callable, schema: str) -> DataFrame:
    code = spark.read.schema("id long, length long").parquet(f"{path}/code").toPandas()  # a row for each id that occurs
    shared = spark.sparkContext.broadcast((code["id"].to_numpy(np.int64), code["length"].to_numpy(np.int64)))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                first, before, docs, sizes, bits, offsets = (c[row] for c in batch.columns)
                sizes = sizes.values.to_numpy()
                data = code.read(bits.as_py(), offsets.values.to_numpy(), int(sizes.sum())).astype("<u4").tobytes()
                start = first.as_py() + before.as_py() + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(columns(docs.values, start, sizes, data), names)

    parts = spark.read.schema("part int, first long").parquet(f"{path}/parts")
    small = parts.count() <= common.BROADCAST_PARTITIONS
    blocks = spark.read.schema(_BLOCKS_SQL).parquet(f"{path}/blocks").join(parts.hint("broadcast" if small else "merge"), "part")
    return blocks.select("first", "before", "doc_id", "n_ids", "bits", "offsets").mapInArrow(run, schema)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids = token_ids(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end=2, width=2)
    path = common.scratch_dir(spark)
    write(common.staged(ids), path, 2)
    return digests(spark, path)
