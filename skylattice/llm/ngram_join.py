"""Near duplicates by an exact Jaccard join on word 5-grams: a grouped prefix join.

Two sets with Jaccard similarity t share an item among the first n - ceil(t n) + 1
of each, in any order common to all sets.  The order here puts rare items first:
by the count of the item's slot (a table of ``SLOTS`` counts over all documents, of
fixed size), ties by hash.  An item stands out of its slot once its count is above
the square root of the slot's, so frequent items come last at any size of input.
The order decides what is compared, never what links.

* Documents with equal sets are one; documents with equal prefix and size form a
  group, which stands in the join as one entry for each item of its prefix.
* Groups that share an item meet in a run of sorted entries (``common.runs``,
  which spreads any run over partitions).  First every group is paired with the
  head of each run only, and the members of a group with its least.  The head is
  the group with the item earliest in its order: it has the fewest items that are
  rarer, so of a text's altered copies it is the text itself.  Pairs that
  pass the size and position filters and a filter on parity sketches are verified
  on the whole sets, and what links falls into components.
* Then every other pair of groups in a run is taken whose members aren't all in
  one component already, filtered, expanded to members and verified.  So a group
  of many near copies, all linked to its head, never makes all its pairs, and no
  link between different components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = 5
PERCENT = 80
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Slots in a row of the count table while it is summed.
BLOCK_SLOTS = 1 << 12
#: Runs of more groups than this are compared block by block within tasks.
SMALL_RUN = 32
BLOCK = 128


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted: (hash, text, where each
    text's begin; one more at the end)."""
    w = common.Words(texts, lower=True)
    hashes = common.Windows(w.code)
    every = hashes.every(words)
    ok = np.flatnonzero(w.doc[: len(every)] == w.doc[words - 1 :]) if len(every) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.n > 0) & (w.n < words))
    few = hashes.at(w.first[short], w.n[short]) ^ common.mixed(w.n[short].astype(np.uint64)) if len(short) else np.zeros(0, np.uint64)
    item = np.concatenate([every[ok], few])
    doc = np.concatenate([w.doc[ok], short])
    order = np.lexsort((item, doc))
    item, doc = item[order], doc[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])
    item, doc = item[new], doc[new]
    return item, doc, np.searchsorted(doc, np.arange(len(texts) + 1))


def summary(words: int):
    def run(texts: list[bytes]) -> tuple[list[bytes], list[int]]:
        item, _, first = shingles(texts, words)
        return [hashlib.sha256(item[a:z].tobytes()).digest() for a, z in zip(first[:-1], first[1:], strict=True)], np.diff(first).tolist()

    return run


def slot_of(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_counts(sets: DataFrame, words: int) -> np.ndarray:
    """How many sets have an item of each slot: ``SLOTS`` numbers for any input.
    Tables of tasks are summed in two steps, so no step has more than some."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint64)
        for _, texts in common.unpacked(batches):
            total += np.bincount(slot_of(shingles(texts, words)[0]), minlength=SLOTS).astype(np.uint64)
        if total.any():
            parts = total.reshape(-1, BLOCK_SLOTS)
            salt = np.full(len(parts), TaskContext.get().partitionId() % 64, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(salt), pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["block", "salt", "n"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.decompress(x.as_py()), np.uint64) for x in rows.column("n"))
        return pa.table([rows.column("block").slice(0, 1), rows.column("salt").slice(0, 1), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], ["block", "salt", "n"])

    schema = "block int, salt int, n binary"
    tables = sets.mapInArrow(count, schema).groupBy("block", "salt").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    out = np.zeros((SLOTS // BLOCK_SLOTS, BLOCK_SLOTS), np.int64)
    for r in tables.collect():
        out[r.block] = np.frombuffer(zstandard.decompress(bytes(r.n)), np.uint64)
    return out.reshape(-1)


def _prefixes(texts: list[bytes], words: int, percent: int, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, items in order, those of them in the prefix) of each text with items."""
    item, doc, first = shingles(texts, words)
    item = item[np.lexsort((item, counts[slot_of(item)], doc))]
    for i, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if z > a:
            yield i, item[a:z], item[a : a + (z - a) - -(-percent * (z - a) // 100) + 1]


def parity_sketch(items: np.ndarray) -> bytes:
    """Whether each of some 4 to 8 bins an item holds an odd number of items.  Two
    sets differ in at least as many items as their sketches do in bins."""
    bits = 1 << max(6, int(4 * len(items) - 1).bit_length())
    return np.packbits(np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 > 0).tobytes()


def sketches_differ(a: bytes, b: bytes) -> int:
    """Bins in which two sketches differ; the longer one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def block_pairs(x: list[dict], y: list[dict], percent: int, same: bool) -> list[tuple[int, int]]:
    """Pairs of groups from two blocks of a run (or within one, if ``same``) that
    may link: not all in one component, and sizes, positions and sketches allow it.
    Members share a size and a prefix but no more, so the sketch of a group's least
    speaks for a group of one only; pairs of other groups stay."""
    out = []
    column = lambda rows, c: np.array([r[c] for r in rows], np.int64)
    words = np.array([len(r["sketch"]) for r in x]), np.array([len(r["sketch"]) for r in y])
    for a in np.unique(words[0]):
        for b in np.unique(words[1]):
            p, q = ([r for r, n in zip(rows, w.tolist(), strict=True) if n == k] for rows, w, k in ((x, words[0], a), (y, words[1], b)))
            bits = []
            for rows in (p, q):
                m = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1)
                while m.shape[1] > min(a, b):
                    m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
                bits.append(np.ascontiguousarray(m).view(np.uint64))
            gid, low, high, pos, members = (column(q, c) for c in ("gid", "low", "high", "pos", "members"))
            size, at = pos >> 32, pos & 0xFFFFFFFF
            for k, r in enumerate(p):
                n, i = r["pos"] >> 32, r["pos"] & 0xFFFFFFFF
                most = np.minimum(i, at) + 1 + np.minimum(n - 1 - i, size - 1 - at)
                good = (gid > r["gid"]) if same else (gid != r["gid"])
                good &= ~((r["low"] == r["high"]) & (low == high) & (low == r["low"]))
                good &= (100 * np.minimum(n, size) >= percent * np.maximum(n, size)) & ((100 + percent) * most >= percent * (n + size))
                keep = np.flatnonzero(good)
                if len(keep):
                    differ = np.bitwise_count(bits[0][k] ^ bits[1][keep]).sum(1)
                    near = (100 + percent) * differ <= (100 - percent) * (n + size[keep])
                    keep = keep[near | (r["members"] > 1) | (members[keep] > 1)]
                    out += [(min(r["gid"], g), max(r["gid"], g)) for g in gid[keep].tolist()]
    return out


def components(links: DataFrame) -> DataFrame:
    """(doc, comp): the least doc that links (a, b) lead to, for docs with links.

    Each round takes the least label among neighbours and then the label's own
    label, so rounds grow with the logarithm of the longest chain.  Tables are
    written between rounds; nothing but a count reaches the driver.
    """
    edges = common.staged(links.select("a", "b").union(links.select("b", "a")).toDF("doc", "to").distinct())
    labels = common.staged(edges.groupBy("doc").agg(F.min("to").alias("comp")).select("doc", F.least("doc", "comp").alias("comp")))
    while True:
        near = edges.join(labels.select(F.col("doc").alias("to"), F.col("comp").alias("near")).hint("merge"), "to").groupBy("doc").agg(F.min("near").alias("near"))
        step = common.staged(labels.join(near.hint("merge"), "doc").select("doc", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")))
        jump = step.select(F.col("doc").alias("comp"), F.col("comp").alias("next"))
        new = common.staged(step.join(jump.hint("merge"), "comp", "left").select("doc", "old", F.coalesce(F.least("comp", "next"), "comp").alias("comp")))
        labels = new.select("doc", "comp")
        if new.filter("comp <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row.

    A-Z are lower-cased.  A row's set has its distinct ``words``-word shingles; a
    text with fewer words has the whole sequence as its one item, a null, empty
    or blank text has none and links with nothing.  Two rows link when 100 *
    intersection >= percent * union; component_id is the least key that links
    lead to, the row's own included; a null key counts as the greatest.  Rows with
    a repeated or null key are rows of their own.  An empty table gives no rows;
    other columns aren't carried, so their names don't matter.  A long text is
    worked on whole by one task, with some 50 bytes for each of its bytes.  Items
    are 64-bit hashes.
    """
    return common.finished(docs.sparkSession, lambda: _near_duplicates(docs, words, percent, key, text))


def _near_duplicates(docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    table = common.packed_table(docs, summary(words), key, text)
    reps = common.representatives(table.filter("size > 0")).select("doc_id")
    sets = table.select("doc_id", "packed").join(reps.hint("merge"), "doc_id")
    # Of fixed size, whatever the input.
    counts = docs.sparkSession.sparkContext.broadcast(slot_counts(sets, words))

    def group_info(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.unpacked(batches):
            ids = batch.column(0).to_pylist()
            found = [(ids[i], len(s), int.from_bytes(hashlib.blake2b(p.tobytes(), digest_size=8).digest(), "little", signed=True), parity_sketch(s)) for i, s, p in _prefixes(texts, words, percent, counts.value)]
            if found:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["doc", "size", "prefix", "sketch"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.unpacked(batches):
            ids = np.asarray(batch.column(0), np.int64)
            found = [*_prefixes(texts, words, percent, counts.value)]
            if found:
                length = np.array([len(p) for _, _, p in found])
                at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                size = np.repeat(np.array([len(s) for _, s, _ in found], np.int64), length)
                doc = np.repeat(ids[[i for i, _, _ in found]], length)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p for _, _, p in found]).view(np.int64)), pa.array(at << 32 | size), pa.array(doc)], ["key", "doc", "pos"])

    # In buckets for the side of a pair that few pairs share, plain for the other.
    info, plain = common.bucketed_and_plain(sets.mapInArrow(group_info, "doc long, size long, prefix long, sketch binary"), "doc", in_place=True)
    sketches, own_sketches = plain.select("doc", "size", "sketch"), info.select("doc", "size", "sketch")
    info = plain.select("doc", "size", "prefix")
    groups = common.staged(info.groupBy("size", "prefix").agg(F.min("doc").alias("gid"), F.count(F.lit(1)).alias("members")))
    # Members of groups of one need no look-up.
    members = info.join(groups.filter("members > 1").hint("merge"), ["size", "prefix"], "left")
    members = common.staged(members.select("doc", F.coalesce("gid", "doc").alias("gid"), "size"))
    firsts = table.select("doc_id", "packed").join(groups.select(F.col("gid").alias("doc_id")).hint("merge"), "doc_id")
    # Runs are sorted by place in the prefix, so that stands for ``doc`` there.
    met = common.runs(firsts.mapInArrow(entries, "key long, doc long, pos long"), ["key"], "heads", with_keys=True)
    place = lambda c: f"(({c} & 4294967295) << 32 | ({c} >> 32))"
    met = common.staged(met.selectExpr("key", "pos AS doc", f"{place('doc')} AS pos", "head_pos AS head", f"{place('head')} AS head_pos"))

    def may_link(a: str, b: str) -> str:
        """SQL: sizes and positions (size << 32 | index in the prefix) allow a link."""
        na, nb, ia, ib = f"({a} >> 32)", f"({b} >> 32)", f"({a} & 4294967295)", f"({b} & 4294967295)"
        most = f"(least({ia}, {ib}) + 1 + least({na} - 1 - {ia}, {nb} - 1 - {ib}))"
        return f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb}) AND {100 + percent} * {most} >= {percent} * ({na} + {nb})"

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, x, nb, y = (c.to_pylist() for c in batch.columns)
            good = [(100 + percent) * sketches_differ(p, q) <= (100 - percent) * (n + m) for n, p, m, q in zip(na, x, nb, y, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    def filtered(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that their sketches allow to link."""
        one = pairs.hint("merge").join(own_sketches.toDF("b", "nb", "y"), "b")
        two = one.join(sketches.toDF("a", "na", "x").hint("merge"), "a").select("a", "b", "na", "x", "nb", "y")
        return common.staged(two.mapInArrow(alike, "a long, b long"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that link, on their whole sets."""
        pairs = filtered(pairs)
        ids = pairs.select(F.col("a").alias("doc_id"), F.lit(True).alias("first")).union(pairs.select("b", F.lit(False)))
        ids = ids.groupBy("doc_id").agg(F.max("first").alias("first"))

        def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in common.unpacked(batches):
                item, _, first = shingles(texts, words)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([item[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["doc", "first", "items"])

        own = table.select("doc_id", "packed").join(ids.hint("merge"), "doc_id").mapInArrow(hashes, "doc long, first boolean, items binary")
        own, plain = common.bucketed_and_plain(own, "doc", in_place=True)

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

        # The set of b is sent once for a pair, that of a once for all its pairs.
        # Both sides of the join on a are shuffled afresh, so Spark can split a
        # head that many rows have.
        one = pairs.hint("merge").join(own.select(F.col("doc").alias("b"), F.col("items").alias("y")), "b")
        two = one.join(plain.filter("first").select(F.col("doc").alias("a"), F.col("items").alias("x")).hint("merge"), "a").select("a", "b", "x", "y")
        return common.staged(two.mapInArrow(link, "a long, b long"))

    stars = met.filter(f"doc <> head AND {may_link('pos', 'head_pos')}").select(F.col("head").alias("a"), F.col("doc").alias("b"))
    inner = members.filter("doc <> gid").select(F.col("gid").alias("a"), F.col("doc").alias("b"))
    tried = common.staged(stars.union(inner).distinct())
    links = verified(tried)
    comps = components(links)

    # Everything that the heads didn't settle: runs with more than one component left.
    members = common.staged(members.join(comps.hint("merge"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc")))
    spread = common.staged(members.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members")))
    rest = common.staged(met.select("key", F.col("doc").alias("gid"), "pos").join(spread.hint("merge"), "gid"))
    mixed = rest.groupBy("key").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.count(F.lit(1)).alias("m")).filter("l < h").select("key", "m")
    rest = common.staged(rest.join(common.staged(mixed).hint("merge"), "key"))
    few = rest.filter(F.col("m") <= SMALL_RUN)
    left, right = (few.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("gid", "pos", "low", "high"))) for s in "ab")
    pairs = left.join(right.hint("merge"), "key").filter(f"gid_a < gid_b AND NOT (low_a = high_a AND low_b = high_b AND low_a = low_b) AND {may_link('pos_a', 'pos_b')}")
    pairs = pairs.select("gid_a", "gid_b").union(spread.filter("low < high").select("gid", "gid"))

    # Long runs: blocks of some BLOCK groups, and a task's row for each two blocks.
    many = rest.filter(F.col("m") > SMALL_RUN).join(sketches.select(F.col("doc").alias("gid"), "sketch").hint("merge"), "gid")
    blocks = F.ceil(F.col("m") / BLOCK)
    many = many.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("gid"), blocks)})
    many = common.staged(many.groupBy("key", "blocks", "block").agg(F.collect_list(F.struct("gid", "pos", "low", "high", "members", "sketch")).alias("own")))
    low = many.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("own").alias("x"))
    high = many.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("own").alias("y"))
    met_blocks = low.join(high.hint("merge"), ["key", "i", "j"]).select("i", "j", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, x, y = (c[k].as_py() for c in batch.columns)
                found = sorted({*block_pairs(x, y, percent, i == j)})
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["gid_a", "gid_b"])

    pairs = pairs.union(met_blocks.mapInArrow(compare, "gid_a long, gid_b long")).distinct()
    one, two = (members.select(*(F.col(c).alias(f"{c}_{s}") for c in ("doc", "gid", "comp"))) for s in "ab")
    pairs = pairs.join(one.hint("merge"), "gid_a").join(two.hint("merge"), "gid_b").filter("comp_a <> comp_b")
    pairs = pairs.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct()
    pairs = common.staged(pairs.join(tried.hint("merge"), ["a", "b"], "left_anti"))
    more = verified(pairs)
    comps = components(links.union(more)) if not more.isEmpty() else comps

    # Back to all rows: only sets with copies or links need a look-up.
    kinds = table.filter("size > 0").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"))
    kinds = kinds.join(comps.hint("merge"), "doc", "left").filter("copies > 1 OR comp IS NOT NULL")
    kinds = common.staged(kinds.select("digest", F.coalesce("comp", "doc").alias("comp")))
    # The component's least row by its own key; looked up once for each component,
    # so that Spark can split the join of one that many sets belong to.
    names = table.select(F.col("doc_id").alias("comp"), F.col("id").alias("component_id"))
    names = common.staged(kinds.select("comp").distinct().hint("merge").join(names, "comp"))
    kinds = common.staged(kinds.join(names.hint("merge"), "comp"))
    out = table.select("id", "digest", "size").join(kinds.hint("merge"), "digest", "left")
    comp = F.when(F.col("comp").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), comp.alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + {WORDS - 1}], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= {PERCENT} * (x.n + y.n - both_have)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.root),
m AS (SELECT doc_id, min(root) AS component_id FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM m LEFT JOIN n USING (doc_id)
"""
