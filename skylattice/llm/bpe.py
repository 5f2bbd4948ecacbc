"""BPE encoding and decoding in batched numpy merge rounds, and token counts at
every prefix by dynamic programming.

A tokenizer file is read on the driver and broadcast (its size is fixed by the
vocabulary).  In a task, distinct pre-tokens are worked on once and kept in a
cache of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Pre-tokens that a task keeps.
CACHE_ENTRIES = 300_000
#: White space as the tokenizers library's regular expressions take it.
WHITE = r"\t\n\v\f\r \x85\xa0  -     　"
#: The byte-level split that a file names by ``use_regex`` only.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max
#: Lower case of letters that are newer than this Python's tables but not
#: than the library's: single ones, and (first, last, distance).
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEWER_LOWER |= {c: c + d for a, z, d in ((0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)) for c in range(a, z + 1)}
#: Letters and digits (first, last) that Unicode 16 added, which the
#: library has and Python's tables don't.
ADDED = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
#: Below, every character is in all tables.
_FAR = regex.compile("[\u0530-\U0010ffff]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 characters stand for themselves, others follow from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _spaces(pattern: str) -> str:
    """The pattern with \\s and \\S spelt out, as engines differ on control characters."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE if depth else f"[{WHITE}]")
            i += 2
        elif two == r"\S":
            out.append(f"[^{WHITE}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            depth += {"[": 1, "]": -1}.get(pattern[i], 0)
            out.append(pattern[i])
            i += 1
    return "".join(out)


def _steps(spec: dict | None, of: str) -> list[dict]:
    return [] if not spec else spec.get(of, [spec])


class Vocabulary:
    """A BPE file: merges as sorted pair keys, split and normalisation."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.text_of[i] = token
        self.suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.byte_id = np.array([self.ids[c] for c in letters], np.int64)
        self.last_id = np.array([self.ids[c + self.suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([self.ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([self.ids[b] for _, b in pairs], np.int64)
        self.made = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        keys = self.left << 32 | self.right
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self._check(spec)
        split = BYTE_SPLIT
        for step in _steps(spec["pre_tokenizer"], "pretokenizers"):
            if step["type"] == "Split":
                split = step["pattern"]["Regex"]
        self.split = regex.compile(_spaces(split))
        self.normalised = bool(spec.get("normalizer"))
        self.at_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        self.white = regex.compile(f"[{WHITE}]+")
        self.cache: dict[str, bytes] = {}

    def _check(self, spec: dict) -> None:
        """Raises ValueError for what this class would do otherwise than the file says."""
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"model {model['type']} with {odd} isn't supported")
        kinds = [x["type"] for x in _steps(spec.get("normalizer"), "normalizers")]
        if kinds not in ([], ["NFC", "Replace", "Lowercase"]):
            raise ValueError(f"normaliser {kinds} isn't supported")
        for step in _steps(spec.get("normalizer"), "normalizers"):
            if step["type"] == "Replace" and (step["pattern"] != {"Regex": r"\s+"} or step["content"] != " "):
                raise ValueError(f"normaliser {step} isn't supported")
        for step in _steps(spec.get("pre_tokenizer"), "pretokenizers"):
            split = step["type"] == "Split" and "Regex" in step["pattern"] and (step["behavior"], step.get("invert", False)) in (("Isolated", False), ("Removed", True))
            if not split and not (step["type"] == "ByteLevel" and not step.get("add_prefix_space")):
                raise ValueError(f"split {step} isn't supported")
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec["added_tokens"]):
            raise ValueError("added tokens that take spaces or whole words aren't supported")

    # --- encoding

    def normalise(self, text: str) -> str:
        if not self.normalised:
            return text
        text = self.white.sub(" ", unicodedata.normalize("NFC", text))
        if _FAR.search(text):
            text = text.translate(NEWER_LOWER)
        return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def cut(self, text: str) -> list[str]:
        """The split of a text without special tokens.  Characters that Python's tables
        don't have are no letters for the library, whatever this split's tables say."""
        if not _FAR.search(text):
            return self.split.findall(text)
        odd = {ord(c): "§" for c in {*text} if unicodedata.category(c) == "Cn" and not any(a <= ord(c) <= z for a, z in ADDED)}
        if not odd:
            return self.split.findall(text)
        return [text[m.start() : m.end()] for m in self.split.finditer(text.translate(odd))]

    def pieces(self, text: str) -> list[str]:
        """The text's pre-tokens; special tokens stand among them as they are."""
        if not any(x in text for x in self.special):
            return self.cut(self.normalise(text))
        out: list[str] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(part)
            else:
                out += self.cut(self.normalise(part))
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, by binary search; NONE without one."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge_rounds(self, words: list[bytes]) -> list[np.ndarray]:
        """The token ids of each word (not empty).  All words' symbols are in one
        flat array; each round merges the pairs of least rank of every word."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        if not len(symbol):
            return out
        ends = np.cumsum(sizes) - 1
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol[ends] = self.last_id[raw[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        while len(symbol):
            rank = np.full(len(symbol), NONE)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.ranks(symbol[inside], symbol[inside + 1])
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.append(begin, len(word)))
            least = np.minimum.reduceat(rank, begin)
            over = np.repeat(least == NONE, count)
            if over.any():
                for k in np.flatnonzero(least == NONE):
                    out[word[begin[k]]] = symbol[begin[k] : begin[k] + count[k]]
            hit = np.flatnonzero((rank == np.repeat(least, count)) & ~over)
            # In a row of overlapping pairs (aaa) every second one merges, from the left.
            fresh = np.concatenate([[True], np.diff(hit) != 1]) if len(hit) else np.zeros(0, bool)
            order = np.arange(len(hit))
            hit = hit[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            stay = ~over
            stay[hit + 1] = False
            symbol, word = symbol[stay], word[stay]
        return out

    def _known(self, pieces: list[str], work: Callable[[list[str]], list[bytes]]) -> Callable[[str], bytes]:
        new = [p for p in {*pieces} if p not in self.cache]
        if new:
            if len(self.cache) + len(new) > CACHE_ENTRIES:
                self.cache.clear()
                new = [*{*pieces}]
            self.cache.update(zip(new, work(new), strict=True))
        return self.cache.__getitem__

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids (uint32) of each text."""

        def work(new: list[str]) -> list[bytes]:
            plain = [i for i, p in enumerate(new) if p not in self.special]
            ids = [b""] * len(new)
            for i, x in zip(plain, self.merge_rounds([new[i].encode() for i in plain]), strict=True):
                ids[i] = x.astype("<u4").tobytes()
            for i, p in enumerate(new):
                if p in self.special:
                    ids[i] = np.array([self.special[p]], "<u4").tobytes()
            return ids

        pieces = [self.pieces(t) for t in texts]
        get = self._known([p for x in pieces for p in x], work)
        return [np.frombuffer(b"".join(map(get, x)), "<u4") for x in pieces]

    def decode(self, ids: np.ndarray) -> str:
        """What the file's decoder gives: token texts joined by a space, as the
        file has none."""
        return " ".join(map(self.text_of.__getitem__, ids.tolist()))


class PrefixCounts(Vocabulary):
    """Exact token counts at every prefix, for a byte-level file without
    normalisation.

    For each prefix of a pre-token there is one token that its encoding ends in;
    it is the only one among the tokens that end there which can follow the last
    token of the shorter prefix.  So the table of last tokens and counts is
    filled from left to right, without encoding any prefix.
    """

    def __init__(self, data: bytes):
        super().__init__(data)
        spec = json.loads(data)
        steps = _steps(spec["pre_tokenizer"], "pretokenizers")
        if self.normalised or self.suffix or [x["type"] for x in steps] != ["ByteLevel"] or not steps[0].get("use_regex", True):
            raise ValueError("prefixes are counted for the plain byte-level split only")
        n = len(self.text_of)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.born = np.full(n, -1)
        self.born[self.made] = np.arange(len(self.made))
        self.parts = np.full((2, n), -1)
        self.parts[0, self.made], self.parts[1, self.made] = self.left, self.right
        # The tokens' trie: sorted (state * 256 + byte) and the states they lead to.
        steps: dict[int, int] = {}
        token_at = [-1]
        whole = self.merge_rounds([bytes(byte_of[c] for c in t) for t in self.ids])
        for (token, i), own in zip(self.ids.items(), whole, strict=True):
            if len(own) != 1:  # its own text encodes otherwise, so it never appears
                continue
            state = 0
            for c in token:
                state = steps.setdefault(state << 8 | byte_of[c], len(token_at))
                if state == len(token_at):
                    token_at.append(-1)
            token_at[state] = i
        self.step_keys = np.array(sorted(steps), np.int64)
        self.step_to = np.array([steps[k] for k in self.step_keys.tolist()], np.int64)
        self.token_at = np.array(token_at, np.int64)

    def can_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the bytes of tokens a and b together gives a and b.

        Goes back in time through the merges that made the last part of a and the
        first part of b.  The encoding differs if the parts that touch have a
        merge of their own that comes before either is merged into its token; at
        equal ranks the left pair goes first.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        gone_a = np.full(len(a), NONE)
        gone_b = np.full(len(a), NONE)
        a, b = a.copy(), b.copy()
        while len(at):
            rank = self.ranks(a, b)
            cross = (rank != NONE) & (rank < gone_a) & (rank <= gone_b)
            ok[at[cross]] = False
            born_a, born_b = self.born[a], self.born[b]
            go = ~cross & ((born_a >= 0) | (born_b >= 0))
            undo_a = born_a > born_b
            gone_a = np.where(undo_a, born_a, gone_a)
            gone_b = np.where(undo_a, gone_b, born_b)
            a = np.where(undo_a, self.parts[1, a], a)
            b = np.where(undo_a, b, self.parts[0, b])
            at, a, b, gone_a, gone_b = at[go], a[go], b[go], gone_a[go], gone_b[go]
        return ok

    def tables(self, words: list[bytes]) -> list[np.ndarray]:
        """For each word the token counts of its prefixes of 1, 2, ... bytes."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        first = np.repeat(begin, sizes)
        end = np.repeat(begin + sizes, sizes)
        start, state, length = np.arange(len(raw)), np.zeros(len(raw), np.int64), 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(start):
            key = state << 8 | raw[start + length]
            i = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            hit = self.step_keys[i] == key
            start, state, length = start[hit], self.step_to[i[hit]], length + 1
            token = self.token_at[state]
            is_token = token >= 0
            found.append((start[is_token], start[is_token] + length, token[is_token]))
            more = start + length < end[start]
            start, state = start[more], state[more]
        s, e, t = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        depth = e - first[s]
        order = np.argsort(depth, kind="stable")
        s, e, t = s[order], e[order], t[order]
        cuts = np.searchsorted(depth[order], np.arange(1, int(sizes.max(initial=0)) + 2))
        count = np.zeros(len(raw) + 1, np.int32)
        last = np.full(len(raw) + 1, -1)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            a, z, tok = s[lo:hi], e[lo:hi], t[lo:hi]
            whole = a == first[a]
            good = whole.copy()
            rest = np.flatnonzero(~whole)
            good[rest] = self.can_follow(last[a[rest] - 1], tok[rest])
            a, z, tok, whole = a[good], z[good], tok[good], whole[good]
            count[z - 1] = np.where(whole, 0, count[a - 1]) + 1
            last[z - 1] = tok
        return [count[i : i + n] for i, n in zip(begin, sizes, strict=True)]

    def prefixes(self, texts: list[str]) -> list[np.ndarray]:
        """For each text an int32 array: entry i is the number of tokens of its
        first i bytes (exact where byte i begins a character)."""

        def work(new: list[str]) -> list[bytes]:
            plain = [p for p in new if p not in self.special]
            table = dict(zip(plain, self.tables([p.encode() for p in plain]), strict=True))
            for p in ("'re", "'ve", "'ll"):  # cut after the letter, these are two pre-tokens
                if p in table:
                    table[p] = np.array([1, 2, table[p][2]], np.int32)
            for p in new:
                if p in self.special:
                    # Cut inside, it is ordinary text; the whole is one token.
                    table[p] = np.append(self._plain(p[:-1])[1:], np.int32(1)).astype(np.int32)
            return [table[p].tobytes() for p in new]

        pieces = [self.pieces(t) for t in texts]
        # After a run of white space the text so far ends in the whole run as one pre-token.
        wide = [[(m.start(), m.group()) for m in _WIDE.finditer(t)] for t in texts]
        get = self._known([*(p for x in pieces for p in x), *(run for x in wide for _, run in x)], work)
        out = []
        for text, own, white in zip(texts, pieces, wide, strict=True):
            tables = [*map(get, own)]
            inside = np.frombuffer(b"".join(tables), np.int32)
            sizes = np.fromiter(map(len, tables), np.int64, len(tables)) // 4
            count = np.zeros(len(inside) + 1, np.int32)
            if len(tables):
                total = np.cumsum(inside[np.cumsum(sizes) - 1])
                count[1:] = inside + np.repeat(np.concatenate([[0], total[:-1]]), sizes)
            for at, run in white:
                a = len(text[:at].encode())
                count[a + len(run.encode())] = count[a] + np.frombuffer(get(run), np.int32)[-1]
            out.append(count)
        return out

    def _plain(self, text: str) -> np.ndarray:
        own = self.tables([p.encode() for p in self.split.findall(text)])
        out = [0]
        for x in own:
            base = out[-1]
            out += [base + int(v) for v in x]
        return np.array(out, np.int32)


_WIDE = regex.compile(f"[{WHITE}]{{2,}}(?=[^{WHITE}])")
_loaded: dict[tuple[type, bytes], Vocabulary] = {}


def loaded(kind: type, data: bytes):
    """The vocabulary, made once in each Python worker."""
    key = (kind, hashlib.sha256(data).digest())
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = kind(data)
    return _loaded[key]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[str]]]:
    for batch, raw in common.text_chunks(batches):
        yield batch, raw, [x.decode("utf-8", "replace") for x in raw]


def _file(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of each row.

    As the tokenizers library encodes with add_special_tokens=False: special
    tokens in a text are found, white space and case go as the file says.  A
    null or empty text has no ids and decodes to an empty text; a text of white
    space alone likewise.  Each row stands alone: repeated rows repeat, an empty
    table gives none, a null key stays null, and other columns aren't carried.
    """
    data = _file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(Vocabulary, data.value)
        for batch, _, texts in _texts(batches):
            ids = v.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([v.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode``, with digests in place of ids and texts."""
    data = _file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(Vocabulary, data.value)
        for batch, _, texts in _texts(batches):
            ids = v.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts at every prefix as differences, one plane of bytes after another: nearly
    all are 0 or 1."""
    steps = np.diff(counts, prepend=np.int32(0)).astype("<i4")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").reshape(-1), dtype=np.int32)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, store: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and limit_bytes: the longest prefix,
    cut between characters, of at most ``limit`` tokens.

    With ``store`` also ``counts`` (binary, see ``unpacked_counts``): entry i is the
    number of tokens of the first i bytes, which answers any truncation or budget
    question (``truncated``).  A null or empty text has 0 bytes and tokens.  Each
    row stands alone: repeated rows repeat, an empty table gives none, a null key
    stays null, other columns aren't carried, so their names don't matter.  A long
    text is worked on whole by one task.
    """
    data = _file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(PrefixCounts, data.value)
        for batch, raw, texts in _texts(batches):
            counts = v.prefixes(texts)
            cuts = []
            for x, c in zip(raw, counts, strict=True):
                if c[-1] <= limit:
                    cuts.append(len(x))
                    continue
                at = np.flatnonzero(c <= limit)
                bits = np.frombuffer(x + b" ", np.uint8)[at]
                cuts.append(int(at[(bits & 0xC0) != 0x80][-1]))
            columns = [batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([int(c[-1]) for c in counts], pa.int64()), pa.array([bool(c[-1] > limit) for c in counts]), pa.array(cuts, pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_bytes"]
            if store:
                columns, names = [*columns, pa.array([packed_counts(c) for c in counts], pa.binary())], [*names, "counts"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_bytes long" + ", counts binary" * store
    return docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text").mapInArrow(run, schema)


def truncated(counted: DataFrame, budget: int) -> DataFrame:
    """doc_id and n_bytes from stored counts, without the texts: the longest prefix
    of at most ``budget`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [int(np.flatnonzero(unpacked_counts(x.as_py()) <= budget)[-1]) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.int64())], ["doc_id", "n_bytes"])

    return counted.select("doc_id", "counts").mapInArrow(run, "doc_id long, n_bytes long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), store=True)
