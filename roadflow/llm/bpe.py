"""Byte-level BPE: encoding by a segment tree over the ranks of adjacent pairs, and decoding.

A text is cut at the added tokens and then into pieces by the pattern of byte-level tokenizers. A piece
is a row of byte tokens; the leaves of a segment tree hold the merge rank of each adjacent pair with its
place, so the root is the leftmost pair of lowest rank. Merging it changes two neighbouring leaves, each
in logarithmic time, and the piece is done when no leaf holds a rank: n log n steps for any length. Short pieces of many texts
are worked on side by side, one merge of every tree at a time. Pieces met before come from a bounded cache of the worker.

The vocabulary file of a public tokenizer is a parameter (a JSON file of the tokenizers library with a
byte-level BPE model). It is read on the driver and broadcast; its size is that of the vocabulary.

Null texts count as empty and give no tokens. Repeated rows are encoded one by one; an empty table gives no rows. Other
columns pass through; one with the name of a result is an error, and the results can be named otherwise. A text of any
length is encoded whole; one text must fit a worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slices, worker_slot

#: Pieces that one of the two generations of a worker's cache holds.
CACHED = 100_000
#: Rows for which tokens are handed back at once.
ROWS = 500
#: Leaves of the widest tree that is worked on side by side with others, and how many at a time.
WIDE, TREES = 64, 4096
#: Characters of texts whose pieces are looked up together.
TOGETHER = 1_000_000
NONE = 1 << 62

# Letters and numbers that came with Unicode 17 and later. The tokenizers library
# knows Unicode 16, so to it these are neither.
NEWER = """
0558-0558, 058B-058C, 088F-088F, 0C5C-0C5C, 0CDC-0CDC, 208F-208F, 209D-209F, A7CE-A7CF, A7D2-A7D2, A7D4-A7D4,
A7DD-A7DD, A7E2-A7E2, A7F1-A7F1, AB6C-AB6D, 107BB-107BF, 10940-10959, 10EC5-10EC7, 10ED9-10EEE, 11B0A-11B0A,
11DB0-11DDB, 11DE0-11DE9, 11DF1-11DF1, 1246F-1246F, 12475-1247F, 12550-12686, 16EA0-16EB8, 16EBB-16ED3,
16FF2-16FF6, 187F8-187FF, 18CD6-18CDA, 18D09-18D20, 18D80-18DF2, 18E00-19191, 191A0-191D2, 1B123-1B128,
1B168-1B168, 1D6A6-1D6A6, 1DF1F-1DF24, 1DF2B-1DF81, 1DF90-1DF96, 1DFCD-1DFFF, 1E6C0-1E6DE, 1E6E0-1E6E2,
1E6E4-1E6E5, 1E6E7-1E6ED, 1E6F0-1E6F4, 1E6FE-1E6FF, 2B73A-2B73F, 2B81E-2B81E, 2CEA2-2CEAD, 323B0-33479, 3D000-3FC3F
"""


# The split of byte-level tokenizers into contractions, words, numbers, other runs, white space.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
PLAIN = regex.compile(rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+")


def exact_splitter() -> regex.Pattern:
    """The same split with the letters and numbers of Unicode 16."""
    newer = "".join(r"\U{0:0>8}-\U{1:0>8}".format(*r.strip().split("-")) for r in NEWER.split(","))
    letter, number = rf"[\p{{L}}--[{newer}]]", rf"[\p{{N}}--[{newer}]]"
    return regex.compile(
        rf"{CONTRACTIONS}| ?{letter}+| ?{number}+| ?(?:(?!{letter}|{number})\S)+|\s+(?!\S)|\s+", regex.V1)


EXACT = exact_splitter()


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one above 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


class Codec:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, spec: str) -> None:
        given = json.loads(spec)
        model, split = given["model"], given["pre_tokenizer"]
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or any(model.get(k) not in (v, "") for k, v in plain.items()):
            raise ValueError("a byte-level BPE model without prefixes, suffixes or dropout is needed")
        if split["add_prefix_space"] or given["normalizer"] or any(
                t["single_word"] or t["lstrip"] or t["rstrip"] for t in given["added_tokens"]):
            raise ValueError("normalizers, prefix spaces and added tokens that take in blanks are not supported")
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, k in vocab.items():
            self.bytes[k] = bytes(map(back.get, token)) if all(c in back for c in token) else token.encode()
        for token, k in self.added.items():
            self.bytes[k] = token.encode()
        self.first = [vocab[alphabet[b]] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 32 | vocab[b]] = k
            self.result.append(vocab[a + b])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pairs = np.array(sorted(self.rank), np.int64)
        self.pair_rank = np.array([self.rank[p] for p in self.pairs.tolist()], np.int64)
        self.merged = np.array(self.result, np.int64)
        self.fixed = {token: np.int32(k).tobytes() for token, k in self.added.items()}
        self.new: dict[str, bytes] = dict(self.fixed)
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        ids = [self.first[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        rank, none = self.rank.get, 1 << 62
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[size + i] = r << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(at: int, value: int) -> None:
            at += size
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    return
                tree[at] = value

        def pair(i: int, j: int) -> int:
            r = rank(ids[i] << 32 | ids[j])
            return none if r is None else r << 32 | i

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree[1]) != none:
            i = best & 0xFFFFFFFF
            ids[i] = self.result[best >> 32]
            j = after[i]
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                put(j, none)
                put(i, pair(i, k))
            else:
                put(i, none)
            if before[i] >= 0:
                put(before[i], pair(before[i], i))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, ``NONE`` where they do not merge."""
        asked = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
        return np.where(self.pairs[at] == asked, self.pair_rank[at], NONE) if len(self.pairs) else np.full(left.shape, NONE)

    def merge_level(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Packed ids of pieces of 2 to ``size`` + 1 bytes: one tree of ``size`` leaves each, all trees a merge at a time."""
        n, width = len(pieces), size + 1
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = np.asarray(self.first, np.int64)[raw]
        place = np.arange(width)
        alive = place < length[:, None]
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))

        def leaf(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            found = self.ranks(ids[row, i], ids[row, np.minimum(j, size)])
            return np.where((j < length[row]) & (found < NONE), found << 32 | i, NONE)

        tree = np.full((n, 2 * size), NONE)
        every = np.repeat(np.arange(n), size)
        tree[:, size:] = leaf(every, np.tile(place[:-1], n), np.tile(place[1:], n)).reshape(n, size)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            best = tree[row, 1]
            i = best & 0xFFFFFFFF
            ids[row, i] = self.merged[best >> 32]
            j = after[row, i]
            k = after[row, i] = after[row, j]
            alive[row, j] = False
            more = k < length[row]
            before[row[more], k[more]] = i[more]
            p = before[row, i]
            has = p >= 0
            inner = j < size
            changed = [(row, i, leaf(row, i, k)), (row[inner], j[inner], np.full(inner.sum(), NONE)),
                       (row[has], p[has], leaf(row[has], p[has], i[has]))]
            for r, at, value in changed:
                tree[r, at + size] = value
            for r, at, _ in changed:
                at = at + size
                while size > 1 and len(at) and at[0] > 1:
                    at = at >> 1
                    tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])
            row = row[tree[row, 1] < NONE]
        ends = np.cumsum(alive.sum(1)).tolist()
        flat = ids[alive].astype(np.int32).tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]

    def learn(self, pieces: set[str]) -> None:
        """Packed ids of ``pieces`` into the cache; older ones go when a generation is full."""
        missing = pieces.difference(self.new)
        if missing and len(self.new) + len(missing) > CACHED:
            self.old, self.new, missing = self.new, dict(self.fixed), pieces.difference(self.fixed)
        levels: dict[int, list[str]] = {}
        for p in missing:
            known = self.old.get(p)
            if known is not None:
                self.new[p] = known
            else:
                # One character can be four bytes: the tree is chosen by the bytes.
                n = len(p.encode()) - 1
                levels.setdefault(1 << (n - 1).bit_length() if n > 1 else n, []).append(p)
        for size, some in levels.items():
            if 1 <= size <= WIDE:
                for at in range(0, len(some), TREES):
                    part = some[at : at + TREES]
                    self.new.update(zip(part, self.merge_level([p.encode() for p in part], size)))
            else:
                for p in some:
                    self.new[p] = np.array(self.merge(p.encode()), np.int32).tobytes()

    def cuts(self, text: str | None) -> list[str]:
        """A text as its pieces and added tokens; no piece reads like an added token, else it had been cut there."""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]) if text else ():
            if k % 2:
                out.append(part)
            elif part:
                try:
                    part.encode("latin-1")
                    out += PLAIN.findall(part)
                except UnicodeEncodeError:
                    out += EXACT.findall(part)
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Packed 32-bit ids of each text. Texts are taken together up to ``TOGETHER`` characters."""
        out, cut, held = [], [], 0
        for k, text in enumerate(texts):
            cut.append(self.cuts(text))
            held += len(text or "")
            if held >= TOGETHER or k + 1 == len(texts):
                self.learn(set().union(*cut))
                out += [b"".join(map(self.new.__getitem__, pieces)) for pieces in cut]
                cut, held = [], 0
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def codec_of(spec: str) -> Codec:
    """One codec for each vocabulary and worker, so its cache outlives a task."""
    return worker_slot(("bpe", hash(spec)), lambda: Codec(spec))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def columns(docs: DataFrame, path: str, tokens: str | None, decoded: str | None, given: str | None = None) -> DataFrame:
    """``docs`` with the asked columns: ids of ``text`` (or those in the column ``given``), and the text they stand for."""
    added = [T.StructField(tokens, T.ArrayType(T.IntegerType()))] if tokens else []
    added += [T.StructField(decoded, T.StringType())] if decoded else []
    if clash := sorted({f.name for f in added} & set(docs.columns)):
        raise ValueError(f"the input has columns {clash}; name the results otherwise")
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in slices(batches, ROWS):
            if given:
                column = batch.column(given)
                ids, ends, known = column.values.to_numpy(), column.offsets.to_numpy(), column.is_valid().to_pylist()
            else:
                packed = codec.encode_all(batch.column("text").to_pylist())
                ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
                ids, known = np.frombuffer(b"".join(packed), np.int32), [True] * len(packed)
            new = [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))] if tokens else []
            if decoded:
                new.append(pa.array([codec.decode(ids[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], known)], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[f.name for f in added]])

    return docs.mapInArrow(run, T.StructType([*docs.schema, *added]))


def encode(docs: DataFrame, path: str, tokens: str = "tokens") -> DataFrame:
    """``docs`` with ``tokens``: the ids of ``text``."""
    return columns(docs, path, tokens, None)


def decode(encoded: DataFrame, path: str, tokens: str = "tokens", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with ``decoded``: the text that ``tokens`` stand for, null for null."""
    return columns(encoded, path, None, decoded, tokens)


def round_trip(docs: DataFrame, path: str, tokens: str = "tokens", decoded: str = "decoded") -> DataFrame:
    """``docs`` with ids and the text decoded from these ids, in one pass over the texts."""
    return columns(docs, path, tokens, decoded)


def report(decoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
