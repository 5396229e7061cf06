"""Byte-pair encoding of whole columns of texts with a public byte-level vocabulary.

Texts are split into words by classes of their code points, for a whole batch at once. Words are made distinct by
Arrow's dictionary encoding, each new word is encoded once and remembered, and the ids are gathered by offsets, so that
no Python loop runs over the words of a text.

A word is encoded on a segment tree over its byte positions. A leaf holds the rank of the pair that begins at its
byte, an inner node the smallest key (rank, position) below it, so the root names the leftmost pair of lowest rank.
A merge joins that pair, and updates the leaves of the merged part and of the live part before it, with a logarithmic
number of nodes each. All new words of similar length are rows of one array and take a merge step together.

Defined results: null and empty texts have the empty list; no special tokens, and their strings in a text are plain
text; nothing is cut, whatever the length.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Words remembered by a Python worker; beyond it the memory starts anew, the result stays the same.
REMEMBERED_WORDS = 400_000

#: Up to so many new words of a length are encoded one by one.
FEW_WORDS = 96

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")  # behind an apostrophe; fixed by the vocabulary's word pattern
_WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_NONE = np.int64(2**62)


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """The class of each code point, by the Unicode data of Python."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        if (kind := unicodedata.category(chr(i))[0]) in "LN":
            out[i] = LETTER if kind == "L" else NUMBER
    out[_WHITE_SPACE] = SPACE
    return out


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mask of the code points at which a word begins; ``first`` marks the first of each text."""
    n = len(points)
    kind = code_point_classes()[points]
    blank = points == 0x20
    before = np.concatenate([[255], kind[:-1]])
    before[first] = 255
    last = np.concatenate([first[1:], [True]])
    start = first | (kind != before)
    # A space right before anything but white space joins it; the rest of the white space is a word of its own.
    space = kind == SPACE
    joins = space & ~last & np.concatenate([~space[1:], [False]])
    start |= joins
    attached = np.concatenate([[False], (joins & blank)[:-1]]) & ~first
    start &= ~attached
    # An apostrophe that begins a word, with one of the endings behind it, is a word; another begins after it.
    quote = np.flatnonzero((points == 0x27) & start)
    taken = np.zeros(len(quote), bool)
    for ending in _CONTRACTIONS:
        k = len(ending)
        hit = ~taken & (quote + k < n)
        at = quote[hit]
        good = np.ones(len(at), bool)
        for i, c in enumerate(ending, 1):
            good &= (points[at + i] == ord(c)) & ~first[at + i]
        at = at[good]
        taken[np.flatnonzero(hit)[good]] = True
        for i in range(1, k + 1):
            start[at + i] = False
        behind = at[at + k + 1 < n] + k + 1
        start[behind] = True
    return start


class Encoder:
    """Encodes byte strings; made once in each Python worker."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, merges = model["vocab"], model["merges"]
        # The bytes that stand for themselves as characters, and the rest shifted behind 255: the format's fixed rule.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.byte_ids = np.array([ids[chars[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self._pair_dict, self._merged_list, self._byte_list = dict(zip(self.keys.tolist(), self.ranks.tolist())), self.merged.tolist(), self.byte_ids.tolist()
        self.known: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.offsets, self.values = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or _NONE."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode_rows(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte strings, the rows of ``data`` (padded to a power of two): the ids in order, and their number by row."""
        rows, width = data.shape
        ids = self.byte_ids[data]
        bits = max(1, width.bit_length())
        place = np.arange(width)
        tree = np.full((rows, 2 * width), _NONE, np.int64)  # node 1 is the root, leaf p is node width + p
        if width > 1:
            rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
            rank[place[None, :-1] >= lengths[:, None] - 1] = _NONE
            tree[:, width : 2 * width - 1] = np.where(rank < _NONE, rank << bits | place[:-1], _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.broadcast_to(place + 1, (rows, width)).copy()  # the next live part
        prior = np.broadcast_to(place - 1, (rows, width)).copy()  # the live part before
        live = place < lengths[:, None]
        active = np.flatnonzero(tree[:, 1] < _NONE)
        while len(active):
            best = tree[active, 1]
            at, rank = best & ((1 << bits) - 1), best >> bits
            gone = after[active, at]
            ids[active, at] = self.merged[rank]
            live[active, gone] = False
            follow = after[active, gone]
            after[active, at] = follow
            some = follow < lengths[active]
            prior[active[some], follow[some]] = at[some]
            self._set(tree, active, gone, np.full(len(active), _NONE))
            new = np.full(len(active), _NONE)
            new[some] = self.pair_ranks(ids[active[some], at[some]], ids[active[some], follow[some]])
            self._set(tree, active, at, np.where(new < _NONE, new << bits | at, _NONE))
            back = prior[active, at]
            some = back >= 0
            rows_, back, at = active[some], back[some], at[some]
            new = self.pair_ranks(ids[rows_, back], ids[rows_, at])
            self._set(tree, rows_, back, np.where(new < _NONE, new << bits | back, _NONE))
            active = active[tree[active, 1] < _NONE]
        return ids[live], live.sum(1)

    def encode_one(self, word: bytes) -> np.ndarray:
        """The same steps for a single word, without the cost of array calls: for the few words of rare lengths."""
        ids, n = [self._byte_list[b] for b in word], len(word)
        rank_of, merged = self._pair_dict, self._merged_list
        width = 1 << max(0, n - 1).bit_length()
        bits = width.bit_length()
        none = int(_NONE)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (r := rank_of.get(ids[i] << 20 | ids[i + 1])) is not None:
                tree[width + i] = r << bits | i
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def put(at: int, key: int) -> None:
            node = width + at
            tree[node] = key
            while node > 1:
                a, b = tree[node], tree[node ^ 1]
                node >>= 1
                key = a if a < b else b
                if tree[node] == key:
                    return
                tree[node] = key

        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        mask = (1 << bits) - 1
        while (best := tree[1]) < none:
            at = best & mask
            gone = after[at]
            follow = after[gone]
            ids[at], ids[gone], after[at] = merged[best >> bits], -1, follow
            put(gone, none)
            r = None
            if follow < n:
                prior[follow] = at
                r = rank_of.get(ids[at] << 20 | ids[follow])
            put(at, none if r is None else r << bits | at)
            if (back := prior[at]) >= 0:
                r = rank_of.get(ids[back] << 20 | ids[at])
                put(back, none if r is None else r << bits | back)
        return np.array([x for x in ids if x >= 0], np.int32)

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
        """Point update of a leaf in each of ``rows``, and of the nodes above it."""
        node = at + tree.shape[1] // 2
        tree[rows, node] = key
        while node.size and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def learn(self, words: list[bytes]) -> None:
        """Encode and remember words that aren't known yet."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        widths = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        for width in np.unique(widths):
            group = np.flatnonzero(widths == width)
            if len(group) < FEW_WORDS:
                for i in group:
                    found[i] = self.encode_one(words[i])
                continue
            step = max(1, (1 << 21) // int(width))  # rows of a block, so that a block stays within some tens of MB
            for part in (group[i : i + step] for i in range(0, len(group), step)):
                raw = np.frombuffer(b"".join(words[i].ljust(int(width), b"\0") for i in part), np.uint8)
                ids, counts = self.encode_rows(raw.reshape(len(part), int(width)), sizes[part])
                for i, x in zip(part, np.split(ids.astype(np.int32), np.cumsum(counts)[:-1])):
                    found[i] = x
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words))))
        ends = self.offsets[-1] + np.cumsum([len(x) for x in found])
        self.offsets = np.concatenate([self.offsets, ends])
        self.values = np.concatenate([self.values, *found])

    def encode(self, texts: pa.Array) -> pa.LargeListArray:
        """Lists of ids, one for each text; null for null is left to the caller: here a null is an empty list."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        total = int(offsets[-1] - offsets[0])
        if not total:
            return pa.LargeListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int64)), pa.array([], pa.int32()))
        data = texts.buffers()[2].slice(int(offsets[0]), total)
        offsets = offsets - offsets[0]
        b = np.frombuffer(data, np.uint8)
        points = np.frombuffer(data.to_pybytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((b & 0xC0) != 0x80)  # the first byte of each code point
        first = np.zeros(len(points), bool)
        rank = np.cumsum((b & 0xC0) != 0x80)
        begins = offsets[:-1][np.diff(offsets) > 0]
        first[rank[begins] - 1] = True
        starts = place[word_starts(points, first)]
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, total).astype(np.int64)), data]
        ).dictionary_encode()
        distinct, which = words.dictionary.to_pylist(), words.indices.to_numpy()
        if len(self.known) + len(distinct) > REMEMBERED_WORDS:
            self.forget()
        if new := [w for w in distinct if w not in self.known]:
            self.learn(new)
        known = self.known
        slot = np.fromiter((known[w] for w in distinct), np.int64, len(distinct))[which]
        size = self.offsets[slot + 1] - self.offsets[slot]
        ends = np.cumsum(size)
        flat = self.values[np.arange(ends[-1]) + np.repeat(self.offsets[slot] - (ends - size), size)]
        upto = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return pa.LargeListArray.from_arrays(pa.array(upto), pa.array(flat))


@lru_cache(2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def text_slices(batch: pa.RecordBatch, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text (its last column), at least a row each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(int(a), int(b - a))


def shipped(spark: SparkSession, vocabulary: str) -> str:
    """The name under which the workers find a vocabulary: the driver serves its file to all of them."""
    if os.path.isfile(vocabulary):
        spark.sparkContext.addFile(vocabulary)
        return os.path.basename(vocabulary)
    return vocabulary


def _encoder(vocabulary: str) -> Encoder:
    own = SparkFiles.get(vocabulary)
    return encoder(own if os.path.exists(own) else vocabulary)


def encode_texts(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """``<keep>, ids``: the token ids of each row's text. A map over the rows: no shuffle, other columns are ignored."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    served = shipped(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(served)
        for batch in batches:
            for part in text_slices(batch):
                if part.num_rows:
                    lists = enc.encode(part.column(part.num_columns - 1)).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*keep, ids])

    return df.select(*keep, text).mapInArrow(run, f"{kinds}, `{ids}` array<int>")


def token_counts(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), count: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """``<keep>, n_tokens``: like ``encode_texts``, but only the number of ids leaves Python."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    served = shipped(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(served)
        for batch in batches:
            for part in text_slices(batch):
                if part.num_rows:
                    sizes = pc.list_value_length(enc.encode(part.column(part.num_columns - 1)))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], sizes], names=[*keep, count])

    return df.select(*keep, text).mapInArrow(run, f"{kinds}, `{count}` bigint")
