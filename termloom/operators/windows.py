"""Token windows that may be names of a dictionary.

Tokens, their windows and the hashes of the windows' skeletons are computed for a whole Arrow batch at once: a byte
table gives the classes, sums of byte times power give the hash of any window from two places. A window leaves Python
only if its hash is in a bitmap of the dictionary's hashes. The bitmap has a fixed largest size whatever the
dictionary's, so it can be sent to every machine; what it lets through is joined with the dictionary exactly.

In documents that define acronyms (``long form (ABC)``), a window equal to an acronym is looked up by the long form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.keys import LOWER, PUNCT, SPACE, key_of, skeleton

# The bytes that separate tokens, and those that form tokens of their own.
SEPARATORS = "\t\n\r !'()+,./:;?[]_{|}"
OWN_TOKENS = "*-"

#: The largest bitmap has 128 MB. With a hundred million names a third of its bits are set; it then lets one window in a hundred through in vain, smaller ones one in thousands.
BITMAP_MOST_BITS = 30
#: So many bits of a word of the bitmap stand for a hash.
PROBES = 4
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _table(*groups: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for k, chars in enumerate(groups, 1):
        out[[ord(c) for c in chars]] = k
    return out


_TOKEN_CLASS = _table(SEPARATORS, OWN_TOKENS)
_TOKEN_CLASS[0] = 1
_KEEP = _table(SPACE + PUNCT + "\0") == 0
_UPPER = np.arange(256, dtype=np.uint64)
_UPPER[[ord(c) for c in LOWER]] -= np.uint64(32)

# What goes at the begin and at the end of a match, and the brackets, which go without their partner or with it.
_DROP_FIRST = _table("!\"'),.:;?]}") == 1
_DROP_LAST = _table("!\"'(,.:;?[{") == 1
BRACKETS = "()[]{}"
_OPENERS = _table(BRACKETS[::2]) == 1
_CLOSERS = _table(BRACKETS[1::2]) == 1
_ENDS = _DROP_FIRST | _DROP_LAST | _OPENERS | _CLOSERS


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, _INVERSE))


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _mask(h: np.ndarray) -> np.ndarray:
    """The bits of a hash in its word, by its lowest bits; its highest tell the word."""
    out = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        out |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return out


def hash_strings(strings: pa.Array) -> np.ndarray:
    """The hash of each byte string, as of a window with this skeleton."""
    b, offsets = _buffer(strings)
    up, down = _powers(len(b))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((_UPPER[b] + np.uint64(1)) * up[:-1], dtype=np.uint64)])
        return _mix((sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]])


def _buffer(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    strings = pc.fill_null(strings.cast(pa.large_string()), "")
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = strings.buffers()[2]
    b = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return b, offsets - offsets[0]


@dataclass(frozen=True)
class Bitmap:
    """The hashes of a dictionary, ``bits`` wide."""

    bits: int
    words: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        mask = _mask(h)
        return self.words[h >> np.uint64(70 - self.bits)] & mask == mask


def dictionary_bitmap(dictionary: DataFrame) -> Bitmap:
    """The bitmap of the names of a dictionary (column ``name``): some 24 bits a name, 2 ** BITMAP_MOST_BITS at most.

    One pass over the names; a dictionary that is kept as a table is counted from its files' footers.
    """
    n = dictionary.count()
    bits = int(min(BITMAP_MOST_BITS, max(16, np.ceil(np.log2(max(1, n) * 24)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            latin = pa.array([s.encode("latin-1") for s in batch.column(0).to_pylist()], pa.binary())
            h = hash_strings(latin.cast(pa.large_binary()).view(pa.large_string()))
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(70 - bits)).astype(np.int64)), pa.array(_mask(h).view(np.int64))], names=["word", "bit"])

    skeletons = dictionary.select(skeleton(F.col("name")).alias("s")).where(F.length("s") > 0)
    rows = skeletons.mapInArrow(place, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    if rows.num_rows:
        words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return Bitmap(bits, words)


# A long form of three or four words and its initials in brackets.
_ACRONYMS = (
    re.compile(r"(([a-z])[a-z-]*[ -]([a-z])[a-z-]*[ -]([a-z])[a-z-]*) \((\2-?\3-?\4)\)", re.IGNORECASE | re.ASCII),
    re.compile(r"(([a-z])[a-z-]*[ -]([a-z])[a-z-]*[ -]([a-z])[a-z-]*[ -]([a-z])[a-z-]*) \((\2-?\3-?\4-?\5)\)", re.IGNORECASE | re.ASCII),
)


_SHORT = re.compile(r" \(([a-z](?:-?[a-z]){2,3})\)", re.IGNORECASE | re.ASCII)


def acronyms_of(runs: list[str]) -> dict[str, tuple[str, str]]:
    """key -> (acronym, long form) of a document's text runs; the first one wins, by run, then three before four letters.

    Only the words right before initials in brackets are searched for a long form.
    """
    out: dict[str, tuple[str, str]] = {}
    for run in runs:
        found: tuple[list, list] = ([], [])
        for m in _SHORT.finditer(run):
            letters = len(m[1]) - m[1].count("-")
            begin = m.start()
            for _ in range(letters):
                begin = run.rfind(" ", 0, max(begin, 0))
            if long := _ACRONYMS[letters - 3].search(run, begin + 1, m.end()):
                found[letters - 3].append((long[long.lastindex], long[1]))
        for short, name in (*found[0], *found[1]):
            out.setdefault(key_of(short), (short, name))
    return out


def bracket_partners(b: np.ndarray) -> np.ndarray:
    """For each byte that is a bracket the place of its partner of the same kind, -1 for those without one and all other bytes."""
    out = np.full(len(b), -1, np.int64)
    for opener, closer in zip(BRACKETS[::2], BRACKETS[1::2]):
        at = np.flatnonzero((b == ord(opener)) | (b == ord(closer)))
        opens = b[at] == ord(opener)
        depth = np.cumsum(np.where(opens, 1, -1))
        # An opener and the next closer on the level that it opens belong together.
        level = np.where(opens, depth, depth + 1)
        order = np.argsort(level, kind="stable")
        at, opens, level = at[order], opens[order], level[order]
        pair = np.flatnonzero(opens[:-1] & ~opens[1:] & (level[:-1] == level[1:]))
        out[at[pair]], out[at[pair + 1]] = at[pair + 1], at[pair]
    return out


def trim(b: np.ndarray, start: np.ndarray, stop: np.ndarray, partners: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spans of bytes without punctuation at their ends, and without brackets that close outside or enclose all of them.

    All spans shrink together, a byte at the begin as long as one goes there, else one at the end, until none changes.
    """
    start, stop = start.copy(), stop.copy()
    partners = bracket_partners(b) if partners is None else partners
    open_ = np.flatnonzero((start < stop) & (_ENDS[b[start]] | _ENDS[b[stop]]))
    while len(open_):
        s, e = start[open_], stop[open_]
        other = partners[s]
        around = _OPENERS[b[s]] & (other == e)
        first = _DROP_FIRST[b[s]] | around | (_OPENERS[b[s]] & ((other < 0) | (other > e)))
        last = ~first & (_DROP_LAST[b[e]] | (_CLOSERS[b[e]] & (partners[e] < s)))
        start[open_], stop[open_] = s + first, e - (last | around)
        open_ = open_[(first | last) & (start[open_] < stop[open_])]
    return start, stop


def slices(b: np.ndarray, start: np.ndarray, size: np.ndarray, kind: pa.DataType = pa.large_string()) -> pa.Array:
    """The strings of so many bytes from each start, gathered at once. Unless binary, they must begin and end on borders of characters."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    values = b[np.arange(total) + np.repeat(start - (ends - size), size)] if total else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(values)])


def _decoded(b: np.ndarray, start: np.ndarray, size: np.ndarray, characters: bool) -> pa.Array:
    """As ``slices``; tokens of single bytes may begin and end inside of characters, whose bytes then are replaced."""
    if not characters:
        return slices(b, start, size).cast(pa.string())
    text = b.tobytes()
    return pa.array([text[a : a + n].decode("utf-8", "replace") for a, n in zip(start.tolist(), size.tolist())], pa.string())


CANDIDATES = "doc_id {id}, seg int, i int, j int, start int, stop int, text string, key string"


def token_spans(b: np.ndarray, offsets: np.ndarray, characters: bool = False) -> tuple[np.ndarray, ...]:
    """First byte, last byte, row and run of each token. NUL bytes end a run of a row; windows stay inside of runs."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    nul = b == 0
    ends = np.cumsum(nul & ~np.concatenate([[False], nul[:-1]]))
    before = np.concatenate([[0], ends])[offsets[:-1]]
    if characters:
        at = np.flatnonzero(~nul)
        return at, at, rows[at], ends[at] - before[rows[at]]
    kind = _TOKEN_CLASS[b]
    new = np.ones(len(b), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(b)) - 1
    token = kind[starts] != 1
    starts, stops = starts[token], stops[token]
    rows = rows[starts]
    return starts, stops, rows, ends[starts] - before[rows]


def _unit(rows: np.ndarray, segs: np.ndarray) -> np.ndarray:
    """Rising numbers, the same for the tokens of one run."""
    if not len(rows):
        return rows
    return np.concatenate([[0], np.cumsum((np.diff(rows) != 0) | (np.diff(segs) != 0))])


def tokens(documents: DataFrame, characters: bool = False) -> DataFrame:
    """``doc_id, seg, i, start, stop, token`` of documents (``doc_id, text``): positions in bytes, the last inclusive."""
    kind = documents.select("doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b, offsets = _buffer(batch.column(1))
            starts, stops, rows, segs = token_spans(b, offsets, characters)
            unit = _unit(rows, segs)
            i = np.arange(len(starts)) - np.searchsorted(unit, unit)
            place = -offsets[rows]
            words = _decoded(b, starts, stops - starts + 1, characters)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(segs, pa.int32()), pa.array(i, pa.int32()), pa.array(starts + place, pa.int32()), pa.array(stops + place, pa.int32()), words],
                names=["doc_id", "seg", "i", "start", "stop", "token"],
            )

    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, seg int, i int, start int, stop int, token string"
    )


def byte_tokens(documents: DataFrame) -> DataFrame:
    """``doc_id, i, start, stop, byte`` of documents (``doc_id, text``): every byte as a token, as two hexadecimal digits. A map over the rows: no shuffle."""
    kind = documents.select("doc_id").schema[0].dataType.simpleString()
    digits = pa.array([f"{x:02X}" for x in range(256)], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, offsets = _buffer(batch.column(1))
            rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = pa.array(np.arange(len(b)) - offsets[rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), at, at, at, digits.take(pa.array(b))], names=["doc_id", "i", "start", "stop", "byte"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, i int, start int, stop int, byte string")


def candidate_windows(
    documents: DataFrame, dictionary: DataFrame, max_tokens: int = 15, characters: bool = False, find_acronyms: bool = True, bitmap: Bitmap | None = None
) -> DataFrame:
    """Windows of up to ``max_tokens`` tokens that the dictionary's bitmap lets through.

    ``doc_id, seg, i, j`` (token numbers in the run), ``start, stop`` (bytes in the document, ends trimmed), ``text``
    (the trimmed surface), ``key`` (the canonical key of the window, or of the long form of the acronym it is).
    ``documents`` has ``doc_id, text``; NUL bytes stand for masked markup. A map over the rows: no shuffle.
    """
    session = documents.sparkSession
    shared = session.sparkContext.broadcast(bitmap or dictionary_bitmap(dictionary))
    kind = documents.select("doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _windows(batch, shared.value, max_tokens, characters, find_acronyms)

    return documents.select("doc_id", "text").mapInArrow(run, CANDIDATES.format(id=kind))


def _windows(batch: pa.RecordBatch, known: Bitmap, most: int, characters: bool, find_acronyms: bool) -> pa.RecordBatch:
    b, offsets = _buffer(batch.column(1))
    starts, stops, rows, segs = token_spans(b, offsets, characters)
    unit = _unit(rows, segs)
    n = len(starts)
    keep = _KEEP[b]
    kept = np.concatenate([[0], np.cumsum(keep)])
    up, down = _powers(int(kept[-1]))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((_UPPER[b[keep]] + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    first, last = kept[starts], kept[stops + 1]

    def hashes(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((sums[last[z]] - sums[first[a]]) * down[first[a]])

    short: dict[int, dict[str, tuple[str, str]]] = {}
    marks = np.zeros(0, np.uint64)
    if find_acronyms:
        for row in np.unique(np.searchsorted(offsets, np.flatnonzero(b == 0x28), "right") - 1):
            if found := acronyms_of(b[offsets[row] : offsets[row + 1]].tobytes().decode("latin-1").split("\0")):
                short[int(row)] = found
        names = [a.encode("latin-1") for found in short.values() for a, _ in found.values()]
        if names:
            bare = [bytes(x for x in a if _KEEP[x]) for a in names]
            marks = np.unique(hash_strings(pa.array(bare, pa.large_binary()).view(pa.large_string())))
    a_hits, z_hits = [], []
    for w in range(min(most, n)):
        a = np.arange(n - w)
        a = a[unit[a] == unit[a + w]]
        h = hashes(a, a + w)
        hit = known.has(h) & (last[a + w] > first[a])
        if len(marks):
            hit |= np.isin(h, marks)
        a_hits.append(a[hit])
        z_hits.append(a[hit] + w)
    a = np.concatenate(a_hits) if a_hits else np.zeros(0, np.int64)
    z = np.concatenate(z_hits) if z_hits else np.zeros(0, np.int64)
    start, stop, row = starts[a], stops[z], rows[a]
    base = np.searchsorted(unit, unit[a])
    # A key for each distinct window, of its bytes.
    spans = slices(b, start, stop - start + 1, pa.large_binary()).dictionary_encode()
    keys = pa.array([key_of(x.decode("latin-1")) for x in spans.dictionary.to_pylist()], pa.string()).take(spans.indices)
    if short:
        # Only documents that define acronyms need a look at their windows one by one.
        given = keys.to_pylist()
        for k in np.flatnonzero(np.isin(row, list(short))).tolist():
            if found := short[int(row[k])].get(given[k]):
                given[k] = key_of(found[1])
        keys = pa.array(given, pa.string())
    start, stop = trim(b, start, stop)
    surface = _decoded(b, start, np.maximum(stop - start + 1, 0), characters)
    place = -offsets[row]
    take = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(take), pa.array(segs[a], pa.int32()), pa.array(a - base, pa.int32()), pa.array(z - base, pa.int32()),
            pa.array(start + place, pa.int32()), pa.array(stop + place, pa.int32()), surface, keys,
        ],
        names=["doc_id", "seg", "i", "j", "start", "stop", "text", "key"],
    )
