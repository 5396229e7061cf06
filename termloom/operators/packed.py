"""Several values packed in one field: one row per value, with the place kept.

A batch of fields is looked at as one Arrow string buffer. Masks of quotes and delimiters over its bytes, and the
parity of the quotes before each byte, give the spans of all items of all rows at once; the spans become child
offsets of a list array, which is flattened with its parent ordinals. No Python loop runs over rows or items.

Delimiters are ``, ; | / &``, the full-width comma and semicolon, the ideographic comma and the words in
``WORD_DELIMITERS`` between white space, all outside of quotes. An item of initials with full stops, or a name suffix,
behind a comma belongs to the item before it. A quoted item is one value; a doubled quote inside is one quote.

Defined results: null, empty and blank fields give no rows; empty items aren't counted; a row id may be null or
repeated; a quote that isn't the first character of an item, or has no partner, is plain data (such rows go through
``split_field``, an exact scanner of a single field, since their parity means nothing). Any other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BYTE_DELIMITERS = b",;|/&"
WIDE_DELIMITERS = ("，".encode(), "；".encode(), "、".encode())
WORD_DELIMITERS = (b"and", b"AND")
SUFFIXES = ("Jr", "Jr.", "Sr", "Sr.", "2nd", "3rd", "4th", "II", "III", "IV")
COMMAS = ",，"

_SPACES = " \t\n\r\x0b\x0c\u0085  " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
_WIDE_SPACES = tuple(c.encode() for c in _SPACES if ord(c) >= 128)
_INITIALS = re.compile(r"(?:[^\W\d_]\.[\s-]*)+")
_DELIMITER = re.compile(r"[,;|/&，；、]|(?<![^\s,;|/&，；、])(?:and|AND)(?=\s)")


def split_field(text: str | None) -> list[str]:
    """The items of one field, by a scan from left to right."""
    items: list[str] = []
    text, at, before, items_end, fixed = text or "", 0, "", 0, True  # fixed: the item before can't be continued
    while True:
        while at < len(text) and text[at] in _SPACES:
            at += 1
        item, quoted, end = "", False, None
        if text.startswith('"', at) and (m := re.compile(r'"((?:[^"]|"")*)"\s*').match(text, at)):
            end = _DELIMITER.match(text, m.end())
            if end or m.end() == len(text):
                item, quoted = m[1].replace('""', '"').strip(_SPACES), True
        if not quoted:
            end = _DELIMITER.search(text, at)
            item = text[at : end.start() if end else len(text)].strip(_SPACES)
        if item:
            if not fixed and not quoted and before and before in COMMAS and (item in SUFFIXES or _INITIALS.fullmatch(item)):
                items[-1] += text[items_end:at] + item
            else:
                items.append(item)
            items_end = at + len(item)
        fixed = quoted or fixed and not item
        if not end:
            return items
        before, at = end[0], end.end()


def _at(b: np.ndarray, needle: bytes) -> np.ndarray:
    """Mask of the bytes at which ``needle`` begins."""
    n = len(b) - len(needle) + 1
    hit = np.zeros(len(b), bool)
    if n > 0:
        hit[:n] = b[:n] == needle[0]
        for i, c in enumerate(needle[1:], 1):
            hit[:n] &= b[i : i + n] == c
    return hit


def _spread(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    mask = np.zeros(n, bool)
    for i in range(width):
        mask[starts + i] = True
    return mask


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def split_buffers(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items of all rows: child offsets, offsets and bytes of the values, and a mask of the rows left to ``split_field``.

    ``b`` has the bytes of row ``i`` at ``offsets[i]:offsets[i + 1]``, starting at 0.
    """
    n, rows = len(b), len(offsets) - 1
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    quote = b == 0x22
    count = np.concatenate([[0], np.cumsum(quote)])
    numbered = count[1:] - count[offsets[:-1]][row_of]  # the how-manieth quote of its row, at a quote
    inside = (numbered - quote) % 2 == 1
    inside |= quote & (numbered % 2 == 1)

    space = (b == 0x20) | ((b >= 9) & (b <= 13))
    for wide in _WIDE_SPACES:
        if len(hits := np.flatnonzero(_at(b, wide))):
            space |= _spread(hits, len(wide), n)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first[n] = True
    last = first[1:]  # the byte ends its row
    first = first[:n]

    cut = np.zeros(n, bool)  # a byte of a delimiter
    comma = b == 0x2C
    for c in BYTE_DELIMITERS:
        cut |= b == c
    for wide in WIDE_DELIMITERS:
        if len(hits := np.flatnonzero(_at(b, wide))):
            cut |= _spread(hits, len(wide), n)
            if wide == "，".encode():
                comma |= _spread(hits, len(wide), n)
    gap = space | cut
    before = np.concatenate([[True], gap[:-1]]) | first | np.concatenate([[False], quote[:-1]])
    for word in WORD_DELIMITERS:
        hits = np.flatnonzero(_at(b, word) & before)
        hits = hits[hits + len(word) < n]
        hits = hits[space[hits + len(word)] & (row_of[hits + len(word)] == row_of[hits])]
        # a word right behind a quote isn't one: white space or a delimiter must stand before it
        hits = hits[first[hits] | gap[np.maximum(hits - 1, 0)]]
        cut |= _spread(hits, len(word), n)
    cut &= ~inside

    # Items are the runs between delimiters and row borders, without white space at their ends.
    solid = ~cut & ~(space & ~inside)
    piece = np.cumsum(cut | first) - 1  # the same number: no delimiter and no row border in between
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(rows + 1, np.int64), np.zeros(1, np.int64), b[:0], np.zeros(rows, bool)
    new = np.concatenate([[True], piece[at][1:] != piece[at][:-1]])
    starts = at[new]
    ends = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])] + 1
    owner = row_of[starts]

    # Rows whose quotes aren't all the first and last byte of an item, or doubled in between.
    opened = quote & (numbered % 2 == 1)
    closed = quote & (numbered % 2 == 0)
    good = np.zeros(n, bool)
    good[starts] = True
    good |= np.concatenate([[False], quote[:-1]]) & ~first  # the second of two
    shut = np.zeros(n, bool)
    shut[ends - 1] = True
    shut |= np.concatenate([quote[1:], [False]]) & ~last
    odd = np.zeros(rows, bool)
    odd[row_of[(opened & ~good) | (closed & ~shut)]] = True
    odd |= (count[offsets[1:]] - count[offsets[:-1]]) % 2 == 1
    quoted = b[starts] == 0x22

    # Initials with full stops, or a suffix, behind a comma.
    dot = b == 0x2E
    mark = dot | space | (b == 0x2D)
    head = ((b & 0xC0) != 0x80) & ~mark
    letter = head & ~((b >= 0x30) & (b <= 0x39)) & ((b >= 128) | ((b & 0xDF) >= 0x41) & ((b & 0xDF) <= 0x5A))
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    of = lambda s: s[ends] - s[starts]
    heads, dots, letters = of(sums(head)), of(sums(dot)), of(sums(letter))
    stopped = np.concatenate([(dot & False)[:1], head[:-1] | (((b[:-1] & 0xC0) == 0x80) & ~space[:-1])]) & dot  # a full stop right behind a letter
    initials = (heads == dots) & (dots > 0) & (letters == heads) & (of(sums(stopped)) == dots) & letter[starts]
    length = ends - starts
    for suffix in SUFFIXES:
        raw = suffix.encode()
        candidates = np.flatnonzero(length == len(raw))
        if len(candidates):
            hit = np.ones(len(candidates), bool)
            for i, c in enumerate(raw):
                hit &= b[starts[candidates] + i] == c
            initials[candidates[hit]] = True
    prior = np.maximum(np.maximum.accumulate(np.where(cut, np.arange(n), -1))[starts], 0)
    behind = cut[prior] & comma[prior] & (row_of[prior] == owner)
    same = np.concatenate([[False], owner[1:] == owner[:-1]])
    joined = initials & ~quoted & behind & same & ~np.concatenate([[False], quoted[:-1]])
    keep = ~joined
    group = np.flatnonzero(keep)
    starts, owner, quoted = starts[group], owner[group], quoted[group]
    ends = ends[np.concatenate([group[1:] - 1, [len(joined) - 1]])]

    # Quotes come off, with white space inside of them.
    starts, ends = starts + quoted, ends - quoted
    after = np.minimum.accumulate(np.where(space, n, np.arange(n))[::-1])[::-1]  # the next byte that isn't white space
    until = np.maximum.accumulate(np.where(space, -1, np.arange(n)))
    inner = quoted & (ends > starts)
    starts = np.where(inner, np.minimum(after[np.minimum(starts, n - 1)], ends), starts)
    ends = np.where(inner, np.maximum(until[np.maximum(ends - 1, 0)] + 1, starts), ends)
    full = (ends > starts) & ~odd[owner]
    starts, ends, owner = starts[full], ends[full], owner[full]

    where = _gather(starts, ends - starts)
    kept = ~(quote & (numbered % 2 == 1))[where]  # of a doubled quote, one: the opening quote is number 1, a pair 2 and 3
    sizes = sums(kept)
    value_ends = sizes[np.cumsum(ends - starts)]
    child = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
    return child, np.concatenate([[0], value_ends]), b[where[kept]], odd


def _batch(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    b = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    child, value_offsets, values, odd = split_buffers(b, offsets - offsets[0])
    strings = pa.LargeStringArray.from_buffers(len(value_offsets) - 1, pa.py_buffer(value_offsets.astype(np.int64)), pa.py_buffer(values))
    lists = pa.LargeListArray.from_arrays(pa.array(child, pa.int64()), strings)
    parents = pc.list_parent_indices(lists).to_numpy()
    pos = np.arange(len(parents)) - child[parents] + 1
    items = pc.list_flatten(lists)
    for row in np.flatnonzero(odd):
        more = split_field(texts[int(row)].as_py())
        parents = np.concatenate([parents, np.full(len(more), row)])
        pos = np.concatenate([pos, np.arange(1, len(more) + 1)])
        items = pa.concat_arrays([items, pa.array(more, pa.large_string())])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(parents)), pa.array(pos, pa.int64()), items.cast(pa.string())], names=["id", "pos", "value"])


def split_packed(df: DataFrame, id_column: str, column: str, id_name: str = "row_id", value_name: str = "value") -> DataFrame:
    """``id_name, pos, value_name``: one row per item of ``column``; ``pos`` counts from 1. A map over the rows: no shuffle."""
    kind = df.select(id_column).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch(batch.column(0), batch.column(1)).rename_columns([id_name, "pos", value_name])

    return df.select(id_column, column).mapInArrow(run, f"`{id_name}` {kind}, pos bigint, `{value_name}` string")
