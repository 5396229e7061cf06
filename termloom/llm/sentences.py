"""Sentences of texts in any language and script, by a semi-Markov choice of whole spans.

A TAB or a blank line always ends a sentence, so a text is cut into blocks there. Inside a block the places at which a
sentence may end are found (end marks with the closing quotes, brackets and citation marks behind them; in Thai the
white space between two Thai letters). Dynamic programming then picks the sequence of spans of the highest total
score, over all pairs of places. The score is one of a span as a whole, not a sum over its two borders:

* its length, by the distance of its logarithm from that of usual sentences;
* the word that opens it: one of the closed classes that begin sentences, or one in lower case;
* the word and mark that close it, and what follows: cut-short words, initials, numbers and ellipses go on;
* quotes and brackets: each pair of which it holds one end only is torn, a pair around all of it is not; and an end mark
  inside of brackets ends the span that the brackets enclose, but no span that merely holds them;
* its script: a semicolon ends a span of Greek letters only.

Defined results: positions are in code points, the end is exclusive, and no span begins or ends with white space. Null,
empty and blank texts give no spans. Texts are never cut or capped: blocks with many places are scored by arrays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_END = re.compile(r"\t+|(?:\r\n?|\n)(?:[^\S\t\r\n]*(?:\r\n?|\n))+")

_WIDE = "。！？｡।॥۔؟"  # end marks that need no white space behind them
_CLOSERS = "\"'”’»›」』）)】〕］\\]》〉"
_CITATION = r"(?:\[\d+(?:\s?[,;–-]\s?\d+)*\]|[⁰¹²³⁴-⁹]+)"
#: An end mark (1), with what belongs to it: closers, a French closer behind a space, citation marks.
_END = rf"([.!?{_WIDE}…;;]+)(?:[{_CLOSERS}]|“(?![^\W_])|[  ]»|{_CITATION})*"
_THAI = r"(?<=[ก-๛])[^\S\t]+(?=[ก-๛])"
_PLACE = re.compile(rf"{_END}|{_THAI}")
_PAIRS = re.compile(r"[(\[{（［【「『《〈«‹“„”)\]}）］】」』》〉»›\"]")
#: Up to the last character that a word begins behind.
_BEFORE_WORD = re.compile(r"(?s).*[\s(\[{（「『“„«\"‘—–,;:：]")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_NEXT = re.compile(r"[\"'“„«‘(\[（「『《¿¡  ]*")

OPENING = dict(zip("([{（［【「『《〈«‹", ")]}）］】」』》〉»›"))

#: Words before a full stop that are cut short and go on: titles, references, units. Fixed list, lower case.
ABBREVIATIONS = frozenset(
    """
    dr dra prof mr mrs ms mme mlle st ste sr sra srs no nos nr fig figs eq eqs ref refs sect sec art app vol vols pp p pg
    cf vs viz i.e e.g approx aprox ca env max min suppl dept hosp sq ver resp subsp spp sp var cat pers avg incl excl ed eds
    tab tabs abb s vgl bzw z b d h u a i r o.g sog bspw usw insb evtl ggf u.a z.b d.h i.d.r c.-à-d p.ex ex éq pr m mm
    pág págs núm p.ej ej aprox lic ing sta sto ntra
    jan feb mar apr jun jul aug sep sept oct nov dec
    г гг т е рис табл см напр им стр гл ин-т др проф акад ул п т.е т.к
    βλ σελ εικ πίν κ π.χ δηλ δρ αρ κεφ βλέπε κ.λπ
    د أ ص ج डॉ प्रो मि.ग्रा कि.ग्रा श्री ดร พ.ศ ค.ศ ศ รศ ผศ
    assoc asst inc ltd
    comm seq al coll cols a.m p.m u.s u.k e.u etc uu ee ff bd aufl hrsg jh chr
    """.split()
)
#: Of these, the words that can also be the last of a sentence.
MAY_END = frozenset("etc a.m p.m u.s u.k e.u al cols coll ltd inc seq comm uu ff др m т.д т.п usw κ.λπ д п h г гг jr avg max min".split())
#: Words of closed classes (articles, pronouns, question words, prepositions, conjunctions) that, with a capital, open sentences.
STARTERS = frozenset(
    """
    the a an in we it this these those that they there here no not what why how when where who which is are was were does do did has have
    for at by on once with without after before under since as if while although moreover however thus such most both each some all our
    der die das den dem ein eine einer wir es er sie nach am im bei laut ohne mit für was wie warum wer ist sind hat
    la el los las lo un una en por para con sin qué cuál cómo quién es son se le les une il elle ils nous vous dans pour avec sans est sont ce cet cette ces quel quelle
    по в на мы он она это эти без при что как кто для и но
    η ο το οι τα τη στην στο στη κατά για γιατί με
    """.split()
)
#: Words before a number with a full stop that then is an ordinal.
ORDINAL_AFTER = frozenset("am vom zum ab bis der dem den die das seit im nach".split())
_JA_GOES_ON = re.compile(r"(?:と|って|という|の|は|が|を|に|で|も)")

#: Scores: of a plain end mark, of an opening word of a closed class or in lower case, of a torn pair.
WORD_GAIN, OPENS, OPENS_LOW, TORN = 3.0, 4.5, -2.0, 12.0
#: Middle and spread of the logarithm of the length of sentences, fitted to the 206,481 spans of the titles and texts of sf0.1 and
#: check_s, and what a spread of distance costs.
LENGTH_MIDDLE, LENGTH_SPREAD, LENGTH_COST = 4.05, 0.52, 0.25
#: A span is Greek from this share of its letters, and from three.
GREEK_SHARE = 0.3


def _pairs(text: str, begin: int, end: int) -> dict[int, int]:
    """The place of the opening mark by that of its closing mark. Marks without a partner are left out."""
    pairs: dict[int, int] = {}
    open_: list[tuple[str, int]] = []  # the closers that are waited for, and the place
    for m in _PAIRS.finditer(text, begin, end):
        c, at = m[0], m.start()
        if c in OPENING:
            open_.append((OPENING[c], at))
            continue
        if c == "„":
            open_.append(("“”\"", at))
            continue
        waits = next((k for k in range(len(open_) - 1, -1, -1) if c in open_[k][0]), None)
        if waits is None:
            if c == '"':
                left = text[at - 1] if at > begin else " "
                right = text[at + 1] if at + 1 < end else " "
                if not right.isspace() and (left.isspace() or left in "([{—–-" or not left.isascii()):
                    open_.append(('"', at))
            elif c == "“":
                open_.append(("”", at))
            continue
        pairs[at] = open_[waits][1]
        del open_[waits:]  # what was opened inside and not closed has no partner
    return pairs


def _depths(pairs: dict[int, int], places: list[int]) -> tuple[list[int], list[int]]:
    """How many pairs of quotes or brackets are open at each place, and at least between the place before and it."""
    if not pairs:
        return [0] * len(places), [0] * len(places)
    changes = sorted([(a, 1) for a in pairs.values()] + [(b, -1) for b in pairs])
    out, least, depth, k = [], [], 0, 0
    for p in places:
        low = depth
        while k < len(changes) and changes[k][0] < p:
            depth += changes[k][1]
            low = min(low, depth)
            k += 1
        out.append(depth)
        least.append(low)
    return out, least


def _close(text: str, mark: int, behind: int, end: int, block_end: int, word_at: int, from_: int) -> float | None:
    """How well a sentence ends with the mark at ``mark:behind``, its place at ``end``; None: it can't.

    ``word_at`` is where the word before the mark begins, ``from_`` a place at or before the begin of the word before that.
    """
    marks = text[mark:behind]
    last = marks[-1]
    follow = end
    while follow < block_end and text[follow].isspace():
        follow += 1
    if follow >= block_end:
        return None  # the end of the block is a place anyway
    gap = follow > end
    wide = any(c in _WIDE for c in marks)
    closed = any(c not in "0123456789[],;–- " and not c.isspace() for c in text[behind:end])
    m = _NEXT.match(text, follow, block_end)
    first = text[m.end()] if m.end() < block_end else text[follow]
    lower = first.islower()
    if set(marks) <= {";", ";"}:
        # Of a Greek span only, which is told by the span.
        if not gap and not closed:
            return None
        return WORD_GAIN + (1 if first.isupper() else -2 if lower and closed else 0)
    if "…" in marks or marks.endswith(".."):
        if set(marks) <= {"…"} and not gap:
            return None  # the dash-like ellipsis of East Asian texts
        spaced = mark > 0 and text[mark - 1].isspace()
        return -6.0 if text[follow].islower() or spaced and not first.isupper() else 0.5 if spaced else WORD_GAIN
    if text[follow] in ",;:.)]}、，；：،؛」』”»–—" and not (text[follow] in "–—" and wide):
        return -6.0
    if wide:
        if closed and not gap and _JA_GOES_ON.match(text, follow) and text[end - 1] in "」』”）":
            return -6.0 if text[end - 1] in "」』" else 1.0
        if closed and gap and text[follow].islower() and text[end - 1] not in ")）]":
            return -5.0
        return WORD_GAIN + 1
    word = text[word_at:mark]
    if not gap:
        # Without white space behind it, an ASCII mark ends nothing but before a letter of a script without spaces.
        if first >= "⺀":
            return 1.0 if last in "!?" or closed else -2.0
        if not first.isupper() or len(marks) > 1 or follow + 1 >= block_end or not (text[follow + 1].islower() or text[follow + 1].isspace()):
            return None
        if last == "." and not closed and (len(word) < 2 or "." in word or word.lower() in ABBREVIATIONS or not word[-1].isalnum() and word[-1] not in "%)]"):
            return None
        return 2.0
    if last in "!?":
        return -3.0 if lower and closed and text[end - 1] not in ")]" else WORD_GAIN + 1
    word = word.rstrip(".")
    key = word.lower().lstrip("'’-")
    known = key in ABBREVIATIONS or key.rpartition("（")[2] in ABBREVIATIONS
    single = len(key) == 1 and key.isalpha()
    if word and "ก" <= word[-1] <= "๛":
        return -8.0  # Thai has no full stop but behind words cut short
    if closed:
        # Behind a closing quote or bracket the full stop inside is an end mark, unless the sentence plainly goes on.
        if text[end - 1] in ")]）" and (known or single or lower or text[follow] == "("):
            return -6.0
        return -3.0 if text[follow].islower() and text[end - 1] not in "0123456789⁰¹²³⁴⁵⁶⁷⁸⁹]" else WORD_GAIN
    if known or single:
        return -8.0 if lower or key not in MAY_END else 0.6 if key == "etc" else -3.0
    if key.isdigit() and len(key) <= 3:
        before = text[from_:word_at].rstrip()
        m = _BEFORE_WORD.match(before)
        if before[m.end() if m else 0 :].lower() in ORDINAL_AFTER:
            return -4.0
    return WORD_GAIN


class _Places:
    """The places of a block at which a sentence may end, as columns. Place 0 is the begin of the block, the last its end.

    ``ends`` and ``starts`` are where a span ends there and where the next begins, ``closes`` and ``opens`` their scores, ``whole``
    the bracket that opens what closes there (-1: none), ``asks`` whether the span must be Greek.
    """

    def __init__(self, text: str, begin: int, end: int) -> None:
        self.text, self.ends, self.starts, self.closes, self.opens = text, [begin], [begin], [0.0], [0.0]
        self.whole, self.asks, self.marks = [-1], [False], [begin]
        self.pairs = _pairs(text, begin, end)
        word_at, from_, upto = begin, begin, begin
        greek = _GREEK.search(text, begin, end) is not None
        for m in _PLACE.finditer(text, begin, end):
            if m[1] is None:
                self._add(m.start(), m.end(), end, WORD_GAIN + 1)
                continue
            mark, at = m.start(1), m.end()
            asks = text[mark] in ";;"
            if asks and not greek:
                continue
            if x := _BEFORE_WORD.match(text, upto, mark):
                word_at, from_ = x.end(), word_at
            upto = mark
            close = _close(text, mark, m.end(1), at, end, word_at, from_)
            if close is None:
                continue
            start = at
            while start < end and text[start].isspace():
                start += 1
            # Brackets around a whole sentence close it whatever stands before them.
            inside = self.pairs.get(at - 1, -1) if not asks and start > at and text[at - 1] in ")]）" and m.end(1) < at else -1
            self._add(at, start, end, close, inside, asks, mark)
        if len(self.ends) > 1:
            self._add(end, end, end, 0.0)

    def _add(self, at: int, start: int, end: int, close: float, whole: int = -1, asks: bool = False, mark: int = -1) -> None:
        self.ends.append(at)
        self.starts.append(start)
        self.closes.append(close)
        m = _NEXT.match(self.text, start, end)
        first = _FIRST_WORD.match(self.text, m.end(), end)
        low = bool(first) and first[0][0].islower()
        self.opens.append(OPENS_LOW if low else OPENS if first and first[0].lower() in STARTERS else 0.0)
        self.whole.append(whole)
        self.asks.append(asks)
        self.marks.append(mark if asks else at)

    def greek(self) -> tuple[list[int], list[int]]:
        """Up to each place's mark and from each place's start, as one list each: Greek letters, letters."""
        text, begin = self.text, self.ends[0]
        flags = np.array([(c.isalpha(), "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿") for c in text[begin : self.ends[-1]]], np.int64).reshape(-1, 2)
        sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(flags, 0)])
        return sums[np.array(self.marks) - begin], sums[np.array(self.starts) - begin]


_FIRST_WORD = re.compile(r"[^\W\d_]+")


def _length_cost(n: int) -> float:
    return LENGTH_COST / LENGTH_SPREAD * abs(math.log(max(1, n)) - LENGTH_MIDDLE)


_COSTS = [_length_cost(n) for n in range(4096)]


def _best(p: _Places) -> list[int]:
    """The places at which the spans of the best sequence end."""
    n = len(p.ends)
    depth, least = _depths(p.pairs, p.ends)
    marks, starts_ = p.greek() if any(p.asks) else (None, None)
    best, come = [0.0] * n, [0] * n
    if n <= 65:
        for j in range(1, n):
            top, arg, end, dj, low, whole = -1e18, 0, p.ends[j], depth[j], least[j], p.whole[j]
            for i in range(j - 1, -1, -1):
                start = p.starts[i]
                s = best[i] + p.opens[i] + (WORD_GAIN if whole == start else p.closes[j])
                if dj or depth[i]:
                    s -= TORN * (dj + depth[i] - 2 * low)
                size = end - start
                s -= _COSTS[size] if size < 4096 else _length_cost(size)
                if p.asks[j]:
                    letters, greek = marks[j] - starts_[i]
                    if greek < 3 or greek < GREEK_SHARE * letters:
                        s = -1e17
                if s > top:
                    top, arg = s, i
                if least[i] < low:
                    low = least[i]
            best[j], come[j] = top, arg
    else:
        ends, starts, d, opens, b = (np.array(x, float) for x in (p.ends, p.starts, depth, p.opens, best))
        low = np.array(least)
        for j in range(1, n):
            lowest = np.minimum.accumulate(low[j:0:-1])[::-1]  # between place i and place j
            s = b[:j] + opens[:j] + np.where(starts[:j] == p.whole[j], WORD_GAIN, p.closes[j]) - TORN * (d[j] + d[:j] - 2 * lowest)
            s -= LENGTH_COST / LENGTH_SPREAD * np.abs(np.log(np.maximum(1, ends[j] - starts[:j])) - LENGTH_MIDDLE)
            if p.asks[j]:
                known = marks[j] - starts_[:j]
                s = np.where((known[:, 1] < 3) | (known[:, 1] < GREEK_SHARE * known[:, 0]), -1e17, s)
            i = j - 1 - int(np.argmax(s[::-1]))
            b[j], come[j] = s[i], i
    out, j = [], n - 1
    while j > 0:
        out.append(j)
        j = come[j]
    return out[::-1]


def _block(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    places = _Places(text, begin, end)
    if len(places.ends) == 1:
        yield begin, end
        return
    at = begin
    for j in _best(places):
        yield at, places.ends[j]
        at = places.starts[j]


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(begin, end) of each sentence of a text."""
    if not text or text.isspace():
        return []
    out, at = [], 0
    cuts = [*((m.start(), m.end()) for m in BLOCK_END.finditer(text)), (len(text), len(text))]
    for stop, after in cuts:
        a, b = at, stop
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            for x, y in _block(text, a, b):
                while y > x and text[y - 1].isspace():
                    y -= 1
                if x < y:
                    out.append((x, y))
        at = after
    return out


def split_sentences(df: DataFrame, id_column: str, columns: tuple[str, ...]) -> DataFrame:
    """``<id>, field, begin_pos, end_pos``: one row per sentence of each of ``columns``. A map over the rows: no shuffle."""
    kind = df.select(id_column).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(columns, 1):
                rows, begins, ends = [], [], []
                for row, text in enumerate(batch.column(k).to_pylist()):
                    for a, b in sentence_spans(text):
                        rows.append(row)
                        begins.append(a)
                        ends.append(b)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([name] * len(rows), pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())],
                    names=[id_column, "field", "begin_pos", "end_pos"],
                )

    return df.select(id_column, *columns).mapInArrow(run, f"`{id_column}` {kind}, field string, begin_pos bigint, end_pos bigint")
