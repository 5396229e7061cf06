"""Pages made of repeated keywords, lists of links or product tags instead of sentences, by their rank-frequency curves.

The words of each page are counted, ranked by SQL windows, and a line is fitted to the logarithms of rank and
frequency. The words on a large share of a language's pages are its prose words; pages of repeated words have no say in
that, and a site has a small one however many pages it has. A page's divergence is what the prose words of a language
leave unexplained of it, in words, and what links take of its characters. Slope, residual, variety and divergence are
held against pages of the same language and of comparable length.

A page is a case if its divergence alone is extreme, or if it is high and the curve is extreme too. Nothing else
decides. A page is held against the language that explains most of it, as labels may be wrong: any language with
``LEAST_LANGUAGE`` of all pages, or the language of its own label. Where the label names a language of too few pages to
know its prose, missing prose words say nothing: such a page is a case by an extreme curve or by its links only.

Defined results: null, empty and blank texts are no cases, nor are texts of under ``LEAST_WORDS`` words that aren't
mostly links; a null id can't be reported and is left out; a null language counts as ``und`` and is held against
all known languages; repeated ids are judged by row and reported once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.bpe import text_slices
from termloom.sources.staging import checkpointed

#: A word on this share of a language's pages is one of its prose words. A page of w different words can hold at most w
#: of them, so there are at most w / PROSE_SHARE for a language, w being the mean over its pages.
PROSE_SHARE = 0.15
#: The prose words of languages from this share of all pages are a table in memory (at most 1 / LEAST_LANGUAGE of them), which any
#: page is held against. Those of all others are joined with the words of the pages that bear their label.
LEAST_LANGUAGE = 0.0005
#: Fewer pages say nothing on the prose of a language.
LEAST_PAGES = 10
#: The label of pages without one. It names no language, so it has no prose words.
UNKNOWN = "und"
#: What counts as prose is voted on by the pages of a language. A word that is this share of a page (three times at least) gets no
#: vote of it; a page that consists of such words by EXTREME_MOST, or has under LEAST_VARIETY x sqrt(words) different words, doesn't vote.
EXTREME, EXTREME_MOST, LEAST_VARIETY = 0.12, 0.25, 1.5
#: All pages of a site together have this share of the votes of a language at most (a page's vote at least), in units of VOTE a page.
SITE_MOST, VOTE = 0.01, 1000
#: A word of a page is explained by prose up to once and this many times its share in the prose of the language.
EXPLAINED = 3.0
#: Distances from the norm at which a curve is extreme: of the slope, of the logarithms of residual and variety.
SLOPE_GAP, RESIDUAL_GAP, VARIETY_GAP = 0.35, 0.6, 0.7
#: A page is a case if less than this of it is explained, as a share of what is of usual prose; with an extreme curve, or with none known.
EXPLAINED_LEAST, EXPLAINED_EXTREME = 0.36, 0.52
#: Without a known language: how many times the gaps a curve must be away, or the share of characters in links.
FAR, LINKED = 1.5, 0.4
#: Fewer words can't be said over and over, and fewer than CURVE_WORDS make no curve that an extreme can be told of.
LEAST_WORDS, CURVE_WORDS = 8, 24

#: Scripts without spaces, in which pairs of characters stand for words: Thai, Han, Hiragana and Katakana, as ranges.
_DENSE = "ก-ฺเ-๛⺀-⿕々〇〡-〩〸-〻ぁ-ゟァ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-龎ｦ-ﾝ𠀀-𲎯"
#: Addresses, link tags and hash tags; and addresses that hide their dots. Each with marks without which it isn't in a text, so that
#: most texts aren't searched.
_LINK = r"(?:https?://|www\.)[^\s<>\"')\]]*|<a\s[^>]*>|</a>|#[\p{L}\p{N}_][\p{L}\p{M}\p{N}_-]*", ("http", "www.", "<a", "</a>", "#")
_DOTTED = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]+ ?(?:\[\.\]|\(dot\)| dot )\s?[\p{L}\p{N}_]+", ("[.]", "(dot)", " dot ")


_WORD, _PAIRED = 1, 2
#: Bytes of text whose words are found at once; the masks take some tens of times as much memory.
SLICE = 1 << 21


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point: of a word, of a script taken by pairs, or neither."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        if unicodedata.category(chr(i))[0] in "LMN":
            out[i] = _WORD
    for m in re.finditer(r"(.)-(.)|.", _DENSE):
        a, b = (m[1], m[2]) if m[1] else (m[0], m[0])
        span = out[ord(a) : ord(b) + 1]
        span[span > 0] = _PAIRED
    return out


def words_of_batch(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of a batch of lower-case texts, found by masks over its code points.

    Distinct words, and for each occurrence its number and the row it is in. Words are runs of letters, marks and
    digits; in scripts without spaces all pairs of neighbours.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    total = int(offsets[-1] - offsets[0])
    if not total:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = texts.buffers()[2].slice(int(offsets[0]), total)
    offsets = offsets - offsets[0]
    b = np.frombuffer(data, np.uint8)
    kind = _classes()[np.frombuffer(data.to_pybytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    place = np.flatnonzero((b & 0xC0) != 0x80)
    row = np.searchsorted(offsets, place, "right") - 1
    place = np.append(place, total)
    new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    after = np.append(first[1:], len(kind))
    words = kind[first] == _WORD
    pairs = np.flatnonzero((kind[:-1] == _PAIRED) & ~new[1:])
    begin = np.concatenate([place[first[words]], place[pairs]])
    end = np.concatenate([place[after[words]], place[pairs + 2]])
    rows = np.concatenate([row[first[words]], row[pairs]])
    size = end - begin
    ends = np.cumsum(size)
    if not len(ends):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = b[np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)]
    strings = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(values)).dictionary_encode()
    return strings.dictionary, strings.indices.to_numpy().astype(np.int64), rows


def _without(text: Column, pattern: str, marks: tuple[str, ...]) -> Column:
    marked = reduce(Column.__or__, (F.contains(text, F.lit(mark)) for mark in marks))
    return F.when(marked, F.regexp_replace(text, pattern, " ")).otherwise(text)


def _plain(pages: DataFrame, *more: str) -> DataFrame:
    """``lang``, the share of the text's characters in links, and the text in lower case without them."""
    known = pages.select(*more, "lang", F.length("text").alias("size"), _without(F.col("text"), *_LINK).alias("text"))
    known = known.select(*more, "lang", "size", _without(F.col("text"), *_DOTTED).alias("text"))
    links = (F.col("size") - F.length("text")) / F.greatest("size", F.lit(1))
    return known.select(*more, "lang", links.alias("links"), F.lower("text").alias("text"))


class _Prose:
    """The prose words of many languages: for each word the languages that have it, with their shares."""

    def __init__(self, shares: dict[str, dict[str, float]]) -> None:
        self.langs = list(shares)
        self.number = {lang: i for i, lang in enumerate(self.langs)}
        known: dict[str, list[tuple[int, float]]] = {}
        for i, lang in enumerate(self.langs):
            for word, share in shares[lang].items():
                known.setdefault(word, []).append((i, share))
        self.place = {word: i for i, word in enumerate(known)}
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in known.values()])]).astype(np.int64)
        self.lang = np.array([i for x in known.values() for i, _ in x], np.int64)
        self.share = np.array([s for x in known.values() for _, s in x], np.float64)

    def best(self, row: np.ndarray, word: np.ndarray, k: np.ndarray, total: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the language that explains most of it (the label's, if equal; -1 for none), and the share of each
        of the entries (row, word, k) in that language, not a number where it isn't one of its words."""
        share = np.full(len(row), np.nan)
        best = np.full(len(total), -1, np.int64)
        known = np.flatnonzero(word >= 0)
        sizes = self.first[word[known] + 1] - self.first[word[known]]
        entry = np.repeat(known, sizes)
        if not len(entry):
            return best, share
        at = np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[word[known]], sizes)
        lang, s = self.lang[at], self.share[at]
        explained = np.minimum(k[entry], 1 + EXPLAINED * s * total[row[entry]])
        key, inverse = np.unique(row[entry] * len(self.langs) + lang, return_inverse=True)
        sums = np.bincount(inverse, explained)
        of_row, of_lang = key // len(self.langs), key % len(self.langs)
        order = np.lexsort((of_lang == label[of_row], sums, of_row))
        last = np.flatnonzero(np.diff(of_row[order], append=-1) != 0)
        best[of_row[order][last]] = of_lang[order][last]
        own = lang == best[row[entry]]
        share[entry[own]] = s[own]
        return best, share


ENTRIES = "doc_id {id}, row bigint, label string, lang string, links double, entries array<struct<k:bigint,share:double,n:int>>"


def page_entries(pages: DataFrame, shares: dict[str, dict[str, float]]) -> DataFrame:
    """``doc_id, row, label, lang, links, entries``: how often the words of each page (``doc_id, row, lang, text``) are there, without the words.

    ``lang`` is the language of ``shares`` that explains most of the page, null if none explains any of it. An entry is
    (k, share, n): n words that are there k times; a prose word is an entry of its own with its share in the language, all
    other words of a frequency are one entry with a null share. A page of links only has one entry of one word.
    """
    kind = pages.select("doc_id").schema[0].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prose = _Prose(shared.value)
        names = pa.array(prose.langs, pa.string())
        for batch in (part for whole in batches for part in text_slices(whole, SLICE)):
            words, which, rows = words_of_batch(batch.column(4))
            place = np.fromiter((prose.place.get(w, -1) for w in words.to_pylist()), np.int64, len(words))
            label = np.fromiter((prose.number.get(x, -1) for x in batch.column(2).to_pylist()), np.int64, batch.num_rows)
            both, k = np.unique(rows << 32 | which, return_counts=True)
            row = both >> 32
            total = np.bincount(rows, minlength=batch.num_rows)
            best, share = prose.best(row, place[both & 0xFFFFFFFF] if len(place) else np.zeros(0, np.int64), k, total, label)
            plain = np.isnan(share)
            bare = np.flatnonzero((total == 0) & (batch.column(3).to_numpy() > 0))
            rest, n = np.unique(row[plain] << 32 | k[plain], return_counts=True)
            row = np.concatenate([row[~plain], rest >> 32, bare])
            order = np.argsort(row, kind="stable")
            columns = (
                np.concatenate([k[~plain], rest & 0xFFFFFFFF, np.ones(len(bare), np.int64)]).astype(np.int64),
                np.concatenate([share[~plain], np.full(len(rest) + len(bare), np.nan)]),
                np.concatenate([np.ones(int((~plain).sum()), np.int64), n, np.ones(len(bare), np.int64)]).astype(np.int32),
            )
            entry = pa.StructArray.from_arrays([pa.array(c[order], from_pandas=True) for c in columns], names=["k", "share", "n"])
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            found = names.take(pa.array(np.where(best < 0, 0, best), mask=best < 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), found, batch.column(3), pa.ListArray.from_arrays(pa.array(at), entry)], names=["doc_id", "row", "label", "lang", "links", "entries"]
            )

    return _plain(pages, "doc_id", "row").mapInArrow(run, ENTRIES.format(id=kind))


def page_words(pages: DataFrame) -> DataFrame:
    """``row, doc_id, lang, word, k, links``: how often each word is on each page (``row, doc_id, lang, text``)."""
    kind = pages.select("doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, SLICE)):
            words, which, rows = words_of_batch(batch.column(4))
            both, k = np.unique(rows << 32 | which, return_counts=True)
            row = pa.array(both >> 32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(row) for i in range(3)), words.take(pa.array(both & 0xFFFFFFFF)).cast(pa.string()), pa.array(k.astype(np.int64)), batch.column(3).take(row)],
                names=["row", "doc_id", "lang", "word", "k", "links"],
            )

    return _plain(pages, "row", "doc_id").mapInArrow(run, f"row bigint, doc_id {kind}, lang string, word string, k bigint, links double")


def joined_entries(pages: DataFrame, prose: DataFrame) -> DataFrame:
    """As ``page_entries``, with the language of the label only, by a join of the words of pages with the prose words of any number of languages."""
    words = page_words(pages.join(prose.select("lang").distinct(), "lang", "left_semi")).join(prose, ["lang", "word"], "left")
    entries = words.groupBy("row", "doc_id", "lang").agg(F.first("links").alias("links"), F.collect_list(F.struct("k", "share", F.lit(1).alias("n"))).alias("entries"))
    return entries.select("doc_id", "row", F.col("lang").alias("label"), "lang", "links", "entries")


def voters(pages: DataFrame) -> DataFrame:
    """``pages`` with ``vote``, the weight of a page's words: less for the pages of a site with a large share of a language, if there is a ``site``."""
    if "site" not in pages.columns:
        return pages.withColumn("vote", F.lit(VOTE))
    sizes = pages.groupBy("lang").agg(F.count("*").alias("lang_pages"))
    sites = pages.where("site IS NOT NULL").groupBy("lang", "site").agg(F.count("*").alias("n")).join(sizes, "lang")
    most = F.greatest(F.lit(1.0), F.col("lang_pages") * SITE_MOST)
    # At most 1 / SITE_MOST sites of a language, however many pages: broadcast, so that texts needn't move.
    hot = sites.where(F.col("n") > most).select("lang", "site", F.greatest(F.lit(1), F.round(most / F.col("n") * VOTE).cast("int")).alias("vote"))
    return pages.join(F.broadcast(hot), ["lang", "site"], "left").withColumn("vote", F.coalesce("vote", F.lit(VOTE)))


def language_words(pages: DataFrame) -> DataFrame:
    """``lang, word, raw, pages, k``: on how many voting pages of a language a word is, with their votes, and how often it is there by votes.

    ``pages`` has ``vote, lang, text``. The null word is on each voting page. Added up in each batch first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, SLICE)):
            words, which, rows = words_of_batch(batch.column(3))
            langs = batch.column(1).dictionary_encode()
            of_row = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            vote = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            both, k = np.unique(rows << 32 | which, return_counts=True)
            row, word = both >> 32, both & 0xFFFFFFFF
            total = np.bincount(rows, minlength=batch.num_rows)
            extreme = (k >= 3) & (k >= EXTREME * total[row])
            votes = (np.bincount(row[extreme], k[extreme], batch.num_rows) <= EXTREME_MOST * total) & (np.bincount(row, minlength=batch.num_rows) >= LEAST_VARIETY * np.sqrt(total)) & (total > 0)
            counted = votes[row] & ~extreme
            voting = np.flatnonzero(votes)
            # The null word is the one behind all words.
            row = np.concatenate([row[counted], voting])
            word = np.concatenate([word[counted], np.full(len(voting), len(words))])
            k = np.concatenate([k[counted], np.zeros(len(voting), np.int64)])
            key, at, raw = np.unique(of_row[row] << 32 | word, return_inverse=True, return_counts=True)
            total_of = lambda x: pa.array(np.bincount(at, x, len(key)).astype(np.int64))
            strings = pa.concat_arrays([words.cast(pa.string()), pa.nulls(1, pa.string())])
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(key >> 32)), strings.take(pa.array(key & 0xFFFFFFFF)), pa.array(raw.astype(np.int64)), total_of(vote[row]), total_of(k * vote[row])],
                names=["lang", "word", "raw", "pages", "k"],
            )

    parts = _plain(pages, "vote").mapInArrow(run, "lang string, word string, raw bigint, pages bigint, k bigint")
    return parts.groupBy("lang", "word").agg(*(F.sum(c).alias(c) for c in ("raw", "pages", "k")))


def prose_words(words: DataFrame, languages: DataFrame) -> DataFrame:
    """``lang, large, word, share``: the prose words of each language with their share of all its prose words."""
    words = checkpointed(words.where("raw >= 3"))  # used twice
    votes = words.where(F.col("word").isNull() & (F.col("raw") >= LEAST_PAGES)).select("lang", F.col("pages").alias("votes"))
    common = words.join(languages, "lang").join(votes, "lang").where((F.col("pages") >= F.col("votes") * PROSE_SHARE) & ~F.col("word").rlike(r"^\p{N}+$"))
    return common.select("lang", "large", "word", (F.col("k") / F.sum("k").over(Window.partitionBy("lang"))).alias("share"))


def language_sizes(pages: DataFrame) -> DataFrame:
    """``lang, lang_pages, large`` of the languages that have prose words."""
    total = F.sum("lang_pages").over(Window.partitionBy(F.lit(1)))  # as many rows as languages
    sizes = pages.groupBy("lang").agg(F.count("*").alias("lang_pages")).withColumn("large", F.col("lang_pages") >= total * LEAST_LANGUAGE)
    return sizes.where((F.col("lang_pages") >= LEAST_PAGES) & (F.col("lang") != UNKNOWN))


def curves(entries: DataFrame) -> DataFrame:
    """From ``page_entries``: ``doc_id, row, label, lang, links, words, bin, slope, residual, variety, prose``: the rank-frequency
    line of each page, its logarithms of residual and variety, and ``prose``, the share of words that its language explains.
    """
    by_page = Window.partitionBy("doc_id", "page")
    # Pages are moved whole and taken apart behind the shuffle: the windows need no other.
    # Rows of one id are told apart here; the number is used in this stage only.
    known = entries.repartition("doc_id").withColumn("page", F.monotonically_increasing_id())
    keys = ("doc_id", "page", "row", "label", "lang", "links")
    known = known.select(*keys, F.inline("entries"))
    known = known.select(*keys, "k", "share", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    ranked = (
        known.withColumn("rank", F.row_number().over(by_page.orderBy(F.desc("k"), "share")))
        .withColumn("total", F.sum("k").over(by_page))
        .withColumn("explained", F.when(F.col("share").isNotNull(), F.least(F.col("k").cast("double"), 1 + EXPLAINED * F.col("share") * F.col("total"))).otherwise(0.0))
    )
    x, y = F.log(F.col("rank").cast("double")), F.log(F.col("k").cast("double"))
    # Ranks that share a frequency count by their words: the line is fitted to the head, where words repeat.
    w = F.sqrt("k")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"), F.sum(w * y * y).alias("wyy"),
        F.sum("k").alias("words"), (F.sum("explained") / F.sum("k")).alias("prose"), F.log(F.count("*") / F.sum("k") + 0.02).alias("variety"),
    )
    sxx, sxy, syy = (F.col(a) - F.col(b) * F.col(c) / F.col("w") for a, b, c in (("wxx", "wx", "wx"), ("wxy", "wx", "wy"), ("wyy", "wy", "wy")))
    slope = F.when(sxx > 1e-9, -sxy / sxx).otherwise(0.0)
    residual = F.sqrt(F.greatest(F.lit(0.0), (syy - F.when(sxx > 1e-9, sxy * sxy / sxx).otherwise(0.0)) / F.col("w")))
    size = F.floor(F.log2(F.col("words").cast("double"))).cast("int")
    return sums.select("doc_id", "row", "label", "lang", "links", "words", size.alias("bin"), slope.alias("slope"), F.log(residual + 0.05).alias("residual"), "variety", "prose")


def _away(norm: str) -> Column:
    """How many times its gap a curve is away from a norm, in that of slope, residual and variety that is farthest. Many different words are not extreme."""
    gap = lambda c: F.col(c) - F.col(norm)[c]
    return F.greatest(F.abs(gap("slope")) / SLOPE_GAP, F.abs(gap("residual")) / RESIDUAL_GAP, -gap("variety") / VARIETY_GAP)


def departures(lines: DataFrame) -> DataFrame:
    """``lines`` with ``explained``, the share of a page that prose explains against what it explains of usual pages, and ``away``.

    Prose hardly depends on the length, so its norm is an upper quantile over the pages of a language, which stays one
    of prose until most of them are stuffed, and half that of all languages at least. A curve is held against the middle of
    its (language, length) cell and against that of all pages of its length, and is as far away as from the farther
    one: a cell that stuffing fills can't hide it. Norms are a few rows, made of all pages.
    """
    upper, middle = (lambda c: F.percentile_approx(c, 0.7, 1000)), (lambda c: F.percentile_approx(c, 0.5, 1000))
    curve = ("slope", "residual", "variety")
    norms = lambda *keys: lines.where("lang IS NOT NULL").groupBy(*keys).agg(*(middle(c).alias(c) for c in curve))
    cell = norms("lang", "bin").select("lang", "bin", F.struct(*curve).alias("cell"))
    length = norms("bin").select("bin", F.struct(*curve).alias("length"))
    usual = lines.where("lang IS NOT NULL").groupBy("lang").agg(upper("prose").alias("usual"))
    everything = Window.partitionBy(F.lit(1))  # as many rows as languages
    usual = usual.withColumn("usual", F.greatest("usual", F.percentile_approx("usual", 0.5, 1000).over(everything) / 2))
    held = lines.join(length, "bin", "left").join(cell, ["lang", "bin"], "left").join(usual, "lang", "left")
    explained = F.least(F.coalesce(F.col("prose") / F.col("usual"), F.lit(0.0)), F.lit(1.2)) * (1 - F.col("links"))
    return held.withColumn("explained", explained).withColumn("away", F.greatest(_away("length"), F.coalesce(_away("cell"), F.lit(0.0)))).drop("cell", "length", "usual")


def is_stuffed(known: Column) -> Column:
    """The decision on a page of ``departures``. ``known``: whether its label names a language of known prose, or none."""
    curved = (F.col("explained") < EXPLAINED_EXTREME) & (F.col("words") >= CURVE_WORDS)
    divergent = (F.col("explained") < EXPLAINED_LEAST) | (curved & (F.col("away") > 1))
    blind = (F.col("links") > LINKED) | (curved & (F.col("away") > FAR))
    return ((F.col("words") >= LEAST_WORDS) | (F.col("links") > LINKED)) & F.when(known, divergent).otherwise(blind)


def judged_pages(documents: DataFrame) -> DataFrame:
    """``doc_id, label, lang, words, links, explained, away, stuffed`` of each page with words or links. ``documents`` has ``doc_id, lang, text``, and ``site`` if known."""
    site = [c for c in ("site",) if c in documents.columns]
    pages = (
        documents.where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("row"), F.coalesce(F.lower("lang"), F.lit(UNKNOWN)).alias("lang"), "text", *site)
    )
    sizes = language_sizes(pages)
    joined = bool(sizes.where("NOT large").take(1))
    prose = prose_words(language_words(voters(pages)), sizes)
    if joined:
        prose = checkpointed(prose)
    # A table of bounded size, see PROSE_SHARE and LEAST_LANGUAGE, whatever the number of pages.
    shares: dict[str, dict[str, float]] = {}
    for r in prose.where("large").collect():
        shares.setdefault(r.lang, {})[r.word] = r.share
    lines = curves(page_entries(pages, shares))
    known = F.col("label").isin([*shares, UNKNOWN]) if shares else F.lit(False)
    if joined:
        # Pages of a small language are held against it and against the large ones; what explains more of them counts.
        small = prose.where("NOT large").drop("large")
        rest = small.select(F.col("lang").alias("label"), F.lit(True).alias("small")).distinct()
        both = lines.join(rest.drop("small"), "label", "left_semi").unionByName(curves(joined_entries(pages, small)))
        best = both.groupBy("doc_id", "row").agg(F.max_by(F.struct(*(c for c in lines.columns if c not in ("doc_id", "row"))), F.col("prose")).alias("x")).select("doc_id", "row", "x.*")
        lines = lines.join(rest.drop("small"), "label", "left_anti").unionByName(best.select(*lines.columns))
    # One row a page, used four times: kept, so that the words are counted once for it.
    found = departures(checkpointed(lines))
    if joined:
        found, known = found.join(rest, "label", "left"), known | F.col("small").isNotNull()
    return found.select("doc_id", "label", "lang", "words", "links", "explained", "away", is_stuffed(known).alias("stuffed"))


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the pages that are keyword, link or tag spam."""
    return judged_pages(documents).where("stuffed").select("doc_id").distinct()
