"""Each operator against a brute-force version on small tables, with the odd rows that real tables have."""

import math
import random
import time
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.llm import bpe, cooccurrence, frequency, mixing, sentences, stuffing

VOCABULARY = Path(bpe.DEFAULT_VOCABULARY)


@pytest.mark.skipif(not VOCABULARY.exists(), reason="needs the public vocabulary")
def test_ids_equal_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(str(VOCABULARY))
    public.encode_special_tokens = True
    random.seed(1)
    pieces = ["'s", "'re", "'LL", "don't", " ", "  ", "\n", "\t", "1", "²", "é", "中文", "ไทย", "́", "!", "...", "　", "<|endoftext|>", "🙂", "x" * 70, "ก" * 40, "The protein", "\x00"]
    texts = [None, "", " "] + ["".join(random.choices(pieces, k=random.randint(1, 10))) for _ in range(1500)] + ["ab" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in bpe.encode_texts(df).collect()}
    want = {i: public.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert got == want
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()}
    assert counts == {i: len(x) for i, x in want.items()}
    assert bpe.encode_texts(df.limit(0)).count() == 0


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BLOCK", 8)  # most records then go through blocks
    random.seed(2)
    rows = [(d, random.choice([1, 1, 1, *range(2, 30)])) for d in range(60) for _ in range(random.choice([1, 3, 25]))]
    rows += rows[:50] + [(None, 3), (5, None)]
    df = spark.createDataFrame(rows, "doc int, serial bigint").withColumn("n1", F.lit(1)).withColumn("item", F.lit("x"))
    by = defaultdict(set)
    for d, s in rows:
        if d is not None and s is not None:
            by[d].add(s)
    one = Counter(s for x in by.values() for s in x)
    two = Counter(p for x in by.values() for p in combinations(sorted(x), 2))
    want = {(a, b): (k, one[a], one[b], len(by)) for (a, b), k in two.items() if k >= 3}
    got = {(r.item1, r.item2): (r.n12, r.n1, r.n2, r.n) for r in cooccurrence.judged_pairs(df, "doc", "serial", 3).collect()}
    assert got == want
    assert cooccurrence.judged_pairs(df.limit(0), "doc", "serial", 3).count() == 0


def test_pairs_are_judged_by_their_likelihood_ratio(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "HOT_SHARE", 0.1)  # item 1 is hot
    rows = [(d, 1) for d in range(100)] + [(d, s) for d in range(30) for s in (2, 3)] + [(d, 4) for d in range(25, 75)] + [(d, 5) for d in range(0, 100, 2)]
    got = {(r.item1, r.item2): r for r in cooccurrence.judged_pairs(spark.createDataFrame(rows, "doc int, serial bigint"), "doc", "serial", 1).collect()}
    assert len(got) == 10  # every pair that meets
    n, n1, n2, n12 = 100, 30, 30, 30
    table = [(n12, n1, n2), (n1 - n12, n1, n - n2), (n2 - n12, n - n1, n2), (n - n1 - n2 + n12, n - n1, n - n2)]
    llr = 2 * sum(k * math.log(k * n / a / b) for k, a, b in table if k)
    assert got[2, 3].llr == pytest.approx(llr) and got[2, 3].significant and got[2, 3].lift == pytest.approx(100 / 30)
    assert not got[1, 2].significant  # with every record, no more than chance
    assert got[2, 4].llr > cooccurrence.SIGNIFICANT and not got[2, 4].significant  # less than chance
    assert not got[2, 5].significant


def test_stripes_of_hot_items_are_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "RECORDS_PER_PART", 10)
    monkeypatch.setattr(cooccurrence, "ROW_ENTRIES", 3)
    rows = [(d, s) for d in range(50) for s in (0, d % 20 + 1, d % 7 + 30)]
    assert len(set(cooccurrence._part_of(cooccurrence.np.full(40, 50), cooccurrence.np.arange(40)))) > 2
    pairs = cooccurrence.stripes(cooccurrence.record_items(spark.createDataFrame(rows, "doc int, serial bigint"), "doc", "serial"))
    got = Counter()
    for r in pairs.collect():
        for b, k in zip(r.neighbours, r.counts):
            got[r.item, b] += k
    assert got == Counter(p for d in range(50) for p in combinations(sorted({0, d % 20 + 1, d % 7 + 30}), 2))


def test_ngrams_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(frequency, "ARRAY", 7)
    random.seed(3)
    names = [(random.choice([1, 1, 1, 2, 3, 4]), " ".join(random.choices(["a", "B", "b,", "(c)", "...", "d", "é"], k=random.randint(0, 6)))) for _ in range(200)]
    rows = names + names[:20] + [(None, "a b"), (7, None), (8, ""), (9, "  　x y ")]
    df = spark.createDataFrame(rows, "serial bigint, name string").withColumn("count", F.lit(0))
    got = {r.ngram: (r.occurrences, r.records) for r in frequency.ngram_counts(df, "serial", frequency.words_of(F.col("name")), 3).collect()}
    occurrences, records = Counter(), defaultdict(set)
    for serial, name in rows:
        words = [w for w in (x.strip(frequency.EDGES) for x in (name or "").lower().split()) if w]
        for n in (1, 2, 3):
            for i in range(len(words) - n + 1):
                if serial is not None:
                    gram = " ".join(words[i : i + n])
                    occurrences[gram] += 1
                    records[gram].add(serial)
    assert got == {g: (k, len(records[g])) for g, k in occurrences.items()}
    assert frequency.ngram_counts(df.limit(0), "serial", frequency.words_of(F.col("name"))).count() == 0


def test_ngrams_of_every_length(spark):
    names = [(1, "a b c d e f"), (2, "x b c d e"), (2, "b c d e")]
    df = spark.createDataFrame(names, "serial bigint, name string")
    got = {r.ngram: (r.n, r.occurrences, r.records) for r in frequency.ngram_counts(df, "serial", frequency.words_of(F.col("name"))).collect()}
    want = defaultdict(list)
    for serial, name in names:
        w = name.split()
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                want[" ".join(w[i:j])].append(serial)
    assert got == {g: (g.count(" ") + 1, len(s), len(set(s))) for g, s in want.items()}


def test_terms_of_every_length_of_the_names(spark, monkeypatch):
    from termloom.llm import frequency_queries

    tables = {"names": spark.createDataFrame([(1, "a b c d e"), (2, "a a")], "serial bigint, name string"), "test_entities": spark.createDataFrame([(1, 9)], "serial bigint, type int")}
    monkeypatch.setattr(frequency_queries, "table", lambda s, f, name, *columns: tables[name].select(*columns))
    got = [r.term for r in frequency_queries.p5_terms(spark, "").where("field = 'name'").collect()]
    assert sorted(got) == sorted([" ".join("abcde"[i:j]) for i in range(5) for j in range(i + 1, 6)] + ["a a"])
    found = {(r.field, r.term, r.mark) for r in frequency_queries.p5_found(spark, "").collect()}
    assert found == {("name", c, "rare") for c in "abcde"} | {("type", "9", "rare")}


SENTENCES = [
    ("See Fig. 5 and e.g. Dr. Smith et al. here. The U.S. cohort grew.", ["See Fig. 5 and e.g. Dr. Smith et al. here.", "The U.S. cohort grew."]),
    ("It rose from 1.5 to 9.7. No loss was seen [2]. alpha-x fell.[1,2] Was it?", ["It rose from 1.5 to 9.7.", "No loss was seen [2].", "alpha-x fell.[1,2]", "Was it?"]),
    ('"Is it stable?" was the question. (All were blind.) They call it "a regulator." These fit.', ['"Is it stable?" was the question.', "(All were blind.)", 'They call it "a regulator."', "These fit."]),
    ("Heading\n\nOne line\nbreak only.\tLast", ["Heading", "One line\nbreak only.", "Last"]),
    ("「本当か？」という疑問が残る。なんと安定だろう！", ["「本当か？」という疑問が残る。", "なんと安定だろう！"]),
    ("这一剂量……直到第2天才消失。“真的吗？！”《通报》报道了它。", ["这一剂量……直到第2天才消失。", "“真的吗？！”", "《通报》报道了它。"]),
    ("Γιατί χάνεται η δομή; Η δομή, δηλ. η ομάδα, χάθηκε!", ["Γιατί χάνεται η δομή;", "Η δομή, δηλ. η ομάδα, χάθηκε!"]),
    ("One; two. Three", ["One; two.", "Three"]),
    ("ผลวัดได้ 1.24 เท่าในกล้ามเนื้อ ขนาดยาเพิ่มขึ้น", ["ผลวัดได้ 1.24 เท่าในกล้ามเนื้อ", "ขนาดยาเพิ่มขึ้น"]),
    ("Am 2. Mai 2017 war es z. B. stark. „Ist es stabil?“, fragte er.", ["Am 2. Mai 2017 war es z. B. stark.", "„Ist es stabil?“, fragte er."]),
    ("« Est-ce faible ? » demande M. Dupont. Oui !", ["« Est-ce faible ? » demande M. Dupont.", "Oui !"]),
    ("کیا یہ ہے؟ جگر میں بڑھی۔ آخر", ["کیا یہ ہے؟", "جگر میں بڑھی۔", "آخر"]),
    (" \t\n", []),
    ("", []),
]


@pytest.mark.parametrize("text, want", SENTENCES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == want


def test_semicolons_end_greek_questions_only():
    symbols = "Levels of TNF-α, IL-1β and IFN-γ; These rose."
    assert [symbols[a:b] for a, b in sentences.sentence_spans(symbols)] == [symbols]
    asked = "Γιατί χάνεται σταδιακά η δομή της πρωτεΐνης mitogen activated protein kinase kinase kinase interacting partner; Η δομή χάθηκε."
    assert [asked[a:b] for a, b in sentences.sentence_spans(asked)] == [asked[: asked.index(";") + 1], "Η δομή χάθηκε."]


def test_long_blocks_and_rows(spark):
    long = "This is one sentence, i.e. a short one. " * 500
    assert len(sentences.sentence_spans(long)) == 500
    df = spark.createDataFrame([(1, "Ab cd. Cd ef.", None, 5), (None, "X", "", 5), (1, "Ab cd. Cd ef.", None, 5)], "row_id bigint, title string, text string, field int")
    rows = sentences.split_sentences(df, "row_id", ("title", "text")).collect()
    assert sorted((r.row_id or 0, r.field, r.begin_pos, r.end_pos) for r in rows) == [(0, "title", 0, 1)] + [(1, "title", 0, 6)] * 2 + [(1, "title", 7, 13)] * 2
    assert sentences.split_sentences(df.limit(0), "row_id", ("title",)).count() == 0


def test_small_and_large_blocks_choose_alike(monkeypatch):
    # Above 65 places the same scores are found by arrays.
    random.seed(4)
    pieces = ["The cell fell. ", "(All rose. None fell.) ", "Dr. Smith et al. left ", '"Is it? It is. ', 'So." ', "γιατί χάνεται η δομή; ", "No. 5 of it; ", "a.b. ", "ab cd… ", "W. X. Yz! "]
    for n in (3, 30, 120):
        for _ in range(20):
            text = "".join(random.choices(pieces, k=n)).strip()
            places = sentences._Places(text, 0, len(text))
            if len(places.ends) < 2:
                continue
            padded = sentences._Places(text, 0, len(text))
            k = max(0, 66 - len(places.ends))  # places that nothing ends at
            for name, value in (("ends", len(text)), ("starts", len(text)), ("closes", -1e9), ("opens", 0.0), ("whole", -1), ("asks", False), ("marks", len(text))):
                column = getattr(padded, name)
                column[-1:-1] = [value] * k
            assert [places.ends[j] for j in sentences._best(places)] == [padded.ends[j] for j in sentences._best(padded)]


def brute_force(p):
    """The best of all sequences of spans, each scored on its own."""
    depth = lambda at: sum(a < at <= b for b, a in p.pairs.items())

    def score(i, j):
        start, end = p.starts[i], p.ends[j]
        torn = sum((a >= p.ends[i]) != (b >= p.ends[i]) or (a >= end) != (b >= end) for b, a in p.pairs.items() if not (a < p.ends[i] and b >= end) and a < end and b >= p.ends[i])
        text = p.text[start : p.marks[j]]
        letters, greek = sum(c.isalpha() for c in text), sum("Ͱ" <= c <= "Ͽ" for c in text)
        if p.asks[j] and (greek < 3 or greek < sentences.GREEK_SHARE * letters):
            return -1e17
        return p.opens[i] + (sentences.WORD_GAIN if p.whole[j] == start else p.closes[j]) - sentences.TORN * torn - sentences._length_cost(end - start)

    n, best = len(p.ends), (-math.inf, [])
    for mask in range(1 << (n - 2)):
        chosen = [j for j in range(1, n - 1) if mask >> (j - 1) & 1] + [n - 1]
        total = sum(score(i, j) for i, j in zip([0, *chosen], chosen))
        best = max(best, (total, chosen))
    assert depth(p.ends[0]) == 0
    return best


def test_spans_are_the_best_of_all_sequences():
    random.seed(5)
    pieces = ["The cell fell. ", "(All rose. None fell.) ", "Dr. Smith ", '"Is it? It is." ', "γιατί χάνεται; ", "No. 5; ", "(see X. Then ", "go.) "]
    for _ in range(60):
        text = "".join(random.choices(pieces, k=6)).strip()
        p = sentences._Places(text, 0, len(text))
        if 2 < len(p.ends) < 12:
            total, chosen = brute_force(p)
            assert [p.ends[j] for j in sentences._best(p)] == [p.ends[j] for j in chosen], text


def test_brackets_of_a_span_are_judged_by_the_span():
    whole = "It fell. (All rose. None fell.) So it was."
    assert [whole[a:b] for a, b in sentences.sentence_spans(whole)] == ["It fell.", "(All rose. None fell.)", "So it was."]
    inside = "It fell (see Fig. 2. None fell.) and rose."
    assert [inside[a:b] for a, b in sentences.sentence_spans(inside)] == [inside]
    # A quotation of very many sentences is torn at its ends once; its inner sentences aren't.
    long = '"' + "This sentence stands inside of it. " * 30 + 'That ends it." So it was.'
    assert len(sentences.sentence_spans(long)) == 32


def mix(spark, rows, targets, **options):
    documents = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, site string, n_tokens bigint")
    goals = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    sized = mixing.sized(documents)
    leaves = mixing.budgets(sized, goals, **options)
    chosen = mixing.select_documents(sized, leaves)
    return leaves, chosen, mixing.reached_shares(chosen, goals)


def test_mixing_reaches_the_targets(spark):
    random.seed(5)
    rows = [(k, random.choices(["a", "b", "c", None], [6, 2, 1, 1])[0], random.choice(["en", "EN", None, "de"]), random.choice(["x", "y", None]), random.choice([0, None, 50, 100, 200])) for k in range(3000)]
    targets = [("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.2, 4), ("absent", 0.1, 2)]
    leaves, chosen, shares = mix(spark, rows, targets)
    out = {r.source: r for r in shares.collect()}
    assert out["absent"].tokens == 0
    for source, share in (("a", 0.4), ("b", 0.4), ("c", 0.2)):
        assert abs(out[source].share - share) < 0.01
    used = {r.doc_id: (r.source, r.times_used) for r in chosen.collect()}
    caps = {s: m for s, _, m in targets}
    assert all(1 <= k <= caps[s] for s, k in used.values()) and len(used) == chosen.count()
    for r in leaves.collect():
        assert r.budget <= r.capacity + 1e-6
    assert mix(spark, rows, targets)[1].count() == len(used)  # seeded


def test_shortage_goes_to_siblings_first(spark):
    # The language de of source a can't take its lifted weight; en of the same source gets it, b gets nothing more.
    rows = [(1, "a", "de", "x", 10), (2, "a", "en", "x", 1000), (3, "b", "en", "x", 1000)]
    leaves = {(r.source, r.lang): r.budget for r in mix(spark, rows, [("a", 0.5, 1), ("b", 0.5, 1)], total=1200, powers={"lang": 0.1, "site": 1.0})[0].collect()}
    assert leaves["a", "de"] == pytest.approx(10) and leaves["a", "en"] == pytest.approx(590) and leaves["b", "en"] == pytest.approx(600)


def water_filled(weights, capacities, budget):
    """Budgets of siblings by raising all open ones together, one full one at a time."""
    out, open_ = {}, set(weights)
    while open_:
        level = (budget - sum(out.values())) / sum(weights[k] for k in open_)
        full = {k for k in open_ if capacities[k] <= level * weights[k] * (1 + 1e-12)}
        if not full:
            return out | {k: level * weights[k] for k in open_}
        out |= {k: capacities[k] for k in full}
        open_ -= full
    return out


def test_budgets_equal_brute_force(spark):
    random.seed(11)
    rows = [(k, random.choice("abc"), random.choice(["en", "de", "fr", None]), f"s{random.randint(0, 30)}", random.choice([1, 7, 50, 400])) for k in range(800)]
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)]
    powers = {"lang": 0.4, "site": 0.6}
    leaves = mix(spark, rows, targets, total=30_000, powers=powers)[0].collect()
    repeats = {s: m for s, _, m in targets}
    size = defaultdict(int)
    for _, source, lang, site, n in rows:
        for key in ((source,), (source, lang or "und"), (source, lang or "und", site)):
            size[key] += n
    children = defaultdict(list)
    for key in size:
        children[key[:-1]].append(key)
    budget = {(): 30_000}
    for depth, power in ((0, None), (1, 0.4), (2, 0.6)):
        for parent in [k for k in list(budget) if len(k) == depth]:
            own = children[parent]
            weights = {k: {s: w for s, w, _ in targets}[k[0]] if power is None else size[k] ** power for k in own}
            budget |= water_filled(weights, {k: size[k] * repeats[k[0]] for k in own}, budget[parent])
    for r in leaves:
        assert r.budget == pytest.approx(budget[r.source, r.lang, r.site], rel=1e-6)


def test_a_language_of_very_many_sites(spark):
    # The sites of a language are spread over ranges; no window has all of them.
    leaves = spark.range(300_000).select(
        F.lit("a").alias("source"), F.lit("en").alias("lang"), F.col("id").cast("string").alias("site"), (F.col("id") % 97 + 1).alias("n_tokens"), F.col("id").alias("doc_id")
    )
    goals = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    began = time.perf_counter()
    got = mixing.budgets(mixing.sized(leaves), goals, total=20_000_000.0, powers={"lang": 1.0, "site": 0.5}).agg(F.sum("budget"), F.max(F.col("budget") - F.col("capacity"))).first()
    assert got[0] == pytest.approx(20_000_000) and got[1] <= 1e-9
    assert time.perf_counter() - began < 60


def test_mixing_of_nothing(spark):
    assert mix(spark, [(1, None, "en", "x", 5)], [("a", 1.0, 1)])[1].count() == 0


PROSE = "The {0} of the {1} was seen in the {2} after we had scored it for {3} days and the control did not change at all.".format
NOUNS = "membrane gradient vesicle sample kinase allele donor network cohort signal response module lineage scaffold".split()


def pages():
    random.seed(6)
    for k in range(120):
        yield k, "en" if k % 9 else None, " ".join(PROSE(*random.sample(NOUNS, 3), k) for _ in range(random.randint(2, 9)))


STUFFED = {
    1000: "cheap kit buy kit best kit kit price kit online " * 12,
    1001: "\n".join(f"[stek kit](https://www.x{k}.example/a/{k})" for k in range(30)),
    1002: "\n".join("Tags: " + ", ".join(random.Random(k).sample("sterile amber blue cream XL clear low-bind tablets serum flask".split(), 5)) for k in range(25)),
    1003: "Looking for zorb? Here zorb is zorb, and zorb is cheap. A zorb beats any zorb without zorb. " * 8,
    1004: "Home | Login | Cart | Privacy | Products | Zorb | " * 15,
}


def test_stuffed_pages(spark):
    rows = [*pages(), *((k, "en", t) for k, t in STUFFED.items()), (2000, "en", None), (2001, "en", ""), (2002, None, " \n"), (None, "en", STUFFED[1000]), (1000, "en", STUFFED[1000]), (2003, "en", "!!! ...")]
    rows.append((2004, "en", PROSE("cell", "kit", "lab", 3) * 6 + " cheap kit buy kit best kit"))
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").withColumn("word", F.lit(1)).withColumn("k", F.lit(2))
    got = [r.doc_id for r in stuffing.stuffed_pages(df).collect()]
    assert sorted(got) == sorted(STUFFED)


def small_language(lang, first, n, start):
    """Pages whose words are in no other language: word k is in every page's sentences."""
    rng = random.Random(first)
    common = [f"{lang}{w}" for w in "ta lo mi ren sul vok dap ke nu ori bas tem".split()]
    rare = [f"{lang}{a}{b}" for a in "bcdfgklm" for b in "aeiou"]
    sentence = lambda: " ".join(rng.sample(common, 5) + rng.sample(rare, 5)).capitalize() + "."
    return [(start + k, lang, " ".join(sentence() for _ in range(9))) for k in range(n)]


@pytest.mark.parametrize("least", [0.0005, 0.3, 2.0])
def test_small_languages_are_judged_by_their_own_prose(spark, monkeypatch, least):
    # 0.3: the middle language is joined; 2.0: all languages are joined. The rows are the same.
    monkeypatch.setattr(stuffing, "LEAST_LANGUAGE", least)
    rows = [*pages(), *((k, "en", t) for k, t in STUFFED.items())]
    rows += small_language("xa", 1, 14, 3000) + small_language("xb", 2, 4, 4000)
    rows += [(3100, "xa", STUFFED[1004]), (4100, "xb", STUFFED[1001]), (4101, "xb", STUFFED[1000])]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    got = [r.doc_id for r in stuffing.stuffed_pages(df).collect()]
    assert sorted(got) == sorted([*STUFFED, 3100, 4100, 4101])


def test_a_spam_template_on_a_third_of_pages_is_no_prose(spark):
    rng = random.Random(8)
    rows = [(k, "en", " ".join(PROSE(*rng.sample(NOUNS, 3), k) for _ in range(rng.randint(6, 8)))) for k in range(100)]
    spam = "zorb kit cheap deal blik".split() * 40
    rows += [(1000 + k, "en", " ".join(rng.sample(spam, 200))) for k in range(50)]
    got = [r.doc_id for r in stuffing.stuffed_pages(spark.createDataFrame(rows, "doc_id bigint, lang string, text string")).collect()]
    assert sorted(got) == list(range(1000, 1050))


def test_a_site_with_a_third_of_pages_does_not_make_its_tags_prose(spark):
    rng = random.Random(9)
    rows = [(k, "en", " ".join(PROSE(*rng.sample(NOUNS, 3), k) for _ in range(rng.randint(6, 8))), f"s{k}") for k in range(100)]
    tags = [a + b for a in "zor bli kra tum fex".split() for b in "bo na ti lu re mi sa do".split()]
    rows += [(1000 + k, "en", "\n".join("Tags: " + ", ".join(rng.sample(tags, 7)) for _ in range(20)), "hot") for k in range(50)]
    got = [r.doc_id for r in stuffing.stuffed_pages(spark.createDataFrame(rows, "doc_id bigint, lang string, text string, site string")).collect()]
    assert sorted(got) == list(range(1000, 1050))


def test_stuffing_that_fills_a_cell_does_not_hide_in_it(spark):
    rng = random.Random(10)
    rows = [(k, "en", " ".join(PROSE(*rng.sample(NOUNS, 3), k) for _ in range(11 if k % 40 == 0 else rng.randint(5, 8)))) for k in range(120)]
    spam = "zorb kit cheap deal blik".split() * 60
    rows += [(1000 + k, "en", " ".join(rng.sample(spam, 290))) for k in range(40)]  # all but three of their length
    got = [r.doc_id for r in stuffing.stuffed_pages(spark.createDataFrame(rows, "doc_id bigint, lang string, text string")).collect()]
    assert sorted(got) == list(range(1000, 1040))


def scanned_words(text):
    """The words of a lower-case text, character by character."""
    kinds = stuffing._classes()
    out, word = [], ""
    for c in text + " ":
        kind = kinds[ord(c)]
        if kind != stuffing._WORD and word:
            out.append(word)
            word = ""
        word += c if kind == stuffing._WORD else ""
    return out + [text[i : i + 2] for i in range(len(text) - 1) if kinds[ord(text[i])] == kinds[ord(text[i + 1])] == stuffing._PAIRED]


def test_rows_of_one_id_have_their_own_curves(spark):
    prose = " ".join(PROSE(*NOUNS[:3], k) for k in range(9))
    rows = [(1, 1, "en", prose), (1, 2, "en", STUFFED[1000]), (2, 3, "en", prose)]
    entries = stuffing.page_entries(spark.createDataFrame(rows, "doc_id bigint, row bigint, lang string, text string"), {"en": {"the": 0.5}})
    got = sorted((r.row, round(r.variety, 6), r.words) for r in stuffing.curves(entries).collect())
    words = [scanned_words(t.lower()) for _, _, _, t in rows]
    assert got == [(k, round(math.log(len(set(w)) / len(w) + 0.02), 6), len(w)) for k, w in enumerate(words, 1)]


def test_pages_are_held_against_the_language_that_explains_them(spark):
    rows = [(1, 1, "xx", "aa bb cc"), (2, 2, "yy", "aa bb dd dd"), (3, 3, "xx", "zz"), (4, 4, None, ""), (5, 5, "yy", "http://a.example/b #tag")]
    shares = {"xx": {"aa": 0.5, "bb": 0.5}, "yy": {"dd": 1.0}}
    got = {r.doc_id: (r.lang, sorted((e.k, e.share, e.n) for e in r.entries if e.share)) for r in stuffing.page_entries(spark.createDataFrame(rows, "doc_id bigint, row bigint, lang string, text string"), shares).collect()}
    assert got == {1: ("xx", [(1, 0.5, 1), (1, 0.5, 1)]), 2: ("yy", [(2, 1.0, 1)]), 3: (None, []), 4: (None, []), 5: (None, [])}


def test_sound_pages_of_a_rare_language_are_no_cases(spark):
    rows = [*pages(), *((k, "en", t) for k, t in STUFFED.items()), *small_language("fi", 3, 9, 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    assert sorted(r.doc_id for r in stuffing.stuffed_pages(df).collect()) == sorted(STUFFED)


def test_words_by_masks_and_by_scan():
    random.seed(7)
    texts = ["".join(random.choices(["a", "B", "é", "中", "文", "ไ", "ท", " ", "-", "1", "́", "の", ".", "में"], k=20)).lower() for _ in range(300)] + ["", None]
    words, which, rows = stuffing.words_of_batch(pa.array(texts))
    got = [[] for _ in texts]
    for w, r in zip(which.tolist(), rows.tolist()):
        got[r].append(words[w].as_py())
    assert [sorted(x) for x in got] == [sorted(scanned_words(t or "")) for t in texts]
