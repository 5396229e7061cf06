"""Small cases with results worked out by hand."""

import random
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions.keys import canonical_key, key_of
from termloom.functions.latin import character_spans
from termloom.operators import dictionary as D
from termloom.operators.handlers import DocumentHandler, handled
from termloom.operators.markup import annotated, masked
from termloom.operators.matching import (
    blocked_by_pattern, dictionary_hits, find_mentions, found_keys, heads_hit, keyed_rows, leftmost_longest, mention_rows, overlapping_keys, wanted, with_blocked, with_entities,
)
from termloom.operators.pairs import pair_counts, pair_levels, pair_scores, pair_sums, typed_pairs
from termloom.operators.render import distinct_entities, distinct_keyed, entities_xml, entity_lines, jsonld, match_tuples, popup_addresses, resolved_lines, resolved_xml
from termloom.operators.resolution import disambiguated, grouped
from termloom.operators.segments import inside_segments, segments, segments_of, whole_documents
from termloom.operators.windows import byte_tokens, candidate_windows, dictionary_bitmap, hash_strings, tokens, trim

ENTITY = "array<struct<type:int,serial:bigint,identifier:string>>"


def words(spark, names, types, stops=None):
    rows = D.names_with_entities(
        spark.createDataFrame(names, "serial bigint, name string"), spark.createDataFrame([(s, t, str(s)) for s, t in types.items()], "serial bigint, type int, identifier string")
    )
    return D.dictionary(rows, spark.createDataFrame(stops, "name string, flag string") if stops else None)


def tag(spark, text, names, kinds, stops=None, local=None, **options):
    documents = spark.createDataFrame([(1, text)], "doc_id int, text string")
    known = words(spark, names, kinds, stops)
    found = dictionary_hits(candidate_windows(documents, known), known)
    listed = D.stop_list(spark.createDataFrame(stops, "name string, flag string")) if stops else None
    own = D.stop_list(spark.createDataFrame(local, "name string, doc_id string, flag string"), local=True) if local else None
    return find_mentions(with_blocked(found, listed, own), **options)


def spans(matches):
    return [(r.start, r.stop, r.serial) for r in mention_rows(matches).orderBy("ord", "serial").collect()]


M1_TEXT = "TIMP1 binds PLK1. \tATM-kinase was seen."
M1_NAMES = [(101, "TIMP-1"), (102, "PLK1"), (103, "ATM kinase")]
M1_TYPES = dict.fromkeys((101, 102, 103), 9606)


def test_end_to_end(spark):
    matches = disambiguated(tag(spark, M1_TEXT, M1_NAMES, M1_TYPES, types=(9606,)))
    documents = spark.createDataFrame([(1, M1_TEXT)], "doc_id int, text string")
    parts = segments(documents)
    assert [tuple(r) for r in parts.orderBy("begin").collect()] == [(1, 1, 1, 0, 17), (1, 2, 1, 19, 39)]
    rows = inside_segments(mention_rows(matches), parts)
    got = rows.select("doc_id", "paragraph", "sentence", "start", "stop", "text", "type", "serial").orderBy("start").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 0, 4, "TIMP1", 9606, 101), (1, 1, 1, 12, 15, "PLK1", 9606, 102), (1, 2, 1, 19, 28, "ATM-kinase", 9606, 103)]
    types = spark.createDataFrame(list(M1_TYPES.items()), "serial bigint, type int")
    scores = pair_scores(typed_pairs(pair_sums(pair_counts(rows)), types)).orderBy("serial1", "serial2").collect()
    assert [tuple(round(x, 6) for x in r) for r in scores] == [
        (101, 102, 1.963143, 0.943311, 5.2, 4.2, 4.2, 3.2),
        (101, 103, 0.825448, 0.619048, 5.2, 4.2, 2.0, 1.0),
        (102, 103, 0.825448, 0.619048, 5.2, 4.2, 2.0, 1.0),
    ]


@pytest.mark.parametrize("name, key", [("P-53", "|P53|"), ('"p53"', "|P53|"), ("p 53.", "|P53|"), ("-p53", "-|P53|"), ("p53-", "|P53|-"), ("a, b", "|A,B|"), ("a,b", "|A,B|"), ("a b", "|AB|")])
def test_keys(name, key):
    assert key_of(name) == key.replace("|", "\x01")


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab-_ .,;()'\"Z9é\t{", max_size=9), min_size=50, max_size=80))
def test_key_expression(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", canonical_key(F.col("n")).alias("k")).collect()
    assert all(r.k == key_of(r.n.encode().decode("latin-1")) for r in rows)


def test_stop_pattern(spark):
    blocked = ["P53", "the cell", "cell of", "10 mg", "10mg", "5 days", "C-3", "C-123", "is", "a-b", "or 12", "state of", "fish are red", "12A", "1234A", "&amp", "12 34"]
    free = ["p53", "the", "that", "RAN", "ran", "TGF", "TIMP1", "PLK1", "ATM-kinase", "fish and chips", "tissue growth factor"]
    rows = spark.createDataFrame([(n,) for n in blocked + free], "n string").select("n", blocked_by_pattern(F.col("n")).alias("b")).collect()
    assert {r.n for r in rows if r.b} == set(blocked)


def test_stop_list_and_stub(spark):
    names, types, stops = [(1, "growth factor"), (2, "factor")], {1: 1, 2: 1}, [("growth factor beta", "t")]
    assert spans(tag(spark, "growth factor beta", names, types, stops)) == [(7, 12, 2)]
    assert spans(tag(spark, "growth factor beta", names, types, stops, allow_overlap=True)) == [(0, 12, 1), (7, 12, 2)]
    assert spans(tag(spark, "growth factor", names, types, local=[("growth factor", "1", "t")])) == [(7, 12, 2)]


def test_greedy(spark):
    names = [(1, "alpha beta"), (2, "beta gamma delta"), (3, "gamma")]
    assert spans(tag(spark, "alpha beta gamma delta", names, dict.fromkeys((1, 2, 3), 5))) == [(0, 9, 1), (11, 15, 3)]


def test_acronyms(spark):
    text = "tissue growth factor (TGF) and T-G-F"
    assert spans(tag(spark, text, [(1, "tissue growth factor"), (2, "TGF")], {1: 5, 2: 5})) == [(0, 19, 1), (22, 24, 1), (31, 35, 1)]
    assert spans(tag(spark, text, [(2, "TGF")], {2: 5})) == []


def test_autodetect(spark):
    names, types = [(50, "human"), (51, "abcd")], {50: -3, 51: 9606}
    organisms = spark.createDataFrame([(50, 9606)], "serial bigint, taxon int")
    run = lambda text: spans(tag(spark, text, names, types, types=(-26,), auto_detect=True, organisms=organisms))
    assert run("human abcd") == [(6, 9, 51)] and run("abcd") == []


def test_type_zero_means_all_from_zero(spark):
    names, types = [(1, "abcd"), (2, "efgh")], {1: 9606, 2: -26}
    assert spans(tag(spark, "abcd efgh", names, types, types=(0,))) == [(0, 3, 1)]
    assert spans(tag(spark, "abcd efgh", names, types)) == [(0, 3, 1), (5, 8, 2)]


def given_matches(spark, sets):
    rows = [(1, k, k, k, f"m{k}", [(t, s, None) for s, t in entities]) for k, entities in enumerate(sets)]
    return spark.createDataFrame(rows, f"doc_id int, ord int, start int, stop int, text string, entities {ENTITY}")


def serials(matches):
    return [sorted(e.serial for e in r.entities) for r in matches.orderBy("ord").collect()]


def test_disambiguation(spark):
    sets = [[(1, 5), (2, 5)], [(1, 5)], [(2, 5), (3, 5)], [(3, 5), (4, 5)]]
    assert serials(disambiguated(given_matches(spark, sets))) == [[1], [1], [2, 3], [3]]


def test_groups(spark):
    edges = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "child bigint, parent bigint")
    types = spark.createDataFrame([(10, 40674), (11, 40674)], "serial bigint, type int")
    run = lambda *sets: serials(grouped(given_matches(spark, sets), edges, types))
    a, b, c = (1, 9606), (2, 10090), (3, 10116)
    assert run([a, b]) == [[1, 2, 10]] and run([c]) == [[3, 11]] and run([a, c]) == [[]]
    assert run([a, c], [a]) == [[1, 10], [1, 10]]


def test_pair_rule(spark):
    rows = [(1, 1, 1, 0, 1), (1, 1, 1, 0, 2), (1, 1, 1, 1, 1), (1, 1, 1, 2, 3)]
    levels = pair_levels(pair_counts(spark.createDataFrame(rows, "doc_id int, paragraph int, sentence int, ord int, serial bigint")))
    assert {(r.serial1, r.serial2) for r in levels.collect()} == {(1, 3), (2, 3)}


@pytest.mark.parametrize(
    "text, want",
    [
        ("See e.g. Fig one. Next one.", [(0, 17), (18, 27)]),
        ("Ab. Next.", [(0, 9)]),
        ('It was. "Next" one.', [(0, 7), (9, 19)]),
        ("One two three.\t", [(0, 14), (15, 15)]),
        ("He et al. Was here.", [(0, 19)]),
        ("", []),
    ],
)
def test_segments(text, want):
    assert [(a, b) for a, b, _, _ in segments_of(text)] == want


def test_tokens(spark):
    one = lambda text, **o: [r.token for r in tokens(spark.createDataFrame([(1, text)], "doc_id int, text string"), **o).orderBy("seg", "i").collect()]
    assert one('"P-53" (x*y)') == ['"P', "-", '53"', "x", "*", "y"]
    assert len(one("a b", characters=True)) == 3


def shrunk(text, start, stop):
    """The rule step by step on one span: the partner of a bracket is where its kind is balanced again."""

    def partner(at, step):
        kind, depth = next(k for k in ("()", "[]", "{}") if text[at] in k), 0
        while start <= at <= stop:
            depth += {kind[0]: 1, kind[1]: -1}.get(text[at], 0) * step
            if depth == 0:
                return at
            at += step

    while start < stop:
        if text[start] in "([{" and partner(start, 1) == stop:
            start, stop = start + 1, stop - 1
        elif text[start] in "!\"'),.:;?]}" or text[start] in "([{" and partner(start, 1) is None:
            start += 1
        elif text[stop] in "!\"'(,.:;?[{" or text[stop] in ")]}" and partner(stop, -1) is None:
            stop -= 1
        else:
            break
    return start, stop


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab()[]{}.\"!", min_size=1, max_size=9), min_size=1, max_size=8))
def test_trim(spans):
    text = "".join(spans)
    stop = np.cumsum([len(x) for x in spans]) - 1
    start = np.concatenate([[0], stop[:-1] + 1])
    got = trim(np.frombuffer(text.encode(), np.uint8), start, stop)
    assert list(zip(*(x.tolist() for x in got))) == [shrunk(text, a, z) for a, z in zip(start.tolist(), stop.tolist())]


def test_trim_by_hand():
    for text, want in (('foo."', (0, 2)), ('"(foo', (2, 4)), ("(a)", (1, 1)), ("a (b)", (0, 4))):
        got = trim(np.frombuffer(text.encode(), np.uint8), np.array([0]), np.array([len(text) - 1]))
        assert tuple(int(x[0]) for x in got) == want


def test_cleaning(spark):
    rows = D.names_with_entities(
        spark.createDataFrame([(1, "foo"), (2, "foo"), (3, "a"), (4, "abc")], "serial bigint, name string"),
        spark.createDataFrame([(1, 9606, "x"), (2, -1, "y"), (3, -25, "z"), (4, -11, "w")], "serial bigint, type int, identifier string"),
    )
    log = D.cleaning_log(rows)
    got = sorted(((r.reason, r.name, r.type, r.serial, r["count"], r.masked_type, r.masked_serial) for r in log.collect()), key=str)
    assert got == [("CONFLICT", "foo", -1, 2, 1, 9606, 1), ("SHORT-NAME", "a", -25, 3, 1, None, None), ("SHORT-WIKI", "abc", -11, 4, 1, None, None)]
    names = spark.createDataFrame([(1, "foo"), (2, "FOO"), (2, "bar")], "serial bigint, name string")
    assert sorted((r.serial, r.name) for r in D.cleaned_names(names, log).collect()) == [(1, "foo"), (2, "bar")]


def test_markup(spark):
    text = '<html><head><title>abcd</title></head><p class="abcd">abcd</p> <b>ab</b>cd abcd</html>'
    documents = spark.createDataFrame([(1, text)], "doc_id int, text string")
    hidden = masked(documents, "Annotation")
    known = words(spark, [(1, "abcd"), (2, "abcd efgh")], {1: 5, 2: 5})
    found = find_mentions(with_blocked(dictionary_hits(candidate_windows(hidden.select("doc_id", "text"), known), known)))
    assert [text[a : b + 1] for a, b, _ in spans(found)] == ["abcd", "abcd"]
    html = annotated(documents, found, hidden).collect()[0].html
    assert html.count('<span class="tagger_match"') == 2 and html.count("</html>") == 1 and "<b>ab</b>cd" in html


def test_forms(spark):
    documents = spark.createDataFrame([(1, "é abcd, abcd & efgh")], "doc_id int, text string")
    known = words(spark, [(1, "abcd"), (2, "efgh")], {1: 9606, 2: -26})
    found = find_mentions(with_blocked(dictionary_hits(candidate_windows(documents, known), known)))
    assert sorted(r.line for r in entity_lines(mention_rows(found)).collect()) == ["abcd\t9606\t1", "efgh\t-26\t2"]
    assert distinct_entities(mention_rows(found)).count() == 2
    xml = entities_xml(found).collect()[0].xml
    assert xml.count("<item>") == 2 and '<count xsi:type="xsd:int">2</count>' in xml
    assert '"target":"1#char=2,6"' in jsonld(documents, found).collect()[0].json
    assert jsonld(documents, found, 2).collect()[0].json.endswith('"body":{"@id":"_:2"},"target":"1#char=15,19"}')


def test_border_crossing_mentions_are_dropped(spark):
    parts = spark.createDataFrame([(1, 1, 1, 0, 5), (1, 1, 2, 7, 9)], "doc_id int, paragraph int, sentence int, begin int, end int")
    found = spark.createDataFrame([(1, 0, 4, "a"), (1, 4, 5, "b"), (1, 5, 6, "c"), (1, 7, 8, "d"), (2, 0, 1, "e")], "doc_id int, start int, stop int, text string")
    assert sorted(r.text for r in inside_segments(found, parts).collect()) == ["a", "d"]
    assert whole_documents(spark.createDataFrame([(1, "é")], "doc_id int, text string")).collect()[0]["end"] == 2


def test_empty_and_null_documents(spark):
    known = words(spark, [(1, "abcd")], {1: 5})
    documents = spark.createDataFrame([(1, None), (2, ""), (3, "\0"), (4, "abcd " * 3)], "doc_id int, text string")
    found = find_mentions(with_blocked(dictionary_hits(candidate_windows(documents, known), known)))
    assert [r.doc_id for r in found.collect()] == [4, 4, 4]
    assert segments(documents.limit(2)).count() == 0


def test_promotion_and_log(spark):
    rows = [(k, "BlockName", "x", str(k)) for k in range(5)] + [(9, "AllowName", "x", "1"), (10, "BlockName", "y", "1")]
    local, everywhere = D.edited(spark.createDataFrame(rows, "at int, action string, name string, doc_id string"))
    assert {(r.name, r.doc_id, r.blocked) for r in local.collect() if r.doc_id == "1"} == {("x", "1", False), ("y", "1", True)}
    assert [r.name for r in everywhere.collect()] == ["x"]


def test_long_documents_are_linear(spark):
    # 100,000 mentions in a document: selection, disambiguation and the annotated page each are one pass.
    n = 100_000
    windows = spark.range(n).select(
        F.lit(1).alias("doc_id"), F.lit(0).alias("seg"), F.col("id").cast("int").alias("i"), (F.col("id") + F.col("id") % 2).cast("int").alias("j"), F.lit(False).alias("is_stub"),
        (F.col("id") * 5).cast("int").alias("start"), (F.col("id") * 5 + 3 + 5 * (F.col("id") % 2)).cast("int").alias("stop"), F.lit("abcd").alias("text"),
        F.expr("array(named_struct('type', 1, 'serial', id, 'identifier', 'x'), named_struct('type', 1, 'serial', id + 1, 'identifier', 'y'))").alias("entities"),
    )
    leftmost_longest(windows.limit(10)).count()  # workers start
    began = time.perf_counter()
    assert leftmost_longest(windows).count() == n // 2 + 1
    matches = windows.select("doc_id", F.col("i").alias("ord"), "start", (F.col("start") + 3).alias("stop"), "text", "entities")
    assert disambiguated(matches).select(F.sum(F.size("entities"))).first()[0] == 3 * n // 2
    text = spark.createDataFrame([(1, "abcd " * n)], "doc_id int, text string")
    assert annotated(text, matches).select(F.length("html")).first()[0] > 40 * n
    assert time.perf_counter() - began < 30


def pairs_by_hand(rows):
    """Per document the first mentions in each scope, pair by pair."""
    out = {k: Counter() for k in ("document", "paragraph", "sentence")}
    for doc in {r[0] for r in rows if r[0] is not None}:
        for level, size in (("document", 1), ("paragraph", 2), ("sentence", 3)):
            first = {}
            for r in rows:
                if r[0] == doc and r[4] is not None and None not in r[1:size]:
                    scope = first.setdefault(r[1:size], {})
                    scope[r[4]] = min(r[3], scope.get(r[4], 10**9))
            out[level].update({(a, b) for scope in first.values() for a, b in combinations(sorted(scope), 2) if scope[a] != scope[b]})
    return {(level, *p, k) for level, c in out.items() for p, k in c.items()}


@pytest.mark.parametrize("block", [512, 4])
def test_pairs_equal_brute_force(spark, monkeypatch, block):
    from termloom.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", block)  # 4: most documents are cut into blocks
    monkeypatch.setattr(pairs, "AT_ONCE", 50)
    rng = random.Random(block)
    rows = [(d, rng.choice([1, 2, None]), rng.choice([1, 2, 3]), rng.randint(0, 12), rng.randint(1, 15)) for d in range(12) for _ in range(rng.choice([1, 8, 30]))]
    rows += [(None, 1, 1, 0, 5), (3, 1, 1, 0, None), *rows[:5]]
    counts = pair_counts(spark.createDataFrame(rows, "doc_id int, paragraph int, sentence int, ord int, serial bigint"))
    assert {tuple(r) for r in pair_levels(counts).select("level", "serial1", "serial2", "documents").collect()} == pairs_by_hand(rows)
    sums = {(r.serial1, r.serial2): r.s_ij for r in pair_sums(counts, 0.0, 0.0, 3.0).collect()}
    assert sums == {(a, b): 3.0 * k for level, a, b, k in pairs_by_hand(rows) if level == "sentence"}


def test_pairs_of_nothing(spark):
    assert pair_counts(spark.createDataFrame([], "doc_id int, paragraph int, sentence int, ord int, serial bigint")).count() == 0


def test_positions_in_characters(spark):
    documents = spark.createDataFrame([(1, "aé中b"), (2, None)], "doc_id int, text string")
    spans = spark.createDataFrame([(1, 0, 0), (1, 0, 2), (1, 3, 6), (1, 6, 6), (1, 5, 99), (2, 0, 0), (3, 0, 0)], "doc_id int, start int, stop int")
    got = {(r.start, r.stop): (r.begin, r.end, r.aligned) for r in character_spans(documents, spans).collect()}
    assert got == {(0, 0): (0, 1, True), (0, 2): (0, 2, False), (3, 6): (2, 4, True), (6, 6): (3, 4, True)}


def test_replay_of_a_change_log(spark):
    rows = D.names_with_entities(spark.createDataFrame([(1, "abcd")], "serial bigint, name string"), spark.createDataFrame([(1, 5, "A")], "serial bigint, type int, identifier string"))
    acts = [(1, "AddName", "efgh", "7", "12"), (2, "AddName", "efgh", "7", "12"), (3, "BlockName", "abcd", None, None), (4, "AllowName", "abcd", None, None), (5, "BlockName", "efgh", "", None)]
    more, local, everywhere = D.replayed(rows, spark.createDataFrame(acts, "at int, action string, name string, doc_id string, identifier string"))
    assert sorted((r.name, r.type, r.serial) for r in more.collect()) == [("abcd", 5, 1), ("efgh", 7, 12)]
    assert local.count() == 0 and {(r.name, r.blocked) for r in everywhere.collect()} == {("abcd", False), ("efgh", True)}


def test_service_forms(spark):
    known = words(spark, [(1, "abcd"), (2, "abcd"), (3, "abcd")], {1: 9606, 2: -26, 3: 10090})
    asked = spark.createDataFrame([("ABCD",), ("none",), (None,)], "name string")
    found = D.resolve_names(asked, known)
    assert sorted(r.line for r in resolved_lines(found).collect()) == ["ABCD\t-26\t2", "ABCD\t10090\t3", "ABCD\t9606\t1"]
    items = {r.name: r.item for r in resolved_xml(asked, found).collect()}
    assert items["ABCD"].count("<entity>") == 3 and items["none"].endswith("<entities></entities></item>") and len(items) == 2
    assert {r.name: r.address for r in popup_addresses(asked, found, "https://x.example/p").collect()} == {"ABCD": "https://x.example/p?9606.1+10090.3+-26.2", "none": None}
    rows = match_tuples(given_matches(spark, [[(1, 5), (2, 6)], [(3, 7)]])).collect()
    assert rows[0].matches == [(0, 0, [(5, 1), (6, 2)]), (1, 1, [(7, 3)])]


def test_single_annotations(spark):
    documents = spark.createDataFrame([(1, "abcd efgé")], "doc_id int, text string")
    known = words(spark, [(1, "abcd"), (2, "efgé")], {1: 9606, 2: -26})
    found = find_mentions(with_blocked(dictionary_hits(candidate_windows(documents, known), known)))
    # The second mention ends inside of a character's bytes and isn't counted.
    assert jsonld(documents, found, 0, named=False).collect()[0].json.endswith('"@id":"_:annotations/0","body":{"@id":"stringdb:9606.1"},"target":"_:#char=0,4"}')
    assert jsonld(documents, found, 1).collect()[0].json.endswith('"@id":"_:annotations/1"}')


def recorder():
    class Recorder(DocumentHandler):
        def __init__(self):
            self.n = 0

        def say(self, what):
            self.n += 1
            return [(self.n, what)]

        def on_document_begin(self, doc_id, text):
            return self.say(f"document {doc_id}")

        def on_document_end(self, doc_id):
            return self.say("end")

        def on_paragraph_begin(self):
            return self.say("paragraph")

        def on_sentence_begin(self):
            return self.say("sentence")

        def on_match(self, doc_id, start, stop, text, entities):
            return self.say(f"{text} {entities[0][1]}")

    return Recorder


def test_handlers(spark):
    documents = spark.createDataFrame([(1, M1_TEXT), (2, "Nothing here.")], "doc_id int, text string").coalesce(1)
    matches = tag(spark, M1_TEXT, M1_NAMES, M1_TYPES)
    rows = handled(documents, matches, recorder(), "n int, what string", segments(documents)).collect()
    said = [r.what for r in sorted((r for r in rows), key=lambda r: r.n)] if len({r.n for r in rows}) == len(rows) else [r.what for r in rows]
    text = " | ".join(said)
    assert "document 1 | paragraph | sentence | TIMP1 101 | PLK1 102 | paragraph | sentence | ATM-kinase 103 | end" in text
    assert "document 2 | paragraph | sentence | end" in text
    assert [r.what for r in handled(documents, matches, recorder(), "n int, what string").collect() if "10" in r.what] == ["TIMP1 101", "PLK1 102", "ATM-kinase 103"]


def test_bitmap_lets_few_strange_hashes_through(spark):
    names = spark.createDataFrame([(f"name {n} x",) for n in range(5000)], "name string")
    bitmap = dictionary_bitmap(names)
    own, strange = (hash_strings(pa.array([f"{word}{n}X" for n in range(20000)], pa.large_string())) for word in ("NAME", "OTHER"))
    assert bitmap.has(own[:5000]).all()
    assert bitmap.has(strange).mean() < 0.005  # a single bit a name: 0.02 to 0.04


def test_bytes_as_tokens(spark):
    rows = [(1, "aé"), (1, "b"), (2, None), (3, ""), (4, "x\0y")]
    found = byte_tokens(spark.createDataFrame(rows, "doc_id int, text string"))
    assert "Join" not in found._jdf.queryExecution().toString()
    got = sorted(map(tuple, found.collect()))
    assert got == [(1, 0, 0, 0, "61"), (1, 0, 0, 0, "62"), (1, 1, 1, 1, "C3"), (1, 2, 2, 2, "A9"), (4, 0, 0, 0, "78"), (4, 1, 1, 1, "00"), (4, 2, 2, 2, "79")]


AMBIGUOUS_NAMES = [(1, "ABC"), (2, "abc"), (3, "A-BC"), (4, "ABC kinase"), (5, "kinase"), (6, "kinase"), (7, "of ABC"), (8, "retina"), (9, "PLK1"), (1, "PLK1")]
AMBIGUOUS_TYPES = {1: 9606, 2: -26, 3: 9606, 4: -26, 5: -26, 6: -1, 7: -1, 8: -26, 9: 10090}
AMBIGUOUS_STOPS = [("retina", "0"), ("kinase x", "t"), ("PLK1", "t"), ("abc", "t")]
AMBIGUOUS_TEXTS = [(1, "ABC kinase and (ABC) or abc, A-BC. ABC; PLK1 retina kinase"), (2, "kinase x of ABC kinase"), (3, ""), (4, "ABC ABC kinase kinase PLK1 of ABC")]


def ambiguous(spark, stops):
    """Mentions by the entities of each window, and windows with keys and rows of the dictionary, of the same texts."""
    documents = spark.createDataFrame(AMBIGUOUS_TEXTS, "doc_id int, text string")
    entities = spark.createDataFrame([(s, t, f"id{s % 8}") for s, t in AMBIGUOUS_TYPES.items()], "serial bigint, type int, identifier string")
    rows = D.names_with_entities(spark.createDataFrame(AMBIGUOUS_NAMES, "serial bigint, name string"), entities)
    given = spark.createDataFrame(AMBIGUOUS_STOPS, "name string, flag string") if stops else None
    words, heads = D.dictionary(rows, given), D.heads(rows, given)
    windows, listed = candidate_windows(documents, words), D.stop_list(given) if stops else None
    assert sorted(map(tuple, heads.select("key", "name", "is_stub").collect())) == sorted(map(tuple, words.select("key", "name", "is_stub").collect()))
    return with_blocked(dictionary_hits(windows, words), listed), with_blocked(heads_hit(windows, heads), listed), rows


@pytest.mark.parametrize("stops", [False, True])
@pytest.mark.parametrize("types", [(), (0, -26)])
def test_mentions_by_key(spark, stops, types):
    hits, keyed, rows = ambiguous(spark, stops)
    columns = ("doc_id", "start", "stop", "text", "type", "serial", "identifier")
    sets = lambda df: sorted(map(repr, df.select(*columns).collect()))
    found = found_keys(keyed, types)
    assert "entities" not in found._jdf.queryExecution().toString()
    assert sets(keyed_rows(found, rows, types)) == sets(mention_rows(find_mentions(hits, types))) != []
    overlap = mention_rows(find_mentions(hits, types, allow_overlap=True))
    assert sets(keyed_rows(overlapping_keys(keyed, types), rows, types)) == sets(overlap)
    wanted_rows = rows.where(wanted(F.col("type"), F.array(*map(F.lit, types)).cast("array<int>")))
    assert sorted(map(tuple, distinct_keyed(found, wanted_rows).collect())) == sorted(map(tuple, distinct_entities(mention_rows(find_mentions(hits, types))).collect()))
    assert sets(mention_rows(with_entities(found, wanted_rows))) == sets(mention_rows(find_mentions(hits, types)))


def test_groups_meet_only_entities_that_have_some(spark):
    matches = spark.createDataFrame([(1, 0, 0, 2, "ABC", [(-26, 1, None), (-26, 2, None)]), (1, 1, 4, 6, "DEF", [(-26, 3, None)]), (2, 0, 0, 2, "ABC", [(-26, 2, None)])], f"doc_id int, ord int, start int, stop int, text string, entities {ENTITY}")
    groups = spark.createDataFrame([(1, 10), (2, 10), (2, 11)], "child bigint, parent bigint")
    found = grouped(matches, groups)
    got = {(r.doc_id, r.ord): [e.serial for e in r.entities] for r in found.collect()}
    assert got == {(1, 0): [1, 2, 10], (1, 1): [3], (2, 0): [2, 10, 11]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "first(text" not in plan  # texts were copied for each entity, and put together again
