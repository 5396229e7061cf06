"""The tagging queries as SQL, from the rules and not from the operators' code."""

from __future__ import annotations

from termloom.plans import fixtures as X

_S, _P = r"\t\n\r _\-", r"!\"''(),.:;?\[\]{}"
_AZ, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key_of(s: str) -> str:
    c = f"regexp_replace({s}, '^[{_P}]+', '')"
    rest = f"regexp_replace({c}, '^[{_S}]+', '')"
    middle = f"regexp_replace(regexp_extract({rest}, '(?s)^(.*[^{_P}{_S}])', 1), '[{_S}]', '', 'g')"
    tail = f"regexp_replace(regexp_extract({rest}, '([{_P}{_S}]*)\\z', 1), '[{_P}]+\\z', '')"
    return f"(regexp_extract({c}, '^([{_S}]*)', 1) || chr(1) || translate({middle}, '{_AZ}', '{_UP}') || chr(1) || {tail})"


# Fixed value: the pattern of names that are no names, as in ``matching``; the fixtures' list of names shows what it blocks.
_Z = r"[\n\r\f]*\z"
_STOP = (
    r"(?s)\A&|\A(.{0,2}|.[ \t\r\n-]+.|[^A-Za-z]*([ \t\r\n]|" + _Z + r")|[ACDEFGHIKLMNPQRSTVWY]-?[0-9]{1,4}|[Oo][Rr][ -]*[0-9]+|[CJnsXx][ -]*[0-9.-]+"
    r"|[0-9]{1,4}[A-Za-z]|[0-9.-]+[ -]*[cGkMmnp]?[ABbdghLlMmSsVXx]\(?[0-9-]*\)?|[0-9] .{2,9})" + _Z
    + r"|\A([DGNSTdgnst]o|[Aa][nst]?|[Aa]nd|[Aa]re|[Bb][ey]|[Bb]ut|[Cc]an|[Dd]id|[Ff]or|[Hh]a[ds]|[Hh]ave|[Ii][fnst]|[Ii]ts|[Oo][fnr]|s|[Tt]he|[Tt]his|[Ww]as|[Ww]ere)[ \t\r\n]"
    r"|[ \t\r\n]([dgs]o|are|but|can|did|et|ha[ds]|have|i[fst]|its|this|was|were)[ \t\r\n]"
    r"|[ \t\r\n]([dgnst]o|a[nst]?|and|are|b[ey]|but|can|did|et|for|ha[ds]|have|i[fnst]|its|o[fnr]|the|this|was|were)" + _Z
)


def blocked(s: str) -> str:
    return f"regexp_matches({s}, '{_STOP}')"


_DOCS = r"""
docs AS (
  SELECT doc_id, coalesce(f.title, '') || chr(9) || coalesce(f.text, '') AS text FROM (
    SELECT doc_id, arg_min(struct_pack(title := title, text := text), row_id) AS f FROM (
      SELECT row_id, title, text, coalesce(try_cast(regexp_extract(regexp_extract(identifier, '^[^:|\t]*:([^|\t]*)', 1), '^\s*([+-]?\d+)', 1) AS INTEGER), 0) AS doc_id FROM test_documents)
    WHERE doc_id <> 0 GROUP BY doc_id)
)"""
_NAME_ROWS = f"""
known AS (
  SELECT serial, e.type AS type, e.identifier AS identifier FROM (
    SELECT serial, max(struct_pack(type := type, identifier := identifier)) AS e FROM test_entities WHERE serial IS NOT NULL AND type IS NOT NULL GROUP BY serial)
), name_rows AS (
  SELECT k.key, min(k.name) AS name, known.type, k.serial, known.identifier
  FROM (SELECT {key_of("name")} AS key, name, serial FROM names WHERE serial IS NOT NULL AND name IS NOT NULL AND name <> '') k JOIN known USING (serial)
  GROUP BY ALL
)"""
_NAME_ROWS = _NAME_ROWS.replace("GROUP BY ALL\n", "GROUP BY k.key, k.serial, known.type, known.identifier\n")

_PIECES = r"""
pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS n FROM (
    SELECT doc_id, regexp_extract_all(text, '([*\-]+|[\t\n\r !''()+,./:;?\[\]_{|}]+|[^*\-\t\n\r !''()+,./:;?\[\]_{|}]+)') AS p FROM docs)
), placed AS (
  SELECT doc_id, n, piece, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY n) - strlen(piece) AS start,
    sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n) - length(piece) AS place FROM pieces
), token AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS i, CAST(start AS INTEGER) AS start,
    CAST(start + strlen(piece) - 1 AS INTEGER) AS stop, piece AS token, CAST(place AS INTEGER) AS place
  FROM placed WHERE NOT regexp_matches(piece, '^[\t\n\r !''()+,./:;?\[\]_{|}]')
)"""


def _hits(docs: str = _DOCS, names: str = _NAME_ROWS, key: str = key_of("raw.span"), known: str = "SELECT DISTINCT key FROM name_rows", within: str = "true") -> str:
    """Hits (doc_id, i, j, start, stop, text, key, place), with quotation marks off the ends of the surface; ``key`` is that of a window in ``raw``, ``within`` a condition on it."""
    return f"""
{docs}, {names}, {_PIECES},
raw AS (
  SELECT a.doc_id, a.i, b.i AS j, a.start, b.stop, a.place, substr(d.text, a.place + 1, b.place + length(b.token) - a.place) AS span
  FROM token a JOIN token b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 14 JOIN docs d ON d.doc_id = a.doc_id
), keyed AS (SELECT raw.*, {key} AS own FROM raw WHERE {within}
), hit AS (
  SELECT keyed.*, strlen(span) - strlen(regexp_replace(span, '^[!"''),.:;?\\]}}]+', '')) AS cut_left,
    strlen(span) - strlen(regexp_replace(span, '[!"''(,.:;?\\[{{]+\\z', '')) AS cut_right, k.key
  FROM keyed JOIN ({known}) k ON k.key = keyed.own
), trimmed AS (
  SELECT doc_id, i, j, CAST(start + cut_left AS INTEGER) AS start, CAST(stop - cut_right AS INTEGER) AS stop, key, place + cut_left AS place,
    substr(span, 1 + cut_left, length(span) - cut_left - cut_right) AS text
  FROM hit
)"""


def _chain(ends: str, tag: str = "") -> str:
    """The windows that are taken from left to right, the longest at each token: ``chosen``. ``ends`` has a column ``stub``: a stub is passed over by a token."""
    return f"""
longest{tag} AS (
  SELECT doc_id, i, max(j) AS j, arg_max(struct_pack(start := start, stop := stop, text := text, key := key, stub := stub, place := place), j) AS w FROM {ends} GROUP BY doc_id, i
), linked{tag} AS (
  SELECT l.*, (SELECT min(m.i) FROM longest{tag} m WHERE m.doc_id = l.doc_id AND m.i > CASE WHEN l.w.stub THEN l.i ELSE l.j END) AS following FROM longest{tag} l
), walked{tag} AS (
  SELECT l.* FROM linked{tag} l WHERE NOT EXISTS (SELECT 1 FROM linked{tag} m WHERE m.doc_id = l.doc_id AND m.i < l.i)
  UNION ALL
  SELECT l.* FROM walked{tag} c JOIN linked{tag} l ON l.doc_id = c.doc_id AND l.i = c.following
), chosen{tag} AS (SELECT doc_id, i, j, unnest(w) FROM walked{tag} WHERE NOT w.stub
)"""


_REQUESTED = "n.type IN (SELECT type FROM test_types)"


def _mentions(wanted: str = "true", hits: str | None = None) -> str:
    """Up to ``mention``: the leftmost longest mentions with their entities of the ``wanted`` types."""
    return f"""WITH RECURSIVE {hits or _hits()}, ends AS (
  SELECT *, false AS stub FROM trimmed t WHERE NOT {blocked("text")} AND EXISTS (SELECT 1 FROM name_rows n WHERE n.key = t.key AND {wanted})
), {_chain("ends")}, mention AS (
  SELECT doc_id, start, stop, text, place, n.type, n.serial, n.identifier FROM chosen JOIN name_rows n USING (key) WHERE {wanted}
)"""


_ANY, _TYPED = _mentions(), _mentions(_REQUESTED)
_FLAT = " SELECT doc_id, start, stop, text, type, serial FROM "

#: Stop lists: of the document, else of all, else the pattern; a listed name that the dictionary lacks is a stub.
_STOPPED = f"""WITH RECURSIVE {_hits(known=f"SELECT DISTINCT key FROM name_rows UNION SELECT {key_of('name')} FROM {X.values(X.STOP_GLOBAL, 'name', 'flag')}")}, listed AS (
  SELECT t.*, NOT EXISTS (SELECT 1 FROM name_rows n WHERE n.key = t.key) AS stub,
    coalesce(l.flag[1] IN ('1', 't', 'y'), g.flag[1] IN ('1', 't', 'y'), {blocked("t.text")}) AS is_blocked
  FROM trimmed t LEFT JOIN {X.values(X.STOP_LOCAL, 'name', 'doc_id', 'flag')} l ON l.name = t.text AND l.doc_id = CAST(t.doc_id AS VARCHAR)
    LEFT JOIN {X.values(X.STOP_GLOBAL, 'name', 'flag')} g ON g.name = t.text
), ends AS (SELECT * FROM listed WHERE stub OR NOT is_blocked
), {_chain("ends")}"""

_DETECTED_NAMES = _NAME_ROWS.replace("known.type, k.serial", "CASE WHEN known.type = -2 THEN -3 ELSE known.type END AS type, k.serial")
_DETECTED = f"""WITH RECURSIVE {_hits(names=_DETECTED_NAMES)}, free AS (
  SELECT *, false AS stub FROM trimmed WHERE NOT {blocked("text")}
), triggers AS (SELECT * FROM free t WHERE EXISTS (SELECT 1 FROM name_rows n WHERE n.key = t.key AND n.type = -3)
), {_chain("triggers", "_first")}, doc_types AS (
  SELECT DISTINCT doc_id, [{", ".join(map(str, X.TAXA))}][serial % {len(X.TAXA)} + 1] AS type FROM chosen_first JOIN name_rows USING (key) WHERE type = -3
), allowed AS (
  SELECT t.*, n.type, n.serial FROM free t JOIN name_rows n USING (key)
  WHERE n.type = -26 OR (t.doc_id, n.type) IN (SELECT doc_id, type FROM doc_types)
), {_chain("allowed")}
SELECT DISTINCT c.doc_id, c.start, c.stop, c.text, a.type, a.serial FROM chosen c JOIN allowed a ON a.doc_id = c.doc_id AND a.i = c.i AND a.j = c.j"""

#: Mentions numbered in a document with the list of their entities, and what disambiguation leaves of it: the entities named so far.
_CLEAR = """, matches AS (
  SELECT doc_id, start, stop, text, list(struct_pack(type := type, serial := serial)) AS entities, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS ord
  FROM mention GROUP BY doc_id, start, stop, text
), single AS (SELECT doc_id, list(entities[1].serial) AS seen FROM matches WHERE len(entities) = 1 GROUP BY doc_id
), told AS (
  SELECT m.doc_id, 0::BIGINT AS ord, coalesce(s.seen, []) AS seen, NULL::STRUCT("type" INTEGER, serial BIGINT)[] AS left_
  FROM (SELECT DISTINCT doc_id FROM matches) m LEFT JOIN single s USING (doc_id)
  UNION ALL
  SELECT m.doc_id, m.ord,
    CASE WHEN len(list_filter(m.entities, lambda e: list_contains(t.seen, e.serial))) = 0 THEN list_concat(t.seen, list_transform(m.entities, lambda e: e.serial)) ELSE t.seen END,
    CASE WHEN len(list_filter(m.entities, lambda e: list_contains(t.seen, e.serial))) = 0 THEN m.entities ELSE list_filter(m.entities, lambda e: list_contains(t.seen, e.serial)) END
  FROM told t JOIN matches m ON m.doc_id = t.doc_id AND m.ord = t.ord + 1
), clear AS (
  SELECT m.doc_id, m.ord, start, stop, text, unnest(left_).type AS type, unnest(left_).serial AS serial FROM matches m JOIN told t ON t.doc_id = m.doc_id AND t.ord = m.ord
)"""

#: Of each mention the entities of the types more frequent in the document than the least threshold at which they share a group or one is left.
_GROUPED = f""", counts AS (SELECT doc_id, type, count(*) AS n FROM clear GROUP BY ALL
), entity AS (SELECT c.*, n FROM clear c JOIN counts USING (doc_id, type)
), threshold AS (SELECT DISTINCT doc_id, ord, n AS t FROM entity UNION SELECT DISTINCT doc_id, ord, 0 FROM entity
), remaining AS (SELECT e.*, t FROM entity e JOIN threshold h ON h.doc_id = e.doc_id AND h.ord = e.ord AND e.n > t
), sizes AS (SELECT h.doc_id, h.ord, h.t, count(r.serial) AS size FROM threshold h LEFT JOIN remaining r USING (doc_id, ord, t) GROUP BY ALL
), parents AS (
  SELECT doc_id, ord, t, parent, count(*) AS n FROM remaining r JOIN {X.values(X.GROUPS, 'child', 'parent')} g ON g.child = r.serial GROUP BY ALL
), shared AS (SELECT doc_id, ord, t, parent FROM parents JOIN sizes USING (doc_id, ord, t) WHERE n = size
), pick AS (
  SELECT doc_id, ord, min(t) AS t FROM sizes s WHERE size <= 1 OR EXISTS (SELECT 1 FROM shared x WHERE x.doc_id = s.doc_id AND x.ord = s.ord AND x.t = s.t) GROUP BY ALL
), spots AS (SELECT DISTINCT doc_id, ord, start, stop, text FROM clear
), kinds AS (SELECT serial, max(type) AS type FROM test_entities WHERE serial IS NOT NULL AND type IS NOT NULL GROUP BY serial)
SELECT doc_id, start, stop, text, type, serial FROM remaining JOIN pick USING (doc_id, ord, t)
UNION ALL SELECT doc_id, start, stop, text, coalesce(k.type, 0), parent FROM shared JOIN pick USING (doc_id, ord, t) JOIN spots USING (doc_id, ord) LEFT JOIN kinds k ON k.serial = parent"""

#: Paragraphs (characters from ``opens`` to ``ends``), the places in them that may end a sentence, and the sentences from one accepted place to the next.
_SEGMENTS = r"""
paragraphs AS (
  SELECT doc_id, 0 AS number, -1 AS opens, 0 AS ends FROM docs WHERE text <> ''
  UNION ALL
  SELECT p.doc_id, p.number + 1, p.ends + strlen(lead), p.ends + strlen(lead) + length(regexp_extract(substr(d.text, p.ends + strlen(lead) + 1), '^[^\t]*'))
  FROM paragraphs p JOIN (SELECT doc_id, text FROM docs) d USING (doc_id), LATERAL (SELECT regexp_extract(substr(d.text, p.ends + 1), '^[\t\n\r ]*') AS lead) WHERE p.ends < length(d.text)
), paragraph AS (
  SELECT p.doc_id, number, opens, ends, substr(text, opens + 1, ends - opens) AS body, strlen(substr(text, 1, opens)) AS byte, text FROM paragraphs p JOIN docs USING (doc_id) WHERE number > 0
), place AS (
  SELECT *, unnest(range(1, length(body) + 1)) AS pos FROM paragraph
), candidate AS (
  SELECT doc_id, number, opens, pos - 1 AS mark, strlen(substr(body, 1, pos - 1)) AS mark_byte, substr(body, pos, 1) AS sign, substr(text, greatest(1, opens + pos - 6), least(6, opens + pos - 1)) AS before,
    length(regexp_extract(substr(body, pos), '^([.!?]+["'')]*)[ \n\r]', 1)) AS closed, length(regexp_extract(substr(body, pos), '^([.!?]+["'')]*[ \n\r]+["''(]*[ \n\r]*-?)[0-9A-Z]', 1)) AS behind, body
  FROM place WHERE substr(body, pos, 1) IN ('.', '!', '?') AND (pos = 1 OR substr(body, pos - 1, 1) NOT IN ('.', '!', '?'))
), border AS (
  SELECT doc_id, number, mark, mark_byte, strlen(substr(body, 1, mark + closed)) AS end_byte, strlen(substr(body, 1, mark + behind)) AS next_byte,
    CASE WHEN sign <> '.' THEN 4 WHEN regexp_matches(before, '( [iI]\.e| [eE]\.g)\z') THEN 1000000000 WHEN regexp_matches(before, ' et al\z') THEN -6 ELSE 4 END AS least
  FROM candidate WHERE behind > 0
), begin AS (
  SELECT doc_id, number, 0 AS begin_byte FROM paragraph UNION SELECT doc_id, number, next_byte FROM border
), step AS (
  SELECT doc_id, number, begin_byte, min(mark_byte) AS mark_byte FROM begin b JOIN border x USING (doc_id, number)
  WHERE x.mark_byte - begin_byte >= 4 AND x.mark_byte >= begin_byte AND NOT (least = -6 AND x.mark_byte - begin_byte >= 6) AND least < 1000000000 GROUP BY ALL
), walk AS (
  SELECT doc_id, number, 0::BIGINT AS begin_byte, 1 AS sentence FROM paragraph
  UNION ALL
  SELECT w.doc_id, w.number, x.next_byte, w.sentence + 1 FROM walk w JOIN step s USING (doc_id, number, begin_byte) JOIN border x ON x.doc_id = s.doc_id AND x.number = s.number AND x.mark_byte = s.mark_byte
), finish AS (
  SELECT *, strlen(body) - strlen(regexp_extract(body, '(?:^|[^.!?])[.!?]+["'')]*([ \n\r]+["''(]*)\z', 1)) AS stop FROM paragraph
), segment AS (
  SELECT w.doc_id, w.number AS paragraph, w.sentence, byte + w.begin_byte AS begin, byte + coalesce(x.end_byte, t.stop) AS "end"
  FROM walk w JOIN finish t USING (doc_id, number) LEFT JOIN step s USING (doc_id, number, begin_byte) LEFT JOIN border x ON x.doc_id = s.doc_id AND x.number = s.number AND x.mark_byte = s.mark_byte
)"""
_PLACED = f"""{_CLEAR}, {_SEGMENTS}, structured AS (
  SELECT c.doc_id, g.paragraph, g.sentence, c.start, c.stop, c.text, c.type, c.serial FROM clear c JOIN segment g ON g.doc_id = c.doc_id AND c.start >= g.begin AND c.stop < g."end"
)"""

#: Documents and names as lines of files: without line breaks.
_FILE_DOCS = _DOCS.replace("|| coalesce(f.text, '') AS text", "|| coalesce(f.text, '') AS raw_text").replace("SELECT doc_id, coalesce(f.title", "SELECT doc_id, regexp_replace(raw_text, '[\\r\\n]', ' ', 'g') AS text FROM (SELECT doc_id, coalesce(f.title") + ")"
_FILE_NAMES = _NAME_ROWS.replace("FROM names WHERE", "FROM (SELECT serial, regexp_replace(name, '[\\t\\r\\n]', ' ', 'g') AS name FROM names) WHERE")
_FROM_FILES = _mentions(_REQUESTED, _hits(docs=_FILE_DOCS, names=_FILE_NAMES))

#: Texts that define acronyms of names, and windows that are looked up by the long form.
_SHORT = "upper(regexp_replace(name, '(?i)([a-z])[a-z]*[ -]?', '\\1', 'g'))"
_ACRONYM_DOCS = f"""
docs AS (
  SELECT name AS doc_id, {_SHORT} AS short, 'The ' || name || ' (' || {_SHORT} || ') binds ' || {_SHORT} || ' and ' || array_to_string(string_split({_SHORT}, ''), '-') || '.' AS text
  FROM (SELECT DISTINCT name FROM names WHERE regexp_matches(name, '{X.LONG_FORM}'))
)"""
_ACRONYM_KEY = f"""(SELECT CASE WHEN {key_of("raw.span")} = {key_of("d.short")} THEN {key_of("d.doc_id")} ELSE {key_of("raw.span")} END FROM docs d WHERE d.doc_id = raw.doc_id)"""
_SAID = _mentions(hits=_hits(docs=_ACRONYM_DOCS, key=_ACRONYM_KEY))

_IRI = """CASE WHEN type >= 0 THEN 'stringdb:' || type || '.' || id WHEN type = -1 THEN 'stitchdb:' || id WHEN type = -2 THEN 'taxonomy:' || id WHEN contains(id, ':') THEN id ELSE '_:' || id END"""

#: Mentions in characters, numbered in their document; those that end inside of a character are left out.
_ANNOTATED = f""", bodies AS (
  SELECT doc_id, start, place, text, list(json_object('@id', {_IRI}) ORDER BY type, serial, identifier) AS bodies
  FROM (SELECT *, coalesce(identifier, CAST(serial AS VARCHAR)) AS id FROM mention) WHERE strlen(right(text, 1)) = 1 GROUP BY doc_id, start, place, text
), annotated AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS n, CAST(place AS INTEGER) AS begin, CAST(place + length(text) AS INTEGER) AS "end",
    CASE WHEN len(bodies) = 1 THEN CAST(bodies[1] AS VARCHAR) ELSE '[' || array_to_string(bodies, ',') || ']' END AS body FROM bodies
)"""

#: Pages made of the documents: no mention crosses the tags that stand for a TAB; earlier ends of the page go.
_PAGES = _mentions(_REQUESTED, _hits(within="NOT contains(raw.span, chr(9))")) + """, spans AS (
  SELECT doc_id, place, text, string_agg(type || '.' || coalesce(identifier, CAST(serial AS VARCHAR)), ';' ORDER BY type, serial, identifier) AS list FROM mention GROUP BY doc_id, start, place, text
), cuts AS (
  SELECT *, place + length(text) AS ends, lag(place + length(text), 1, 0) OVER (PARTITION BY doc_id ORDER BY place) AS at_ FROM spans
), bodies AS (
  SELECT doc_id, string_agg(substr(d.text, at_ + 1, place - at_) || '<span class="tagger_match" style="" >' || p.text || '</span>', '' ORDER BY place) AS body, max(ends) AS ends
  FROM cuts p JOIN docs d USING (doc_id) GROUP BY doc_id
), lists AS (
  SELECT doc_id, string_agg('  <span name="' || md5(list) || '">' || list || '</span>' || chr(10), '' ORDER BY first) AS lists FROM (SELECT doc_id, list, min(place) AS first FROM spans GROUP BY doc_id, list) GROUP BY doc_id
), types AS (
  SELECT doc_id, string_agg('  <span>' || type || '</span>' || chr(10), '' ORDER BY type) AS types FROM (SELECT DISTINCT doc_id, type FROM mention) GROUP BY doc_id
)
SELECT doc_id, '<html><head><title>x</title></head><body><p class="a">' || replace(coalesce(body, '') || substr(d.text, coalesce(ends, 0) + 1), chr(9), '</p><p>')
  || '</p><div class="tagger_entities" style="display: none;">' || chr(10) || coalesce(lists, '') || '</div>' || chr(10)
  || '<div style="display: none;" class="tagger_entity_types">' || chr(10) || coalesce(types, '') || '</div>' || chr(10)
  || '<div style="display: none;" id="tagger_div_doi">' || doc_id || '</div>' || chr(10) || '<div name="annotation_v2" style="display: none;"></div>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS html
FROM docs d LEFT JOIN bodies USING (doc_id) LEFT JOIN lists USING (doc_id) LEFT JOIN types USING (doc_id)"""

_GIVEN = "m AS (SELECT DISTINCT doc, paragraph, sentence, start, serial FROM mentions WHERE doc IS NOT NULL AND serial IS NOT NULL)"
_PAIR_ITEMS = """
first AS (
  SELECT 'document' AS level, doc, NULL::INTEGER AS paragraph, NULL::INTEGER AS sentence, serial, min(start) AS f FROM m GROUP BY doc, serial
  UNION ALL SELECT 'paragraph', doc, paragraph, NULL, serial, min(start) FROM m GROUP BY doc, paragraph, serial
  UNION ALL SELECT 'sentence', doc, paragraph, sentence, serial, min(start) FROM m GROUP BY doc, paragraph, sentence, serial
), level_pairs AS (
  SELECT DISTINCT a.doc, a.level, a.serial AS serial1, b.serial AS serial2 FROM first a JOIN first b
  ON a.level = b.level AND a.doc = b.doc AND a.paragraph IS NOT DISTINCT FROM b.paragraph AND a.sentence IS NOT DISTINCT FROM b.sentence
    AND a.serial < b.serial AND a.f <> b.f
  WHERE a.level = 'document' OR (a.paragraph IS NOT NULL AND (a.level = 'paragraph' OR a.sentence IS NOT NULL))
)"""
_KINDS = """kinds AS (SELECT serial, max(type) AS type FROM test_entities WHERE serial IS NOT NULL AND type IS NOT NULL GROUP BY serial)"""


def _scores(allowed: str, mentions: str = f"WITH {_GIVEN}") -> str:
    return f"""
{mentions}, {_PAIR_ITEMS}, {_KINDS}, sums AS (
  SELECT serial1, serial2, sum(CASE level WHEN 'document' THEN 1.0::DOUBLE WHEN 'paragraph' THEN 2.0::DOUBLE ELSE 0.2::FLOAT::DOUBLE END) AS s_ij
  FROM level_pairs GROUP BY ALL
), typed AS (
  SELECT sums.*, coalesce(x.type, 0) AS type1, coalesce(y.type, 0) AS type2 FROM sums LEFT JOIN kinds x ON x.serial = serial1 LEFT JOIN kinds y ON y.serial = serial2
), kept AS (SELECT * FROM typed WHERE {allowed}
), sides AS (SELECT serial1 AS serial, type2 AS other, s_ij FROM kept UNION ALL SELECT serial2, type1, s_ij FROM kept
), part AS (SELECT serial, other, sum(s_ij) AS v FROM sides GROUP BY ALL
), total AS (SELECT least(type1, type2) AS lo, greatest(type1, type2) AS hi, sum(s_ij) AS s FROM kept GROUP BY ALL
), full_rows AS (
  SELECT k.serial1, k.serial2, s, i.v AS s_i, j.v AS s_j, s_ij, s_ij * s / (i.v * j.v) AS ratio FROM kept k
  JOIN total ON lo = least(type1, type2) AND hi = greatest(type1, type2)
  JOIN part i ON i.serial = serial1 AND i.other = type2 JOIN part j ON j.serial = serial2 AND j.other = type1
)
SELECT serial1, serial2, round(pow(s_ij, 0.6::FLOAT::DOUBLE) * pow(ratio, 1 - 0.6::FLOAT::DOUBLE), 6) AS score, round(ratio, 6) AS ratio,
  round(s, 6) AS s, round(s_i, 6) AS s_i, round(s_j, 6) AS s_j, round(s_ij, 6) AS s_ij FROM full_rows"""


_STRINGS = X.values(tuple((s,) for s in X.STRINGS), "name") + " UNION SELECT DISTINCT name FROM names WHERE name IS NOT NULL"
_SKELETON = f"translate(regexp_replace(name, '[{_S}{_P}]', '', 'g'), '{_AZ}', '{_UP}')"
_LOG = f"""
WITH {_NAME_ROWS}, counted AS (
  SELECT key, min(name) OVER (PARTITION BY key) AS name, type, serial, count(*) OVER (PARTITION BY key, type) AS count FROM name_rows
), family AS (
  SELECT *, max(CASE WHEN type >= 0 THEN count END) OVER (PARTITION BY key) AS largest FROM counted
), log AS (
  SELECT 'CONFLICT' AS reason, f.key, f.name, f.type, f.serial, f.count, m.type AS masked_type, m.serial AS masked_serial FROM family f JOIN name_rows m ON m.key = f.key
  WHERE f.type NOT IN (-2, -3, -21, -22, -23, -25, -26, -27) AND (m.type >= 0 OR m.type IN (-2, -22, -25, -26, -27)) AND f.type <> m.type AND (f.type < 0 OR m.type < 0)
  UNION ALL SELECT CASE WHEN largest >= 1000 THEN 'FAMILY-GLOBAL' ELSE 'FAMILY-LOCAL' END, key, name, type, serial, count, NULL, NULL FROM family WHERE largest >= 1000 OR count > 20
  UNION ALL SELECT 'SHORT-NAME', key, name, type, serial, count, NULL, NULL FROM family WHERE strlen(name) < 2
  UNION ALL SELECT 'SHORT-WIKI', key, name, type, serial, count, NULL, NULL FROM family WHERE type = -11 AND strlen(name) <= 3
)"""

ORACLES = {
    "canonical_keys": f"SELECT name, hex({key_of('name')}) AS key, hex({_SKELETON}) AS skeleton FROM ({_STRINGS})",
    "stop_filter": f"SELECT name, {blocked('name')} AS blocked FROM ({_STRINGS})",
    "dictionary_load": f"WITH {_NAME_ROWS} SELECT hex(key) AS key, name, type, serial, identifier FROM name_rows",
    "stub_names": f"WITH {_NAME_ROWS} SELECT name, 0 AS type FROM {X.values(X.STOP_GLOBAL, 'name', 'flag')} s WHERE {key_of('s.name')} NOT IN (SELECT key FROM name_rows)",
    "tokenize_documents": f"WITH {_DOCS}, {_PIECES} SELECT doc_id, i, start, stop, token FROM token",
    "tokenize_characters": """SELECT row_id AS doc_id, CAST(n AS INTEGER) AS i, CAST(n AS INTEGER) AS start, CAST(n AS INTEGER) AS stop, substr(hex(title), 2 * n + 1, 2) AS byte
    FROM (SELECT row_id, title, unnest(range(strlen(title))) AS n FROM test_documents)""",
    "mentions_longest": _ANY + _FLAT + "mention",
    "mentions_typed": _TYPED + _FLAT + "mention",
    "mentions_overlap": _ANY + " SELECT doc_id, start, stop, text, n.type, n.serial FROM ends JOIN name_rows n USING (key)",
    "mentions_stop_lists": _STOPPED + " SELECT doc_id, start, stop, text, n.type, n.serial FROM chosen JOIN name_rows n USING (key)",
    "mentions_autodetect": _DETECTED,
    "mentions_disambiguated": _ANY + _CLEAR + _FLAT + "clear",
    "mentions_grouped": _TYPED + _CLEAR + _GROUPED,
    "document_segments": f"""WITH RECURSIVE {_DOCS}, {_SEGMENTS}
    SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, CAST(sentence AS INTEGER) AS sentence, CAST(begin AS INTEGER) AS begin, CAST("end" AS INTEGER) AS "end" FROM segment""",
    "mentions_structured": _TYPED + _PLACED
    + """ SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, CAST(sentence AS INTEGER) AS sentence, start, stop, text, type, serial FROM structured""",
    "mentions_from_files": _FROM_FILES + _PLACED
    + """ SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, CAST(sentence AS INTEGER) AS sentence, start, stop, text, type, serial FROM structured""",
    "corpus_pairs": _scores("true", _TYPED + _PLACED + ", m AS (SELECT DISTINCT doc_id AS doc, paragraph, sentence, start, serial FROM structured)"),
    "acronym_mentions": _SAID + " SELECT doc_id AS document, start, stop, text, type, serial FROM mention",
    "entities_distinct": _TYPED + " SELECT DISTINCT doc_id, text, type, coalesce(identifier, CAST(serial AS VARCHAR)) AS identifier FROM mention",
    "entity_lines_csv": _TYPED
    + """ SELECT DISTINCT doc_id, CASE WHEN contains(text, ',') THEN '"' || text || '"' ELSE text END || ',' || type || ',' || CASE WHEN contains(id, ',') THEN '"' || id || '"' ELSE id END AS line
    FROM (SELECT doc_id, text, type, coalesce(identifier, CAST(serial AS VARCHAR)) AS id FROM mention)""",
    "entities_grouped": _TYPED
    + """, spans AS (SELECT doc_id, text, start, list(struct_pack(type := type, serial := serial, identifier := identifier)) AS e FROM mention GROUP BY ALL)
    SELECT doc_id, text, count(*) AS count, unnest(arg_min(e, start), recursive := true) FROM spans GROUP BY doc_id, text""",
    "entity_annotations": _TYPED + _ANNOTATED + " SELECT doc_id, n, begin, \"end\", body FROM annotated",
    "entities_jsonld": _TYPED + _ANNOTATED
    + """, graph AS (
      SELECT doc_id, string_agg('{"@id":"_:annotations/' || n || '","body":' || body || ',"target":"' || doc_id || '#char=' || begin || ',' || "end" || '"}', ',' ORDER BY n) AS g FROM annotated GROUP BY doc_id)
    SELECT doc_id, '{"@context":["http://nlplab.org/ns/restoa-context-20150307.json","http://nlplab.org/ns/bio-20151118.jsonld"],"@graph":[' || coalesce(g, '') || '],"@id":"_:annotations"}' AS json
    FROM docs LEFT JOIN graph USING (doc_id)""",
    "entities_html": _PAGES,
    "entities_xml": _TYPED
    + """, spans AS (
      SELECT doc_id, text, start, string_agg('<entity><type xsi:type="xsd:int">' || type || '</type><identifier xsi:type="xsd:string">' || coalesce(identifier, CAST(serial AS VARCHAR)) || '</identifier></entity>', ''
        ORDER BY type, serial, identifier) AS e FROM mention GROUP BY doc_id, text, start
    ), items AS (
      SELECT doc_id, min(start) AS first, '<item><name xsi:type="xsd:string">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</name><count xsi:type="xsd:int">' || count(*)
        || '</count><entities>' || arg_min(e, start) || '</entities></item>' AS item FROM spans GROUP BY doc_id, text
    )
    SELECT doc_id, '<?xml version="1.0" encoding="UTF-8"?><GetEntitiesResponse xmlns="" xmlns:xsd="http://www.w3.org/2001/XMLSchema" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><items>'
      || string_agg(item, '' ORDER BY first) || '</items></GetEntitiesResponse>' AS xml FROM items GROUP BY doc_id""",
    "entity_extract": _TYPED
    + """ SELECT doc_id, type_name, p.name, type, coalesce(identifier, CAST(m.serial AS VARCHAR)) AS identifier, array_to_string(list_sort(list_distinct(list(text))), ';') AS texts
    FROM mention m LEFT JOIN (SELECT serial, min(name) AS name FROM names WHERE serial IS NOT NULL AND name IS NOT NULL GROUP BY serial) p ON p.serial = m.serial
    LEFT JOIN """ + X.values(X.TYPE_NAMES, "kind", "type_name") + """ k ON k.kind = type GROUP BY ALL""",
    "pair_level_counts": f"WITH {_GIVEN}, {_PAIR_ITEMS} SELECT level, serial1, serial2, count(*) AS documents FROM level_pairs GROUP BY ALL",
    "pair_scores_all": _scores("true"),
    "pair_scores_selective": _scores(
        "(type1, type2) IN (" + ", ".join(f"({a}, {b}), ({b}, {a})" for a, b in X.TYPE_PAIRS) + ")"
    ),
    "clean_dictionary_log": _LOG + " SELECT reason, hex(key) AS key, name, type, serial, CAST(count AS INTEGER) AS count, masked_type, masked_serial FROM log",
    "clean_dictionary": _LOG
    + f" SELECT serial, name FROM names n WHERE serial IS NOT NULL AND name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM log WHERE log.serial = n.serial AND log.key = {key_of('n.name')})",
    "character_offsets": f"""WITH {_DOCS}, spans AS (SELECT DISTINCT doc, start, stop FROM mentions WHERE doc IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL)
    , letters AS (
      SELECT doc_id, n - 1 AS place, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY n) - strlen(c) AS byte
      FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS n FROM docs)
    )
    SELECT doc, start, stop, CAST(a.place AS INTEGER) AS begin, CAST(z.place + 1 AS INTEGER) AS "end" FROM spans
    JOIN letters a ON a.doc_id = doc AND a.byte = start ASOF JOIN letters z ON z.doc_id = doc AND z.byte <= stop""",
    "resolve_names": f"""WITH {_NAME_ROWS}, asked AS (SELECT DISTINCT text AS name FROM mentions WHERE text IS NOT NULL)
    SELECT DISTINCT asked.name, type, serial FROM asked JOIN name_rows ON name_rows.key = {key_of('asked.name')}""",
    "entity_iris": f"""SELECT type, identifier, CASE WHEN type >= 0 THEN 'stringdb:' || type || '.' || identifier WHEN type = -1 THEN 'stitchdb:' || identifier
      WHEN type = -2 THEN 'taxonomy:' || identifier WHEN contains(identifier, ':') THEN identifier ELSE '_:' || identifier END AS iri
    FROM (SELECT DISTINCT type, identifier FROM test_entities WHERE type IS NOT NULL AND identifier IS NOT NULL UNION SELECT * FROM {X.values(X.IRIS, 'type', 'identifier')})""",
    "environment_ids": f"""SELECT serial, 'ENVO:' || lpad(CAST(serial AS VARCHAR), CASE WHEN serial >= 10000 AND serial < 10200 THEN 7 ELSE 8 END, '0') AS envo
    FROM (SELECT DISTINCT serial FROM test_entities WHERE serial IS NOT NULL UNION ALL SELECT * FROM {X.values(((9999,), (10000,), (10199,), (10200,)), 'serial')})""",
    "block_promotion": f"SELECT name, true AS blocked FROM {X.values(X.BLOCKS, 'name', 'doc_id')} GROUP BY name HAVING count(DISTINCT doc_id) >= 5",
    "dedup_documents": f"WITH {_DOCS} SELECT doc_id, md5(text) AS text_md5, CAST(strlen(text) AS INTEGER) AS bytes FROM docs",
}
