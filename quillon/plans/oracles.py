"""The catalog's queries in DuckDB SQL."""

from __future__ import annotations

from quillon.functions.plain import DEFINITION, STOPWORDS

K = 10
ONE_QUERY = "then there was light in that other station"


def tok(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


DOCS = "d AS (SELECT CAST(doc_id AS VARCHAR) AS artifact_id, text, strlen(text) AS length, concat_ws('/', source, lang, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt') AS path FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"
POST = f"{DOCS}, o AS (SELECT artifact_id, length, unnest({tok('text')}) AS term FROM d), p AS (SELECT artifact_id, length, term, count(*) AS tf FROM o GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term), s AS (SELECT count(*) AS n, avg(CAST(length AS DOUBLE)) AS mean FROM d)"
ASKED = "v AS (SELECT item_id AS query_id, 0 AS variant_ord, text, 1.0::DOUBLE AS weight FROM benchmark)"
WEIGHTED = "v AS (SELECT item_id AS query_id, 0 AS variant_ord, text, 1.0::DOUBLE AS weight FROM benchmark UNION ALL SELECT item_id, 1, left(text, length(text) // 2), 0.5::DOUBLE FROM benchmark UNION ALL SELECT item_id, 2, text, 0.0::DOUBLE FROM benchmark)"
ONE = f"v AS (SELECT CAST(0 AS BIGINT) AS query_id, 0 AS variant_ord, '{ONE_QUERY}' AS text, 1.0::DOUBLE AS weight)"


def bm25(v: str = ASKED, k: int = K) -> str:
    """CTEs up to b (query_id, rank, artifact_id, score)."""
    return f"""{POST}, {v},
t AS (SELECT query_id, term, sum(weight) AS weight FROM (SELECT query_id, weight, unnest({tok('text')}) AS term FROM v WHERE weight > 0) GROUP BY ALL),
g AS (SELECT query_id, artifact_id, round(sum(weight * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score
  FROM t JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL),
b AS (SELECT query_id, artifact_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank FROM g QUALIFY rank <= {k})"""


GRAMS = f"""vt AS (SELECT query_id, weight, variant_ord, {tok('text')} AS w FROM v WHERE weight > 0),
vp AS (SELECT DISTINCT query_id, variant_ord, weight, array_to_string(w[i:i + n - 1], ' ') AS phrase, n FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, unnest([2, 3, 4]) AS n FROM vt) WHERE n <= len(w))),
c AS (SELECT query_id, phrase, sum(weight * n) AS gain FROM vp GROUP BY ALL)"""


def phrases(k: int = K) -> str:
    """CTEs after DOCS and v, up to h; a document of this corpus is one segment."""
    return f"""{GRAMS},
ph AS (SELECT query_id, artifact_id, round(sum(gain), 9) AS score FROM c, (SELECT artifact_id, lower(text) AS low FROM d) WHERE contains(low, phrase) GROUP BY ALL),
h AS (SELECT query_id, artifact_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank FROM ph WHERE score > 0 QUALIFY rank <= {k})"""


PAIRS = "n AS (SELECT DISTINCT p_name AS a FROM part), pairs AS (SELECT x.a, y.a AS b FROM n x, n y)"
BAND = "CASE WHEN {0} > 0.8 THEN 'high' WHEN {0} > 0.4 THEN 'medium' ELSE 'low' END"
HASHED = """e AS (SELECT {id}, slot, sum(sign) AS x FROM (SELECT {id}, code % 64 AS slot, CASE WHEN code >= 2147483648 THEN 1.0 ELSE -1.0 END AS sign
  FROM (SELECT {id}, ('0x' || left(md5(term), 8))::BIGINT AS code FROM (SELECT {id}, unnest({tok}) AS term FROM {of}))) GROUP BY ALL)"""


def hashed(of: str, key: str) -> str:
    rows = HASHED.format(id=key, tok=tok("text"), of=of)[len("e AS (") : -1]
    return f"(SELECT {key}, slot, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM ({rows}) WHERE x <> 0)"


REL = "r AS (SELECT item_id AS query_id, artifact_id AS doc_id, 1 AS relevance FROM benchmark, d WHERE contains(d.text, benchmark.text) AND benchmark.text <> '')"


def quality(hits: str, out: str) -> str:
    """CTEs that give `out` (query_id, ndcg, mrr, recall) of hits (query_id, artifact_id, rank)."""
    return f"""{out}_i AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN i <= 10 THEN 1 / log2(i + 1) ELSE 0 END) AS ideal FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS i FROM r) GROUP BY ALL),
{out}_g AS (SELECT x.query_id, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first, count(*) AS found FROM {hits} x JOIN r ON x.query_id = r.query_id AND x.artifact_id = r.doc_id GROUP BY ALL),
{out} AS (SELECT query_id, coalesce(dcg, 0) / ideal AS ndcg, coalesce(1.0 / first, 0) AS mrr, coalesce(found, 0) / relevant AS recall FROM {out}_i LEFT JOIN {out}_g USING (query_id))"""


def bucket(x: str, n: int) -> str:
    return f"CAST(('0x' || left(md5({x}), 8))::BIGINT % {n} AS BIGINT)"


def prints(rows: str, n: int) -> str:
    part = lambda at: f"CAST(sum(('0x' || substr(md5(artifact_id || ':' || sha256(text)), {at}, 15))::BIGINT::HUGEINT) AS VARCHAR)"
    return f"SELECT {bucket('artifact_id', n)} AS bucket, count(*) AS members, {part(1)} || ':' || {part(16)} AS fingerprint FROM {rows} GROUP BY ALL"


def component(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[^A-Za-z0-9\-_.]', '_', 'g'), '^_+|_+$', '', 'g')"


def ignored() -> str:
    """The last of the rules that matches decides."""
    return r"""CASE WHEN regexp_matches(path, '^(.*/)?de/[^/]*(/.*)?$') THEN true
WHEN regexp_matches(path, '^(.*/)?doc_[^/]\.txt(/.*)?$') THEN true
WHEN regexp_matches(path, '^(.*/)?src15/.*$') THEN false
WHEN regexp_matches(path, '^(.*/)?src1[^/]*/.*$') THEN true ELSE false END"""


LINES = r"array_to_string(list_filter(list_transform(string_split_regex({0}, '\r?\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))"


def snippets(of: str) -> str:
    """SELECT of * and snippet of (.., q, body): about 240 characters from 40 before the first term, or the first 160 where there is none."""
    flat = f"SELECT *, {LINES.format('body')} AS flat, {tok('q')} AS terms FROM {of}"
    found = f"SELECT *, coalesce(list_min(list_filter(list_transform(terms, lambda t: strpos(lower(flat), t) - 1), lambda i: i >= 0)), 0) AS first FROM ({flat})"
    begun = f"SELECT *, CASE WHEN first > 40 AND contains(left(flat, first - 40), ' ') THEN first - 40 - strpos(reverse(left(flat, first - 40)), ' ') + 1 ELSE 0 END AS begin FROM ({found})"
    shown = "CASE WHEN begin > 0 THEN '...' ELSE '' END || substr(flat, CAST(begin AS BIGINT) + 1, 240) || CASE WHEN length(flat) > begin + 240 THEN '...' ELSE '' END"
    return f"(SELECT *, CASE WHEN body IS NULL THEN NULL WHEN len(terms) = 0 THEN left(flat, 160) || CASE WHEN length(flat) > 160 THEN '...' ELSE '' END ELSE {shown} END AS snippet FROM ({begun}))"


def titled(x: str) -> str:
    """Label of a first segment whose text is x."""
    line = rf"trim(split_part({x}, chr(10), 1), ' ' || chr(9) || chr(13))"
    head = f"trim(ltrim({line}, '#'))"
    return rf"'section 1' || CASE WHEN (starts_with({line}, '#') OR (strlen({line}) <= 80 AND right({line}, 1) NOT IN ('.', '!', '?') AND regexp_matches({line}, '\p{{L}}'))) AND {head} <> '' THEN ': ' || {head} ELSE '' END"


def hits(z: str, location: str = "CAST(NULL AS VARCHAR)") -> str:
    """Full rows of z (query_id, rank, artifact_id, score) over d, one segment to a document."""
    return f"SELECT query_id, rank, artifact_id, 'file' AS kind, path, score, {BAND.format('score')} AS confidence, {location} AS location, snippet FROM {snippets(f'(SELECT z.*, path, trim(d.text) AS body, v.text AS q FROM {z} z JOIN d USING (artifact_id) JOIN v USING (query_id))')}"


SEMANTIC = f"""q AS {hashed('v', 'query_id')}, w AS {hashed('d', 'artifact_id')},
y AS (SELECT query_id, artifact_id, sum(q.x * w.x) AS dot FROM q JOIN w USING (slot) GROUP BY ALL),
h AS (SELECT query_id, artifact_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dot / sqrt(2), 6) DESC, artifact_id) AS rank FROM y WHERE dot > 1e-12 QUALIFY rank <= 8)"""
ALONE = "z AS (SELECT query_id, artifact_id, rank, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM {0})"

PAGE = r"""(SELECT *, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<head[ >].*?</head>', '', 'gis'), '<!DOCTYPE[^>]*>', '', 'gi') AS h FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL)"""
BLOCKS = "address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figure|footer|form|header|hr|html|main|nav|ol|p|pre|section|table|tbody|td|th|thead|tr|ul|li|h1|h2|h3|h4|h5|h6"


def page_text() -> str:
    """(artifact_id, path, text) of pages: visible text with blank lines between blocks."""
    x = "h"
    for tag in ("script", "style", "template", "noscript"):
        x = f"regexp_replace({x}, '<{tag}[ >].*?</{tag}>', '', 'gis')"
    x = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    x = f"regexp_replace({x}, '<br ?/?>', chr(10), 'gi')"
    for n in range(1, 7):
        x = f"regexp_replace({x}, '<h{n}( [^>]*)?>', chr(10) || chr(10) || '{'#' * n} ', 'gi')"
    x = f"regexp_replace({x}, '<li( [^>]*)?>', chr(10) || chr(10) || '* ', 'gi')"
    x = f"regexp_replace({x}, '</?({BLOCKS})( [^>]*)?/?>', chr(10) || chr(10), 'gi')"
    x = f"regexp_replace({x}, '</?[A-Za-z][^>]*>', '', 'g')"
    for name, sign in (("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("#39", "chr(39)"), ("nbsp", "chr(160)"), ("copy", "chr(169)"), ("middot", "chr(183)"), ("amp", "'&'")):
        x = f"replace({x}, '&{name};', {sign})"
    lines = rf"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(160))), chr(10))"
    return rf"(SELECT CAST(page_id AS VARCHAR) AS artifact_id, url AS path, trim(regexp_replace({lines}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM {PAGE})"


def heading_like(x: str) -> str:
    t = f"trim({x}, ' ' || chr(9) || chr(10))"
    return rf"(starts_with({t}, '#') OR ({t} <> '' AND NOT contains({t}, chr(10)) AND strlen({t}) <= 80 AND right({t}, 1) NOT IN ('.', '!', '?') AND regexp_matches({t}, '\p{{L}}')))"


def head_of(x: str) -> str:
    return f"replace(trim(ltrim(trim({x}, ' ' || chr(9) || chr(10)), '#')), chr(10), ' ')"


def page_segments() -> str:
    """(artifact_id, path, ordinal, label, text): blocks of pages, where a heading takes the block after it. In a run of headings
    every second is taken by the one before it, so only a run of odd length takes the block that follows."""
    first = "split_part(body, chr(10), 1)"
    return rf"""(WITH t AS (SELECT artifact_id, path, list_filter(string_split_regex(text, '\n[ \t]*\n\s*'), lambda x: trim(x) <> '') AS parts FROM {page_text()}),
i AS (SELECT artifact_id, path, i, parts[i] AS block, {heading_like('parts[i]')} AS h, len(parts) AS n FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM t)),
r AS (SELECT *, i - max(CASE WHEN h THEN 0 ELSE i END) OVER (PARTITION BY artifact_id ORDER BY i) AS k, lead(block) OVER (PARTITION BY artifact_id ORDER BY i) AS after FROM i),
p AS (SELECT *, coalesce(lag(CASE WHEN h THEN k ELSE 0 END) OVER (PARTITION BY artifact_id ORDER BY i), 0) % 2 = 1 AS taken FROM r),
c AS (SELECT artifact_id, path, row_number() OVER (PARTITION BY artifact_id ORDER BY i) AS ordinal, h AND i < n AS pair, {head_of('block')} AS head, trim(CASE WHEN h AND i < n THEN after ELSE block END, ' ' || chr(9) || chr(10)) AS body FROM p WHERE NOT taken),
e AS (SELECT artifact_id, path, ordinal, CASE WHEN pair THEN head WHEN {heading_like(first)} THEN {head_of(first)} ELSE '' END AS name, CASE WHEN NOT pair THEN body WHEN body = '' THEN head ELSE head || chr(10) || chr(10) || body END AS text FROM c)
SELECT artifact_id, path, ordinal, 'section ' || CAST(ordinal AS VARCHAR) || CASE WHEN name = '' THEN '' ELSE ': ' || name END AS label, text FROM e)"""


def asked_for(of: str) -> str:
    """of (.., q, x) with what the scorers need of a query q: terms, ql, qc, path_like."""
    raw = "trim(rtrim(trim(split_part(trim(q), 'Intent:', 1)), '.'))"
    return rf"(SELECT *, lower(raw) AS ql, regexp_replace(lower(raw), '[^\p{{L}}\p{{N}}]+', '', 'g') AS qc, {tok('raw')} AS terms, regexp_matches(raw, '[/\\._-]') AS path_like FROM (SELECT *, {raw} AS raw FROM {of}))"


def subsequence(wanted: str, x: str) -> str:
    start = "{'c': '', 'gained': 0.0::DOUBLE, 'first': -1::BIGINT, 'last': -1::BIGINT, 'at': -1::BIGINT, 'ok': true}"
    each = f"list_transform(string_split({wanted}, ''), lambda c: {{'c': c, 'gained': 0.0::DOUBLE, 'first': -1::BIGINT, 'last': -1::BIGINT, 'at': -1::BIGINT, 'ok': true}})"
    at = f"CAST(CASE WHEN NOT s.ok OR strpos(substr({x}, s.last + 2), e.c) = 0 THEN -1 ELSE s.last + strpos(substr({x}, s.last + 2), e.c) END AS BIGINT)"
    gain = f"s.gained + 1.0 + CASE WHEN {at} = 0 OR NOT regexp_matches(substr({x}, {at}, 1), '[\\p{{L}}\\p{{N}}]') THEN 0.3 ELSE 0.0 END + CASE WHEN s.first >= 0 AND {at} = s.last + 1 THEN 0.35 ELSE 0.0 END"
    step = f"{{'c': e.c, 'gained': {gain}, 'first': CASE WHEN s.first < 0 THEN {at} ELSE s.first END, 'last': {at}, 'at': {at}, 'ok': s.ok AND {at} >= 0}}"
    done = f"list_reduce({each}, lambda s, e: {step}, {start})"
    return f"CASE WHEN {wanted} = '' THEN 0.0 ELSE (SELECT CASE WHEN u.ok THEN u.gained / length({wanted}) * (0.5 + length({wanted}) / (u.last - u.first + 1)) ELSE 0.0 END FROM (SELECT {done} AS u)) END"


#: The other letters of the tables, and capitals for them: DuckDB compares bytes, and compact texts have no capitals of their own.
LETTERS, CAPITALS = "áâàäçéèêëíîïñóôòöúûùüßœ", "ABCDEFGHIJKLMNOPQRSTUVW"


def narrow(x: str) -> str:
    return f"translate({x}, '{LETTERS}', '{CAPITALS}')"


def components(of: str) -> str:
    """SELECT of * and score of of (.., q, x): the component score of x for q."""
    base = f"SELECT *, greatest(CASE WHEN qc = '' OR tight = '' THEN 0.0 ELSE {subsequence('qc', 'low')} END, 0.9 * jaro_winkler_similarity({narrow('qc')}, {narrow('tight')}), 0.95 * (1 - levenshtein({narrow('qc')}, {narrow('tight')})::DOUBLE / greatest(length(qc), length(tight), 1))) AS base FROM (SELECT *, lower(x) AS low, regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS tight FROM {asked_for(of)})"
    more = f"SELECT *, CASE WHEN contains(low, ql) OR contains(tight, qc) THEN 0.55 ELSE 0.0 END AS inside, CASE WHEN starts_with(tight, qc) THEN 0.45 ELSE 0.0 END AS front, 0.08 * len(list_filter(terms, lambda t: strlen(t) >= 2 AND contains(low, t))) AS shared FROM ({base})"
    return f"(SELECT *, CASE WHEN qc = '' OR tight = '' OR (base < 0.5 AND inside = 0 AND front = 0 AND shared < 0.16) THEN 0.0 ELSE base + inside + front + shared END AS score FROM ({more}))"


def text_scores(of: str) -> str:
    """(q, x, score) of the distinct pairs of `of` (q, x): the best of the whole text and of its windows of words, and whether it has the query."""
    words = f"SELECT q, x, ql, terms, {tok('x')} AS w FROM {asked_for(of)}"
    sizes = f"SELECT *, unnest(range(greatest(len(terms) - 1, 1), least(len(terms) + 2, len(w), 6) + 1)) AS n FROM ({words})"
    windows = f"SELECT q, x AS whole, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM ({sizes}))"
    every = components(f"(SELECT q, x AS whole, x FROM {of} UNION {windows})")
    return f"(SELECT q, whole AS x, max(score) + max(CASE WHEN ql <> '' AND contains(lower(whole), ql) THEN 0.35 ELSE 0.0 END) AS score FROM {every} GROUP BY ALL)"


def path_scores(of: str) -> str:
    """(q, x, score) of the distinct pairs of `of` (q, x), x being a path."""
    parts = "list_filter(string_split(x, '/'), lambda p: p <> '' AND p <> '.')"
    name = f"coalesce(({parts})[-1], '')"
    stem = f"CASE WHEN contains(substr({name}, 2), '.') THEN regexp_replace({name}, '\\.[^.]*$', '') ELSE {name} END"
    each = f"SELECT q, x AS whole, x AS x, -1.0 AS factor FROM {of} UNION ALL SELECT q, x, {name}, 1.3 FROM {of} UNION ALL SELECT q, x, {stem}, 1.45 FROM {of} UNION ALL SELECT q, x, unnest({parts}), 1.1 FROM {of}"
    best = f"SELECT q, whole, any_value(terms) AS terms, max(score * CASE WHEN factor > 0 THEN factor WHEN path_like THEN 1.1 ELSE 0.9 END) AS best FROM {components(f'({each})')} GROUP BY ALL"
    return f"(SELECT q, whole AS x, CASE WHEN best = 0 THEN 0.0 ELSE best + 0.06 * len(list_filter(terms, lambda t: contains(lower(whole), t))) END AS score FROM (SELECT q, whole, max(terms) AS terms, max(best) AS best FROM ({best}) GROUP BY ALL))"


def definition_bonus(score: str, x: str) -> str:
    """For columns ql, raw, terms of a query, x, and the text score of both."""
    symbol = f"CASE WHEN contains(raw, '::') OR contains(raw, '_') OR regexp_matches(raw, '\\p{{Lu}}') THEN 0.18 * least(greatest({score} / 2.0, 0), 1) ELSE 0.0 END"
    return rf"CASE WHEN {x} IS NOT NULL AND regexp_matches(lower(regexp_replace({x}, '^\s+', '')), '^{DEFINITION.pattern}') THEN 0.16 + least(0.08 * len(list_filter(terms, lambda t: strlen(t) >= 2 AND contains(lower({x}), t))), 0.16) + {symbol} ELSE 0.0 END"


def line_matches(asked: str, segs: str) -> str:
    """(q, label, text, score, line) of the best line of each segment of segs (label, text) for each text of asked (q)."""
    return rf"""(WITH aq AS (SELECT DISTINCT q FROM {asked}), ss AS (SELECT DISTINCT label, text FROM {segs}),
ln AS (SELECT label, text, i, trim(lines[i], ' ' || chr(9) || chr(13)) AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS lines FROM ss))),
pr AS (SELECT DISTINCT q, x FROM aq, (SELECT line AS x FROM ln WHERE line <> '' UNION SELECT label FROM ss UNION SELECT text FROM ss)),
sc AS (SELECT * FROM {text_scores('pr')}),
qq AS (SELECT * FROM {asked_for('(SELECT q FROM aq)')}),
a1 AS (SELECT q, label, text, i, line, sc.score + {definition_bonus('sc.score', 'line')} AS own, 0 AS whole FROM ln JOIN sc ON sc.x = line JOIN qq USING (q) WHERE line <> '' AND sc.score > 0
  UNION ALL SELECT q, label, text, 0, text, sc.score + {definition_bonus('sc.score', 'text')}, 1 FROM ss JOIN sc ON sc.x = text JOIN qq USING (q) WHERE sc.score > 0),
b1 AS (SELECT a1.*, own + 0.45 * sc.score AS score FROM a1 JOIN sc ON sc.q = a1.q AND sc.x = a1.label)
SELECT q, label, text, score, line FROM b1 QUALIFY row_number() OVER (PARTITION BY q, label, text ORDER BY whole, score DESC, i) = 1)"""


def shortened(x: str) -> str:
    flat = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) > 220 THEN left({flat}, 217) || '...' ELSE {flat} END"


def path_lane(k: int) -> str:
    """CTEs of the path-fuzzy lane pl over v and d."""
    return f"""ps AS (SELECT * FROM {path_scores('(SELECT DISTINCT v.text AS q, d.path AS x FROM v, d)')}),
pg AS (SELECT query_id, path, round(max(s.score * v.weight), 9) AS score FROM ps s JOIN v ON v.text = s.q JOIN (SELECT DISTINCT path FROM d) d ON d.path = s.x WHERE s.score > 0 GROUP BY ALL),
pl AS (SELECT query_id, artifact_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank, CAST(NULL AS VARCHAR) AS snippet, CAST(NULL AS VARCHAR) AS location FROM pg JOIN d USING (path) WHERE score >= 0.78 QUALIFY rank <= {k})"""


def line_lane(k: int) -> str:
    """CTEs of the segment-fuzzy lane sl over v and g (artifact_id, ordinal, label, text)."""
    return f"""sm AS (SELECT * FROM {line_matches('(SELECT text AS q FROM v WHERE weight > 0)', 'seg')}),
sv AS (SELECT query_id, variant_ord, label, sm.text, round(sm.score * weight, 9) AS score, {shortened('line')} AS snippet FROM sm JOIN v ON v.text = sm.q),
sb AS (SELECT query_id, artifact_id, ordinal, label, score, snippet FROM sv JOIN seg USING (label, text) WHERE score >= 0.78 QUALIFY row_number() OVER (PARTITION BY query_id, artifact_id ORDER BY score DESC, variant_ord, ordinal) = 1),
sl AS (SELECT query_id, artifact_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank, snippet, label AS location, score FROM sb QUALIFY rank <= {k})"""


def phrase_lane(k: int) -> str:
    return f"""{GRAMS},
fs AS (SELECT query_id, artifact_id, ordinal, sum(gain) AS total FROM c, (SELECT artifact_id, ordinal, lower(text) AS low FROM seg) WHERE contains(low, phrase) GROUP BY ALL),
fb AS (SELECT query_id, artifact_id, ordinal, round(total, 9) AS score FROM fs WHERE round(total, 9) > 0 QUALIFY row_number() OVER (PARTITION BY query_id, artifact_id ORDER BY total DESC, ordinal) = 1),
fl AS (SELECT query_id, artifact_id, row_number() OVER (PARTITION BY query_id ORDER BY fb.score DESC, artifact_id) AS rank, seg.text AS snippet, label AS location FROM fb JOIN seg USING (artifact_id, ordinal) QUALIFY rank <= {k})"""


def vector_lane(k: int) -> str:
    """CTEs of the vector lane el; texts with the same identifier are one row of HASHED each."""
    return f"""vi AS (SELECT query_id || '/' || variant_ord AS vid, query_id, weight, text FROM v WHERE weight > 0), si AS (SELECT artifact_id || '::segment:' || lpad(CAST(ordinal AS VARCHAR), 4, '0') AS sid, * FROM seg),
q AS {hashed('vi', 'vid')}, w AS {hashed('si', 'sid')},
dt AS (SELECT vid, sid, sum(q.x * w.x) AS dot FROM q JOIN w USING (slot) GROUP BY ALL),
ev AS (SELECT query_id, artifact_id, sid, dot * weight AS v, label, si.text FROM dt JOIN vi USING (vid) JOIN si USING (sid) WHERE dot * weight > 1e-12),
eb AS (SELECT query_id, artifact_id, round(sum(v) / sqrt(count(*) + 1), 6) AS score FROM ev GROUP BY ALL),
ex AS (SELECT query_id, artifact_id, text, label FROM ev QUALIFY row_number() OVER (PARTITION BY query_id, artifact_id ORDER BY round(v, 12) DESC, sid) = 1),
el AS (SELECT query_id, artifact_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank, text AS snippet, label AS location FROM eb JOIN ex USING (query_id, artifact_id) QUALIFY rank <= {k})"""


PAGES_D = f"d AS (SELECT artifact_id, text, strlen(text) AS length, path FROM {page_text()})"
SEGS = f"seg AS (SELECT * FROM {page_segments()})"


def page_plan(lanes: str, kind: str | None = None, weight: float = 1.0, words: int = 0, prompt: str = "", model: bool = False) -> str:
    """A preset over pages: bm25 with path-fuzzy (lanes "two") or all lanes ("all"), a variant of the words of the prompt backwards, and
    position-aware reranking or that by the share of the query's words."""
    v = "v0 AS (SELECT item_id AS query_id, text FROM benchmark), "
    if kind:
        said = rf"array_to_string(list_reverse(list_filter(string_split_regex(split_part('{prompt}' || text, chr(10), -1), '\s+'), lambda t: t <> ''))[1:{words}], ' ')"
        clean = f"trim(trim({said}), '\"' || chr(39))"
        v += f"v AS (SELECT query_id, 0 AS variant_ord, trim(text) AS text, 1.0::DOUBLE AS weight FROM v0 UNION ALL SELECT query_id, 1, {clean}, {weight}::DOUBLE FROM v0 WHERE {clean} <> '' AND {clean} <> trim(text))"
    else:
        v += "v AS (SELECT query_id, 0 AS variant_ord, text, 1.0::DOUBLE AS weight FROM v0)"
    start = bm25(v, 8).replace(DOCS, PAGES_D)
    lane = lambda name, i, extra="snippet, location": f"SELECT query_id, artifact_id, rank, {extra}, {i} AS lane FROM {name}"
    none = "CAST(NULL AS VARCHAR) AS snippet, CAST(NULL AS VARCHAR) AS location"
    if lanes == "two":
        ctes, unions = path_lane(8), [lane("b", 0, none), lane("pl", 1)]
    else:
        ctes = ", ".join([phrase_lane(8), path_lane(8), line_lane(8), vector_lane(8)])
        unions = [lane("b", 0, none), lane("fl", 1), lane("pl", 2), lane("sl", 3), lane("el", 4)]
    fused = f"""u AS ({' UNION ALL '.join(unions)}),
x0 AS (SELECT query_id, artifact_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, first(snippet ORDER BY lane) AS snippet, first(location ORDER BY lane) AS location FROM u GROUP BY ALL),
x1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank FROM x0 QUALIFY rank <= 8),
x2 AS (SELECT x1.*, d.path, v0.text AS q FROM x1 JOIN d USING (artifact_id) JOIN v0 USING (query_id))"""
    if model:
        own, body = (rf"list_distinct(list_filter(string_split_regex(lower({c}), '\s+'), lambda t: t <> ''))" for c in ("q", "snippet"))
        new = f"CASE WHEN snippet IS NULL OR snippet = '' THEN score ELSE len(list_intersect({own}, {body}))::DOUBLE / greatest(len({own}), 1) END"
        ranked = f"x3 AS (SELECT query_id, artifact_id, path, q, snippet, location, round({new}, 9) AS score FROM x2)"
    else:
        pairs = "(SELECT DISTINCT q, x FROM (SELECT q, location AS x FROM x2 UNION SELECT q, snippet FROM x2) WHERE x IS NOT NULL)"
        sig = lambda x, top: f"least(greatest(coalesce({x}, 0) / {top}, 0), 1)"
        bonus = f"least(0.06 * {sig('pp.score', 3.0)} + 0.035 * {sig('tl.score', 2.0)} + 0.02 * {sig('ts.score', 2.0)} + 0.08 * {definition_bonus('ts.score', 'x2.snippet')}, 0.12)"
        ranked = f"""tt AS (SELECT * FROM {text_scores(pairs)}), rp AS (SELECT * FROM {path_scores('(SELECT DISTINCT q, path AS x FROM x2)')}), qr AS (SELECT * FROM {asked_for('(SELECT DISTINCT q FROM x2)')}),
x3 AS (SELECT x2.query_id, x2.artifact_id, x2.path, x2.q, x2.snippet, x2.location, round(x2.score + {bonus}, 9) AS score FROM x2 JOIN qr ON qr.q = x2.q JOIN rp pp ON pp.q = x2.q AND pp.x = x2.path LEFT JOIN tt tl ON tl.q = x2.q AND tl.x = x2.location LEFT JOIN tt ts ON ts.q = x2.q AND ts.x = x2.snippet)"""
    shown = f"""x4 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank FROM x3 QUALIFY rank <= 10),
bs AS (SELECT query_id, artifact_id, seg.text AS best FROM x4 JOIN seg USING (artifact_id) WHERE snippet IS NULL QUALIFY row_number() OVER (PARTITION BY query_id, artifact_id ORDER BY len(list_filter({tok('q')}, lambda t: contains(lower(seg.text), t))) DESC, ordinal) = 1),
x5 AS (SELECT query_id, rank, artifact_id, path, score, location, q, coalesce(snippet, best) AS body FROM x4 LEFT JOIN bs USING (query_id, artifact_id))
SELECT query_id, rank, artifact_id, 'file' AS kind, path, score, {BAND.format('score')} AS confidence, location, snippet FROM {snippets('x5')}"""
    return f"WITH {start}, {SEGS}, {ctes}, {fused}, {ranked}, {shown}"


STOPS = ", ".join(f"'{w}'" for w in STOPWORDS)
KEEN = f"list_filter({tok('text')}, lambda t: strlen(t) > 1 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({STOPS}))"
ONCE = "list_filter({0}, lambda t, i: list_position({0}, t) = i)"

ORACLES: dict[str, str] = {
    "tokenize_counts": f"WITH {DOCS} SELECT artifact_id, CAST(len(w) AS BIGINT) AS tokens, CAST(len(list_distinct(w)) AS BIGINT) AS distinct_tokens FROM (SELECT artifact_id, {tok('text')} AS w FROM d)",
    "term_frequencies": f"WITH {POST} SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS documents, max(tf) AS most_in_one FROM p GROUP BY term",
    "document_frequency": f"WITH {POST} SELECT term, df FROM f",
    "postings_table": f"WITH {POST} SELECT term, artifact_id, length, tf FROM p",
    "corpus_stats": f"WITH {DOCS} SELECT count(*) AS num_docs, round(avg(CAST(length AS DOUBLE)), 6) AS avg_len FROM d",
    "corpus_summary": f"WITH {DOCS} SELECT count(*) AS indexed, (SELECT count(*) FROM documents) - count(*) AS skipped, CAST(sum(length) AS BIGINT) AS total_bytes FROM d",
    "artifact_budget": f"WITH {DOCS} SELECT artifact_id, length, CAST(len({tok('text')}) AS BIGINT) AS token_estimate FROM d",
    "bm25_single": f"WITH {bm25(ONE)} SELECT rank, artifact_id, score FROM b",
    "bm25_batch_topk": f"WITH {bm25()} SELECT query_id, rank, artifact_id, score FROM b",
    "bm25_weighted_variants": f"WITH {bm25(WEIGHTED)} SELECT query_id, rank, artifact_id, score FROM b",
    "bm25_sharded_merge": f"WITH {bm25()} SELECT query_id, rank, artifact_id, score FROM b",
    "phrase_candidates": f"WITH {ASKED}, {GRAMS} SELECT query_id, phrase, CAST(gain AS DOUBLE) AS gain FROM c",
    "phrase_retrieve": f"WITH {DOCS}, {ASKED}, {phrases()} SELECT query_id, rank, artifact_id, CAST(score AS DOUBLE) AS score FROM h",
    "vector_topk": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT a.vec_id AS query_id, b.vec_id AS artifact_id, list_dot_product(a.x, b.x) AS dot FROM e a, e b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dot / sqrt(2), 6) DESC, artifact_id) AS rank FROM g WHERE dot > 0)
SELECT query_id, rank, artifact_id, round(round(dot / sqrt(2), 6) * sqrt(2), 5) AS similarity FROM r WHERE rank <= {K}""",
    "vector_aggregate_segments": f"""WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT a.vec_id AS query_id, b.label AS artifact_id, round(sum(list_dot_product(a.x, b.x)) / sqrt(count(*) + 1), 6) AS score FROM e a, e b WHERE list_dot_product(a.x, b.x) > 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank, artifact_id, score FROM g QUALIFY rank <= {K}""",
    "levenshtein_norm": f"WITH {PAIRS} SELECT a, b, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END, 9) AS similarity FROM pairs",
    "jaro_winkler": f"WITH {PAIRS} SELECT a, b, round(jaro_winkler_similarity(a, b), 9) AS similarity FROM pairs",
    "definition_flag": rf"WITH {DOCS} SELECT artifact_id, regexp_matches(lower(regexp_replace(text, '^\s+', '')), '^{DEFINITION.pattern}') AS is_definition FROM d",
    "rrf_two_lanes": f"""WITH {bm25()}, {phrases()}, u AS (SELECT query_id, artifact_id, rank FROM b UNION ALL SELECT query_id, artifact_id, rank FROM h),
x AS (SELECT query_id, artifact_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank, artifact_id, score FROM x QUALIFY rank <= {K}""",
    "rrf_full_outer": f"""WITH {bm25()}, {phrases()},
x AS (SELECT coalesce(b.query_id, h.query_id) AS query_id, coalesce(b.artifact_id, h.artifact_id) AS artifact_id, round(coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + h.rank), 0), 9) AS score, b.score AS bm25_score, CAST(h.score AS DOUBLE) AS semantic_score
  FROM b FULL JOIN h ON b.query_id = h.query_id AND b.artifact_id = h.artifact_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank, artifact_id, score, bm25_score, semantic_score FROM x QUALIFY rank <= {K}""",
    "hybrid_search": f"""WITH {bm25(k=8)}, q AS {hashed('v', 'query_id')}, w AS {hashed('d', 'artifact_id')},
y AS (SELECT query_id, artifact_id, sum(q.x * w.x) AS dot FROM q JOIN w USING (slot) GROUP BY ALL),
h AS (SELECT query_id, artifact_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dot / sqrt(2), 6) DESC, artifact_id) AS rank FROM y WHERE dot > 1e-12 QUALIFY rank <= 8),
u AS (SELECT query_id, artifact_id, rank FROM b UNION ALL SELECT query_id, artifact_id, rank FROM h),
x AS (SELECT query_id, artifact_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY ALL),
z AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank, artifact_id, score FROM x QUALIFY rank <= 8)
SELECT query_id, rank, artifact_id, path, score, {BAND.format('score')} AS confidence FROM z JOIN d USING (artifact_id)""",
    "confidence_bands": f"SELECT {BAND.format('l_discount * 10')} AS confidence, count(*) AS rows FROM lineitem GROUP BY ALL",
    "snippet_truncate": f"WITH {DOCS} SELECT artifact_id, CASE WHEN length(t) > 220 THEN left(t, 217) || '...' ELSE t END AS snippet FROM (SELECT artifact_id, {collapse('text')} AS t FROM d)",
    "simple_snippet": rf"WITH {DOCS} SELECT artifact_id, CASE WHEN length(t) > 160 THEN left(t, 160) || '...' ELSE t END AS snippet FROM (SELECT artifact_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: {collapse('x')}), lambda x: x <> ''), chr(10)) AS t FROM d)",
    "agent_turn_artifacts": f"""WITH c AS (SELECT *, '.quillon/context/agent-turn/' || {component("CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)")} || '.txt' AS path FROM conversations WHERE text IS NOT NULL)
SELECT path || ':' || sha256(text) AS artifact_id, 'agent-turn' AS kind, path, 'text' AS source_kind, 'role: ' || role || chr(10) || chr(10) || text AS text, 'agent-turn' AS adapter, 'agent-turn:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS source FROM c""",
    "environment_fact_artifacts": f"""WITH c AS (SELECT *, '.quillon/context/environment/' || {component('event_type')} || '.txt' AS path FROM events WHERE event_type IS NOT NULL AND props IS NOT NULL)
SELECT path || ':' || sha256(props) AS artifact_id, 'environment-fact' AS kind, path, 'text' AS source_kind, event_type || '=' || props AS text, 'environment-context' AS adapter, 'environment:' || event_type AS source FROM c""",
    "tool_output_artifacts": f"""WITH c AS (SELECT *, '.quillon/context/tool-output/' || {component("event_type || '-' || CAST(event_id AS VARCHAR)")} || '.txt' AS path FROM events WHERE props IS NOT NULL)
SELECT path || ':' || sha256(props) AS artifact_id, 'tool-output' AS kind, path, 'text' AS source_kind, props AS text, 'tool-output' AS adapter, 'tool-output:' || event_type || ':' || CAST(event_id AS VARCHAR) AS source FROM c""",
    "artifact_hash_dedup": f"WITH {DOCS} SELECT sha256(text) AS content_hash, count(*) AS artifacts, min(artifact_id) AS first_id FROM d GROUP BY ALL",
    "source_kind_dispatch": rf"""WITH {DOCS}, u AS (SELECT regexp_extract(url, '^[^?#]*', 0) AS path FROM pages UNION ALL SELECT path FROM d), x AS (SELECT regexp_extract(path, '\.([^./]*)$', 1) AS suffix FROM u)
SELECT CASE suffix WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'xlsx' THEN 'xlsx' WHEN 'pptx' THEN 'pptx' ELSE 'text' END AS source_kind, suffix, count(*) AS files FROM x GROUP BY ALL""",
    "ignore_filter": f"WITH {DOCS} SELECT artifact_id, path FROM d WHERE NOT ({ignored()})",
    "path_names": rf"""WITH {DOCS}, u AS (SELECT path FROM d UNION ALL SELECT url FROM pages), x AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name FROM u)
SELECT path, CASE WHEN regexp_matches(name, '^.+\.[^.]*$') THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END AS stem, translate(path, '/\:', '___') AS safe_id, {component('path')} AS component FROM x""",
    "retained_merge": f"""WITH {bm25()}, {phrases()}, u AS (SELECT query_id, rank AS ord, 'doc_' || artifact_id AS path, 0 AS origin FROM b UNION ALL SELECT query_id, rank, 'doc_' || artifact_id, 1 FROM h),
x AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY origin, ord) = 1),
y AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY origin, ord, path) AS position, path, CAST(origin AS BIGINT) AS origin, CAST(greatest(count(*) OVER (PARTITION BY query_id) - 12, 0) AS BIGINT) AS pruned FROM x)
SELECT * FROM y WHERE position <= 12""",
    "evidence_dedup": "SELECT DISTINCT event_type, props FROM events",
    "significant_terms": f"WITH {DOCS}, o AS (SELECT artifact_id, unnest({KEEN}) AS term FROM d) SELECT artifact_id, count(*) AS terms, count(DISTINCT term) AS distinct_terms FROM o GROUP BY ALL",
    "first_query": f"WITH {DOCS}, o AS (SELECT artifact_id, CASE WHEN len({KEEN}) > 0 THEN {KEEN} ELSE {tok('text')} END AS w FROM d) SELECT artifact_id, array_to_string({ONCE.format('w')}[1:6], ' ') AS query FROM o",
    "follow_up_query": f"""WITH c AS (SELECT conv_id, turn, {tok('text')} AS used, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL),
o AS (SELECT conv_id, turn, used, {KEEN} AS w FROM c WHERE text IS NOT NULL), x AS (SELECT conv_id, turn, list_filter(w, lambda t: NOT list_contains(used, t)) AS w FROM o)
SELECT conv_id, turn, array_to_string({ONCE.format('w')}[1:6], ' ') AS query FROM x""",
    "stop_reason_counts": """WITH p AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS q, count(*) FILTER (WHERE role = 'assistant') AS e FROM conversations GROUP BY ALL)
SELECT CASE WHEN q > 3 THEN 'step-limit-reached' WHEN e = 0 THEN 'no-further-queries' ELSE 'no-additional-evidence' END AS stop_reason, count(*) AS tasks FROM p GROUP BY ALL""",
    "graph_integrity_antijoin": """WITH n AS (SELECT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT conv_id AS episode_id, 'edge-' || CAST(turn AS VARCHAR) AS edge_id, 'end' AS side, 'node-' || CAST(turn + 1 AS VARCHAR) AS node_id FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.conv_id = n.conv_id AND m.turn = n.turn + 1)""",
    "emission_view": f"WITH {bm25()}, x AS (SELECT query_id, rank, artifact_id, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM b) SELECT query_id, rank, path, score, {BAND.format('score')} AS confidence FROM x JOIN d USING (artifact_id)",
    "emission_latent": f"WITH {bm25()}, x AS (SELECT query_id, artifact_id, round(1.0::DOUBLE / (60 + rank), 9) AS value FROM b) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, artifact_id) AS rank, artifact_id, 'ranking-score' AS feature_space, value FROM x",
    "qrels_from_benchmark": f"WITH {DOCS}, {REL} SELECT query_id, doc_id, CAST(relevance AS BIGINT) AS relevance FROM r",
    "quality_per_query": f"WITH {bm25()}, {REL}, {quality('b', 'm')} SELECT query_id, round(ndcg, 9) AS ndcg, round(mrr, 9) AS mrr, round(recall, 9) AS recall FROM m",
    "quality_mean": f"WITH {bm25()}, {REL}, {quality('b', 'm')} SELECT count(*) AS queries, round(avg(ndcg), 9) AS ndcg, round(avg(mrr), 9) AS mrr, round(avg(recall), 9) AS recall FROM m",
    "metric_delta_vs_baseline": f"WITH {bm25()}, {phrases()}, {REL}, {quality('h', 'm')}, {quality('b', 'n')} SELECT query_id, round(m.ndcg - n.ndcg, 9) AS ndcg_delta, round(m.mrr - n.mrr, 9) AS mrr_delta, round(m.recall - n.recall, 9) AS recall_delta FROM m JOIN n USING (query_id)",
    "latency_percentile_disc": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, max(value) AS max FROM events GROUP BY ALL",
    "semi_join_queries": f"WITH {DOCS}, {REL} SELECT item_id AS query_id, text FROM benchmark WHERE item_id IN (SELECT query_id FROM r)",
    "anti_join_helpers": f"WITH {DOCS}, {REL} SELECT artifact_id, path FROM d WHERE artifact_id NOT IN (SELECT doc_id FROM r)",
    "sector_buckets": f"WITH {DOCS} {prints('d', 32)}",
    "dirty_sector_detect": f"""WITH {DOCS}, l AS (SELECT CAST(doc_id AS VARCHAR) AS artifact_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY ALL),
w AS (SELECT artifact_id, CASE WHEN quality = 1 THEN text || '!' ELSE text END AS text FROM d LEFT JOIN l USING (artifact_id) WHERE coalesce(toxic, 0) = 0),
x AS ({prints('w', 512)}), y AS ({prints('d', 512)})
SELECT coalesce(x.bucket, y.bucket) AS bucket, CASE WHEN y.bucket IS NULL THEN 'new' WHEN x.bucket IS NULL THEN 'gone' ELSE 'changed' END AS state FROM x FULL JOIN y ON x.bucket = y.bucket WHERE x.fingerprint IS DISTINCT FROM y.fingerprint""",
    "coverage_mode": """WITH p AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS d, count(*) FILTER (WHERE o_orderstatus = 'P') AS r, count(*) FILTER (WHERE o_orderstatus = 'F') AS c FROM orders GROUP BY ALL)
SELECT CASE WHEN d = 0 AND r = 0 THEN 'sealed' WHEN c > 0 OR r > 0 THEN 'converging' ELSE 'frontier' END AS mode, count(*) AS customers FROM p GROUP BY ALL""",
    "windowed_event_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "streaming_refresh": f"WITH {POST} SELECT term, df FROM f",
    "snippet_window": f"WITH {bm25(k=8)}, {ALONE.format('b')} SELECT query_id, rank, artifact_id, snippet FROM ({hits('z')})",
    "lexical_search": f"WITH {bm25(k=8)}, {ALONE.format('b')} {hits('z')}",
    "vector_search": f"WITH {DOCS}, {ASKED}, {SEMANTIC}, {ALONE.format('h')} {hits('z', titled('body'))}",
    "emission_protocol": f"""WITH {bm25()}, x AS (SELECT query_id, rank, artifact_id, path, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM b JOIN d USING (artifact_id))
SELECT query_id, 'turn-1' AS turn_id, '[' || string_agg('{{"artifact_id":"' || artifact_id || '","path":"' || path || '","score":' || CAST(score AS VARCHAR) || ',"confidence":"' || {BAND.format('score')} || '"}}', ',' ORDER BY rank) || ']' AS hits FROM x GROUP BY query_id""",
    "html_extract": f"SELECT artifact_id, text FROM {page_text()}",
    "agent_turn_segments": rf"""WITH c AS (SELECT *, '.quillon/context/agent-turn/' || {component("CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)")} || '.txt' AS path, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g') AS body FROM conversations WHERE text IS NOT NULL)
SELECT path || ':' || sha256(text) || '::segment:0001' AS segment_id, CAST(1 AS BIGINT) AS ordinal, 'section 1: role: ' || role AS label, CAST(strlen('role: ' || role || CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) || body END) AS BIGINT) AS bytes FROM c""",
    "response_json": f"""WITH {bm25()}, x AS (SELECT query_id, rank, artifact_id, path, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM b JOIN d USING (artifact_id))
SELECT query_id, '{{"strategy":"bm25","query_id":' || CAST(query_id AS VARCHAR) || ',"hits":[' || string_agg('{{"rank":' || CAST(rank AS VARCHAR) || ',"artifact_id":"' || artifact_id || '","path":"' || path || '","score":' || CAST(score AS VARCHAR) || ',"confidence":"' || {BAND.format('score')} || '"}}', ',' ORDER BY rank) || ']}}' AS response FROM x GROUP BY query_id""",
    "segments_blocks": f"SELECT artifact_id || '::segment:' || lpad(CAST(ordinal AS VARCHAR), 4, '0') AS segment_id, artifact_id, ordinal, label, text FROM {page_segments()}",
    "component_scores": f"""WITH {PAIRS}, r AS (SELECT a AS q, b AS x FROM pairs), k AS (SELECT q AS a, x AS b, score AS component FROM {components('r')}), t AS (SELECT q AS a, x AS b, score AS text FROM {text_scores('r')}),
u AS (SELECT a, b, regexp_replace(lower(a), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS w, lower(b) AS l FROM pairs)
SELECT a, b, round({subsequence('w', 'l')}, 9) AS subsequence, round(component, 9) AS component, round(text, 9) AS text FROM u JOIN k USING (a, b) JOIN t USING (a, b)""",
    "path_fuzzy": f"""WITH r AS (SELECT DISTINCT n_name AS q, url AS x FROM nation, pages), s AS (SELECT * FROM {path_scores('r')}),
g AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, CAST(page_id AS VARCHAR) AS artifact_id, round(score, 9) AS score FROM s JOIN nation ON n_name = q JOIN pages ON url = x WHERE round(score, 9) >= 0.78)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank, artifact_id, score FROM g QUALIFY rank <= {K}""",
    "controller_turns": f"""WITH {bm25(f"v AS (SELECT CAST(0 AS BIGINT) AS query_id, 0 AS variant_ord, '{ONE_QUERY}' AS text, 1.0::DOUBLE AS weight UNION ALL SELECT 1, 0, 'another reason', 1.0)", 5)},
ev AS (SELECT 1 AS turn, 0 AS origin, rank, path FROM b JOIN d USING (artifact_id) WHERE query_id = 0 UNION ALL SELECT 2, 1 - query_id, rank, path FROM b JOIN d USING (artifact_id)),
tu AS (SELECT turn, row_number() OVER (PARTITION BY turn ORDER BY origin, rank) - 1 AS position, path, greatest(count(*) OVER (PARTITION BY turn) - 5, 0) AS pruned FROM ev)
SELECT 'turn-' || CAST(turn AS VARCHAR) AS turn_id, CAST(position AS BIGINT) AS position, path, CAST(pruned AS BIGINT) AS pruned FROM tu WHERE position < 5""",
    "segment_fuzzy": f"WITH v AS (SELECT CAST(r_regionkey AS BIGINT) AS query_id, 0 AS variant_ord, r_name AS text, 1.0::DOUBLE AS weight FROM region), {SEGS}, {line_lane(K)} SELECT query_id, rank, artifact_id, score, location, snippet FROM sl",
    "path_hybrid": page_plan("two"),
    "legacy_hybrid": page_plan("all"),
    "page_index_qwen": page_plan("all", model=True),
}
for _name, _model in (("hybrid", False), ("splade", False), ("jina", True), ("gemma", True)):
    ORACLES[f"page_index_{_name}"] = page_plan("all", "splade", 0.5, 32, "List search terms that are related to: ", _model)
ORACLES["page_index_classified"] = page_plan("all", "classified", 0.5, 32, "Name the kind of this search, and terms for it: ")
ORACLES["page_index_llm"] = page_plan("all", "hyde", 0.7, 96, "Write a short passage that would answer this search: ", True)
