"""The same queries in DuckDB's SQL, written on their own from the definitions."""

from __future__ import annotations

from .. import schemas
from ..functions import scoring
from ..operators import dialogue as _dialogue
from . import queries as q

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]+"


def _s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


L = schemas.SENTIMENT_LABELS
CONTENT = f"""
results AS (SELECT doc_id::VARCHAR AS content_id, CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN {_s(L[3])} ELSE {_s(L[4])} END ELSE CASE WHEN quality = 1 THEN {_s(L[0])} ELSE {_s(L[2])} END END AS sentiment_label,
            (1 + quality + toxic) / 4.0::DOUBLE AS sentiment_score FROM labels),
content AS (SELECT d.doc_id::VARCHAR AS id, source AS subreddit, string_split(text, chr(10))[1] || ' ' || coalesce(text, '') AS text, n_chars AS score, 'post' AS content_type, sentiment_label, sentiment_score
            FROM documents d LEFT JOIN results r ON r.content_id = d.doc_id::VARCHAR
            UNION ALL SELECT conv_id || ':' || turn, role, text, length(text)::BIGINT, 'comment', NULL, NULL FROM conversations)"""
EVENTS = "ev AS (SELECT event_id AS id, 'u' || user_id AS subreddit, event_type AS sentiment_label, ts AS created_dt, value AS score FROM events)"
QUESTIONS = "questions(qid, question) AS (VALUES " + ", ".join(f"({i}, {_s(t)})" for i, t in q.QUESTIONS) + ")"
NAMES = "names(ord, name) AS (VALUES " + ", ".join(f"({i}, {_s(t)})" for i, t in q.NAMES) + ")"
ASKED = f"""questions(qid, question) AS (SELECT item_id::INTEGER, text || coalesce(' What is the ' || p_name || ' of ' || p_brand || '?', '') FROM benchmark LEFT JOIN part ON p_partkey = item_id
  UNION ALL SELECT -1 - i, t FROM (VALUES {", ".join(f"({i}, {_s(t)})" for i, t in q.QUESTIONS)}) v(i, t))"""
LABELS = f"""labels_(name) AS (SELECT r_name FROM region UNION SELECT n_name FROM nation UNION SELECT s_name FROM supplier UNION SELECT p_brand FROM part UNION SELECT p_type FROM part UNION SELECT p_name FROM part),
names(ord, name) AS (SELECT i, t FROM (VALUES {", ".join(f"({i}, {_s(t)})" for i, t in q.NAMES)}) v(i, t) UNION ALL SELECT (row_number() OVER (ORDER BY name) + {len(q.NAMES) - 1})::INTEGER, name FROM labels_)"""
NODES = """nodes AS (SELECT 'R:' || r_name AS name, 'Domain' AS category FROM region UNION ALL SELECT 'N:' || n_name, 'Domain' FROM nation UNION ALL SELECT 'S:' || s_suppkey, 'Tool' FROM supplier
  UNION ALL SELECT DISTINCT 'B:' || p_brand, 'Framework' FROM part UNION ALL SELECT DISTINCT 'T:' || p_type, 'Concept' FROM part UNION ALL SELECT 'P:' || p_partkey, 'Model' FROM part)"""
_BASE_EDGES = """SELECT 'N:' || n_name AS src, 'PART_OF' AS rel, 'R:' || r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'S:' || s_suppkey, 'PART_OF', 'N:' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'B:' || p_brand, 'USED_IN', 'T:' || p_type FROM part"""
EDGES = f"""edges AS ({_BASE_EDGES} UNION ALL SELECT 'P:' || p_partkey, 'IS_A', 'T:' || p_type FROM part UNION ALL SELECT 'P:' || p_partkey, 'VARIANT_OF', 'B:' || p_brand FROM part
  UNION ALL SELECT 'P:' || l_partkey, 'REQUIRES', 'S:' || l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))"""
TWO_TYPES = "rel IN ('REQUIRES', 'IS_A')"
PREREQ = "rel IN ('REQUIRES', 'IS_A', 'PART_OF')"


def _reach(start: str, hops: int, where: str = "TRUE", name: str = "reach") -> str:
    return f"""both_{name} AS (SELECT src AS a, dst AS b FROM edges WHERE {where} UNION SELECT dst, src FROM edges WHERE {where}),
walk_{name}(name, depth) AS (SELECT {_s(start)}, 0 UNION SELECT b, depth + 1 FROM walk_{name} JOIN both_{name} ON a = name WHERE depth < {hops}),
{name} AS (SELECT name, min(depth)::INTEGER AS depth FROM walk_{name} GROUP BY name)"""


CHUNKS = r"""ws AS (SELECT 'doc_' || doc_id || '.txt' AS source_file, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
cut AS (SELECT source_file, w, unnest(range(0, greatest(0, ceil((len(w) - 300) / 250.0))::INTEGER + 1)) AS i FROM ws WHERE len(w) > 0),
chunks AS (SELECT source_file, i::INTEGER AS chunk_index, source_file || '::' || i AS chunk_id, array_to_string(w[i * 250 + 1 : i * 250 + 300], ' ') AS text FROM cut)"""
RELEVANCE = rf"""parts AS (SELECT qid, list_distinct(regexp_extract_all(lower(question), '{W}{{3,}}')) AS unordered, regexp_extract_all(lower(question), '{W}{{3,}}') AS every FROM questions),
own AS (SELECT qid, list_filter(every, lambda x, i: list_position(every, x) = i) AS w FROM parts),
pairs AS (SELECT qid, w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM own)"""


def _relevance(summary: str) -> str:
    there = f"regexp_extract_all(lower({summary}), '{W}{{3,}}')"
    return f"CASE WHEN len(w) > 0 AND len({there}) > 0 THEN len(list_intersect(w, {there})) / len(w)::DOUBLE + 0.2::DOUBLE * len(list_filter(p, lambda x: contains(lower({summary}), x))) ELSE 0.0::DOUBLE END"


def _pagerank(rounds: int, d: float = 0.85) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT name, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS r FROM nodes)"]
    for i in range(rounds):
        steps.append(f"l{i} AS MATERIALIZED (SELECT coalesce(sum(r), 0) AS loose FROM r{i} WHERE name NOT IN (SELECT src FROM outs))")
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT n.name, (1 - {d}) / (SELECT count(*) FROM nodes) + {d} * (coalesce(g.got, 0) + (SELECT loose FROM l{i}) / (SELECT count(*) FROM nodes)) AS r FROM nodes n LEFT JOIN (SELECT dst, sum(r * w / o) AS got FROM r{i} JOIN links ON src = name JOIN outs USING (src) GROUP BY dst) g ON g.dst = n.name)")
    return f"WITH {NODES.replace('nodes AS', 'nodes AS MATERIALIZED', 1)}, {EDGES.replace('edges AS', 'edges AS MATERIALIZED', 1)}, outs AS MATERIALIZED (SELECT src, count(*) AS o FROM edges GROUP BY src), links AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM edges GROUP BY ALL), {', '.join(steps)} SELECT name, round(r / (SELECT max(r) FROM r{rounds}), 6) AS score FROM r{rounds}"


def _template(key: str, context: str) -> str:
    items = ", ".join(_s(t + context) for t in schemas.PROMPT_TEMPLATES)
    return f"([{items}])[(('0x' || substr(md5({key}), 1, 8))::BIGINT % {len(schemas.PROMPT_TEMPLATES)}) + 1]"


KEY = "conv_id || ':' || turn"
REPLIES = "replies AS (SELECT conv_id, turn, text || ([' [VOTE: yes]', ' I say no', '. Abstain', ' Fine. You know it', ' I say yes.', ''])[turn % 6 + 1] AS reply FROM conversations)"
VOTES = rf"""{REPLIES}, votes AS (SELECT conv_id, turn, CASE WHEN regexp_extract(upper(reply), '\[VOTE:\s*(YES|NO|ABSTAIN)\]', 1) <> '' THEN lower(regexp_extract(upper(reply), '\[VOTE:\s*(YES|NO|ABSTAIN)\]', 1))
  WHEN contains(upper(reply), 'ABSTAIN') THEN 'abstain' WHEN contains(string_split(upper(reply), '.')[-1], 'YES') THEN 'yes' WHEN contains(string_split(upper(reply), '.')[-1], 'NO') THEN 'no' ELSE 'abstain' END AS vote,
  length({_strip(r"regexp_replace(reply, '(?i)\[VOTE:\s*(YES|NO|ABSTAIN)\]', '', 'g')")})::INTEGER AS n FROM replies)"""


def _signals(patterns: list[str], x: str) -> str:
    return " + ".join(f"regexp_matches({x}, {_s(p)})::INTEGER" for p in patterns)


def _any(signals: list[str], x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {_s(s)})" for s in signals) + ")"


def _tokens(x: str) -> str:
    return f"list_distinct(regexp_split_to_array({x}, '{NW}'))"


_QL = _strip("lower(question)")
_WORDS = ", ".join(_s(w) for w in schemas.QUESTION_WORDS)
_ENTITY = f"""CASE WHEN lower(question) = lower(name) THEN 1.0::DOUBLE ELSE greatest(CASE WHEN contains(lower(question), lower(name)) THEN least(0.95::DOUBLE, 0.7::DOUBLE + length(name) / 100.0::DOUBLE) ELSE 0.0::DOUBLE END,
  len(list_intersect(list_filter({_tokens("lower(question)")}, lambda x: NOT list_contains([{_WORDS}], x)), {_tokens("lower(name)")})) / greatest(len({_tokens("lower(name)")}), 1)::DOUBLE * 0.8::DOUBLE) END"""
_ACRONYM = r"""CASE WHEN len(regexp_split_to_array({x}, '[\s\-_]+')) >= 2 AND length(array_to_string(list_transform(regexp_split_to_array({x}, '[\s\-_]+'), lambda w: left(w, 1)), '')) >= 2
  THEN lower(array_to_string(list_transform(regexp_split_to_array({x}, '[\s\-_]+'), lambda w: left(w, 1)), '')) END"""
_NEAR = """qs AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
sims AS (SELECT q_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS similarity FROM embeddings, qs),
near AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, vec_id)::INTEGER AS rn FROM sims QUALIFY rn <= 3)"""
_CLEAN = _strip(r"lower(regexp_replace(regexp_replace({x}, 'http\S+', ' ', 'g'), '[^a-zA-Z\s]', ' ', 'g'))")
_HTML = "html"
for _p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"<[^>]+>", r"&[a-z]+;"):
    _HTML = f"regexp_replace({_HTML}, {_s(_p)}, ' ', 'g')"
_HTML = _strip(rf"regexp_replace({_HTML}, '\s{{3,}}', chr(10) || chr(10), 'g')")


def _cleaned(x: str) -> str:
    for pattern, to in ((r"\[\[File:.*?\]\]", ""), (r"\[\[([^|\]]*?\|)?(.+?)\]\]", r"\2"), (r"\[.*?\]", ""), (r"\(.*?\)", "")):
        x = f"regexp_replace({x}, {_s(pattern)}, '{to}', 'g')"
    return _strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


_DIALOGUE = _cleaned("('[[File:a.png]] (waves) [[Suits|Law]] [3] ' || text)")
_MONO = _cleaned("line")


def _trend(unit: str) -> str:
    return f"SELECT date_trunc('{unit}', ts)::TIMESTAMP AS period, event_type AS sentiment_label, count(*) AS cnt FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2"


_COUNT = lambda p: f"len(regexp_extract_all(left(text, 5000), {_s(p)}))"
_QUOTES, _LINES, _WIKI = _COUNT("[\"“].{15,}?[\"”]"), _COUNT(r"(?m)^[A-Z][A-Z\s\.]+:\s*.+"), _COUNT(r"\[\[.+?\]\]|\[\d+\]")
_SIGNALS = " + ".join(f"contains(lower(left(text, 3000)), {_s(s)})::INTEGER" for s in _dialogue.PROFILE_SIGNALS)


def _starts_sql(what: str, more: str = "") -> str:
    """For every start its neighbourhood (n_<key>), and ``what`` of them."""
    parts = [f"WITH RECURSIVE {NODES}, {EDGES}"]
    for key, name, mode in q.STARTS:
        types = scoring.MODE_TYPES[mode]
        where = "rel IN (" + ", ".join(map(_s, types)) + ")" if types else "TRUE"
        parts.append(_reach(name, 2, where, f"r{key}"))
        parts.append(f"n{key} AS (SELECT {key} AS key, name, depth FROM r{key} ORDER BY depth, name LIMIT 25)")
        parts.append(f"e{key} AS (SELECT DISTINCT {key} AS key, rel, CASE WHEN src = {_s(name)} THEN '→' ELSE '←' END AS arrow, CASE WHEN src = {_s(name)} THEN dst ELSE src END AS name FROM edges WHERE {where} AND (src = {_s(name)} OR dst = {_s(name)}))")
    every = lambda t: " UNION ALL ".join(f"SELECT * FROM {t}{k}" for k, _, _ in q.STARTS)
    return ", ".join(parts) + f", around AS ({every('n')}), ends AS ({every('e')}){', ' + more if more else ''} {what}"


_CARDS = "cards AS (SELECT n.name, n.category, coalesce(s_name, p_name, split_part(n.name, ':', 2)) || '. A ' || n.category AS definition FROM nodes n LEFT JOIN supplier ON n.name = 'S:' || s_suppkey LEFT JOIN part ON n.name = 'P:' || p_partkey)"


def _context_sql() -> str:
    priority = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(schemas.RELATIONSHIP_PRIORITY))
    starts = ", ".join(f"({k}, {_s(n)})" for k, n, _ in q.STARTS)
    more = f"""{_CARDS}, starts(key, name) AS (VALUES {starts}),
told AS (SELECT a.key, a.name, a.depth, c.category, string_split(c.definition, '. ')[1] || '.' AS preview FROM around a JOIN cards c USING (name)),
rels AS (SELECT e.key, '[DIRECT RELATIONSHIPS]' || chr(10) || string_agg('  - ' || rel || ' ' || arrow || ' ' || e.name || coalesce(': ' || preview, ''), chr(10) ORDER BY coalesce(CASE rel {priority} END, 99), e.name, arrow, rel) || chr(10) AS s FROM ends e LEFT JOIN told t ON t.key = e.key AND t.name = e.name GROUP BY e.key),
far AS (SELECT * FROM told WHERE depth >= 2 QUALIFY row_number() OVER (PARTITION BY key, depth ORDER BY name) <= 8),
hop AS (SELECT key, depth, '[RELATED CONCEPTS - HOP ' || depth || ']' || chr(10) || string_agg('  - ' || name || ' (' || category || '): ' || preview, chr(10) ORDER BY name) || chr(10) AS s FROM far GROUP BY key, depth),
hops AS (SELECT key, string_agg(s, chr(10) ORDER BY depth) AS s FROM hop GROUP BY key),
whole AS (SELECT st.key, concat_ws(chr(10), '[CONCEPT: ' || st.name || ']' || chr(10) || 'Definition: ' || definition || chr(10) || 'Category: ' || category || ' | Difficulty: intermediate' || chr(10) || 'Example uses: ' || category || chr(10), rels.s, hops.s) AS t FROM starts st JOIN cards USING (name) LEFT JOIN rels ON rels.key = st.key LEFT JOIN hops ON hops.key = st.key)"""
    return _starts_sql("SELECT key, CASE WHEN length(t) > 6000 THEN left(t, 6000) || chr(10) || '...[context truncated]' ELSE t END AS context FROM whole", more)


_MEMBERS = "members AS (SELECT s_nationkey AS community_id, 'S:' || s_suppkey AS name, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, 'S:' || s_suppkey)::INTEGER AS rn FROM supplier)"

_SAFE = r"regexp_replace(regexp_replace(p_name, '[^\p{L}\p{N}_\-]', '_', 'g'), '^_+|_+$', '', 'g')"


def _way(steps: str, most: int = 8) -> str:
    """The shortest way on which each node is reached from its first parent by name."""
    return f"""walk_{steps}(name, depth) AS (SELECT {_s(q.SOURCE)}, 0 UNION SELECT b, depth + 1 FROM walk_{steps} JOIN {steps} ON a = name WHERE depth < {most}),
depth_{steps} AS (SELECT name, min(depth) AS depth FROM walk_{steps} GROUP BY name),
tree_{steps}(name, way) AS (SELECT {_s(q.SOURCE)}, [{_s(q.SOURCE)}] UNION ALL SELECT b, list_append(arg_min(way, t.name), b) FROM tree_{steps} t JOIN {steps} ON a = t.name JOIN depth_{steps} p ON p.name = t.name JOIN depth_{steps} x ON x.name = b AND x.depth = p.depth + 1 WHERE x.depth <= (SELECT depth FROM depth_{steps} WHERE name = {_s(q.TARGET)}) GROUP BY b),
best_{steps} AS (SELECT any_value(way) AS way FROM tree_{steps} WHERE name = {_s(q.TARGET)})"""


def _report(examples: str) -> str:
    """The validation report of ``e`` (character, assistant, whole)."""
    sizes = "SELECT character, count(*) AS cnt, round(avg(length(assistant) // 4), 6) AS avg_tokens, min(length(assistant) // 4) AS min_tokens, max(length(assistant) // 4) AS max_tokens, round(avg(length(assistant)), 6) AS avg_chars, min(length(assistant)) AS min_chars, max(length(assistant)) AS max_chars, (count(*) < 30)::INTEGER AS low FROM e GROUP BY character"
    lengths = "SELECT round(avg(t), 6) AS avg_tokens, min(t) AS min_tokens, max(t) AS max_tokens, median(t)::DOUBLE AS median_tokens, count(*) FILTER (t > 2048) AS too_long FROM (SELECT length(whole) // 4 AS t FROM e)"
    balance = "SELECT max(n) AS most, min(n) AS least, round(max(n) / min(n)::DOUBLE, 6) AS ratio FROM (SELECT count(*) AS n FROM e GROUP BY character)"

    def rows(table: str, section: str, name: str, columns: str) -> str:
        return " UNION ALL ".join(f"SELECT '{section}' AS section, {name} AS name, '{c}' AS measure, {c}::DOUBLE AS value FROM {table}" for c in columns.split())

    parts = [
        rows("sizes", "class", "character", "cnt avg_tokens min_tokens max_tokens avg_chars min_chars max_chars low"),
        rows("(SELECT count(*) AS groups FROM repeats)", "duplicates", "NULL", "groups"),
        rows("(SELECT * FROM repeats ORDER BY cnt DESC, text_sha LIMIT 5)", "duplicates", "text_sha", "cnt"),
        rows("lengths", "sequence", "NULL", "avg_tokens min_tokens max_tokens median_tokens too_long"),
        rows("balance", "balance", "NULL", "most least ratio"),
    ]
    return f"{examples}, sizes AS ({sizes}), lengths AS ({lengths}), balance AS ({balance}), repeats AS (SELECT sha256(assistant) AS text_sha, count(*) AS cnt FROM e GROUP BY 1 HAVING count(*) > 1) " + " UNION ALL ".join(parts)

_CHATS = f"WITH c AS (SELECT *, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations) SELECT conv_id AS source, turn AS pos, 'You are ' || role || '. Answer briefly.' AS system, CASE WHEN context <> '' THEN 'The conversation so far:' || chr(10) || context || chr(10) || chr(10) || 'How do you respond?' ELSE {_template(KEY, 'a new proposal being discussed')} END AS \"user\", text AS assistant FROM c WHERE role IN ('assistant', 'user')"


def oracle_sql() -> dict[str, str]:
    """SQL by query name; what only iterations or models can do has none."""
    priority = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(schemas.RELATIONSHIP_PRIORITY))
    return {
        "content_union": f"WITH {CONTENT} SELECT * FROM content",
        "label_counts_pivot": f"WITH {CONTENT} SELECT subreddit, " + ", ".join(f"count(*) FILTER (sentiment_label = {_s(x)}) AS \"{x}\"" for x in L) + " FROM content WHERE sentiment_label IS NOT NULL GROUP BY subreddit",
        "label_counts_long": f"WITH {CONTENT} SELECT subreddit, sentiment_label, count(*) AS cnt FROM content WHERE sentiment_label IS NOT NULL GROUP BY 1, 2",
        "trend_day": _trend("day"),
        "trend_week": _trend("week"),
        "trend_month": _trend("month"),
        "label_share": f"WITH {CONTENT} SELECT subreddit, sentiment_label, count(*) AS cnt, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY subreddit), 6) AS share FROM content WHERE sentiment_label IS NOT NULL GROUP BY 1, 2",
        "weekly_share": f"SELECT *, round(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY period), 6) AS share FROM ({_trend('week')})",
        "kpi_row": f"WITH {CONTENT} SELECT count(*) AS rows, count(DISTINCT subreddit) AS groups, count(sentiment_label) AS labelled, (SELECT sentiment_label FROM content WHERE sentiment_label IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_label FROM content",
        "top_posts": f"WITH {CONTENT} SELECT id, score, sentiment_label FROM content WHERE subreddit = 'src0' AND content_type = 'post' ORDER BY score DESC, id LIMIT 10",
        "recent_500": "SELECT event_id AS id, ts AS created_dt, event_type AS sentiment_label FROM events ORDER BY ts DESC, event_id LIMIT 500",
        "filtered_content": f"WITH {EVENTS} SELECT * FROM ev WHERE created_dt::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND sentiment_label IS NOT NULL",
        "date_bounds": "SELECT min(ts)::DATE AS first_day, max(ts)::DATE AS last_day FROM events",
        "label_value_counts": f"WITH {CONTENT} SELECT sentiment_label, count(*) AS cnt FROM content WHERE sentiment_label IS NOT NULL AND subreddit = 'src1' GROUP BY 1",
        "row_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS cnt FROM {t}" for t in ("documents", "conversations", "labels", "events")),
        "token_freq_topk": f"WITH {CONTENT}, w AS (SELECT sentiment_label, unnest(regexp_split_to_array({_CLEAN.format(x='text')}, '\\s+')) AS word FROM content WHERE sentiment_label IS NOT NULL), c AS (SELECT sentiment_label, word, count(*) AS cnt FROM w WHERE length(word) >= 4 GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY sentiment_label ORDER BY cnt DESC, word)::INTEGER AS rn FROM c QUALIFY rn <= 80",
        "topk_per_group": "SELECT conv_id || ':' || turn AS id, conv_id::VARCHAR AS post_id, text AS body FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 5 AND text NOT IN ('[deleted]', '[removed]', '')",
        "listing_top": "SELECT doc_id::VARCHAR AS id, nullif(source, '') AS subreddit, string_split(text, chr(10))[1] AS title, n_chars AS score FROM documents QUALIFY row_number() OVER (PARTITION BY nullif(source, '') ORDER BY n_chars DESC NULLS LAST, doc_id::VARCHAR) <= 25",
        "new_rows_anti": "SELECT doc_id::VARCHAR AS id, source AS subreddit FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "upsert_latest": f"WITH {CONTENT} SELECT content_id, sentiment_label, CASE WHEN sentiment_label = {_s(L[2])} THEN 0.125 ELSE sentiment_score END::DOUBLE AS sentiment_score FROM results",
        "dup_groups": "SELECT sha256(text) AS text_sha, count(*) AS cnt FROM documents GROUP BY text HAVING count(*) > 1",
        "missing_dim": "SELECT role FROM (VALUES ('assistant'), ('narrator'), ('system'), ('user')) v(role) WHERE role NOT IN (SELECT role FROM conversations)",
        "clean_text": f"SELECT doc_id, {_CLEAN.format(x='text')} AS clean FROM documents",
        "build_text": f"SELECT doc_id::VARCHAR AS id, coalesce(nullif(left({_strip('string_split(text, chr(10))[1] || chr(32) || text')}, 2048), ''), 'no content') AS built FROM documents",
        "html_to_text": f"SELECT page_id, CASE WHEN length({_HTML}) >= 100 THEN left({_HTML}, 8000) END AS text FROM pages",
        "safe_name": r"SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^\p{L}\p{N}_\-]', '_', 'g'), '^_+|_+$', '', 'g') AS safe, replace(lower(p_name), ' ', '_') AS slug FROM part",
        "acronyms": f"SELECT p_partkey, {_ACRONYM.format(x='p_name')} AS acronym FROM part",
        "first_sentence": "SELECT doc_id, string_split(text, '. ')[1] || '.' AS first FROM documents",
        "clean_dialogue": f"SELECT conv_id, turn, {_DIALOGUE} AS clean FROM conversations",
        "truncate_words": r"SELECT doc_id, CASE WHEN len(w) <= 40 THEN text ELSE array_to_string(w[1:40], ' ') || '...' END AS short FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)",
        "scalar_misc": r"SELECT c_custkey, length(c_name) // 4 AS tokens, format('{:,}', c_custkey) AS thousands, regexp_replace(c_name, '[\s.]+', '_', 'g') AS stem, '#' || " + " || ".join(f"lpad(lower(to_hex(floor(v{k} + (255 - v{k}) * 0.5)::BIGINT)), 2, '0')" for k in range(3)) + r" AS light, 15 + floor(c_custkey / 20000.0::DOUBLE * 35)::INTEGER AS size, [c_name, c_mktsegment] AS listed FROM (SELECT *, c_custkey // 65536 % 256 AS v0, c_custkey // 256 % 256 AS v1, c_custkey % 256 AS v2 FROM customer)",
        "json_triples": "SELECT 'REQUIRES' AS rel, 'S:' || l_suppkey AS dst, count(*) AS cnt FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 2",
        "chunk_documents": f"WITH {CHUNKS} SELECT * FROM chunks",
        "chunk_stats": f"WITH {CHUNKS} SELECT source_file, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY 1",
        "context_window": "SELECT conv_id AS source, turn AS pos, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations",
        "conversation_history": "SELECT conv_id AS source, turn AS pos, sha256(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn)) AS history_sha FROM conversations",
        "chat_examples": _CHATS,
        "rendered_chats": f"SELECT '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || 'You are ' || role || '. Answer briefly.<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || {_template(KEY, 'a new business idea')} || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>' AS rendered, role AS who FROM conversations WHERE role IN ('assistant', 'user')",
        "split_train_val": "SELECT conv_id AS source, turn AS pos, CASE WHEN ('0x' || substr(md5('42|' || conv_id || ':' || turn), 1, 8))::BIGINT % 100 < 10 THEN 'val' ELSE 'train' END AS part FROM conversations",
        "sample_classes": "SELECT role AS character, conv_id AS source, turn AS pos, row_number() OVER (PARTITION BY role ORDER BY md5('42|' || conv_id || ':' || turn))::INTEGER AS rn FROM conversations QUALIFY rn <= 5",
        "role_length_stats": "SELECT role, count(*) AS cnt, round(avg(length(text) // 4), 6) AS avg_tokens, min(length(text) // 4) AS min_tokens, max(length(text) // 4) AS max_tokens, round(avg(length(text)), 6) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars FROM conversations GROUP BY role",
        "seq_length_stats": "SELECT round(avg(t), 6) AS avg_tokens, min(t) AS min_tokens, max(t) AS max_tokens, median(t)::DOUBLE AS median_tokens, count(*) FILTER (t > 2048) AS too_long FROM (SELECT length(text) // 4 AS t FROM documents)",
        "class_balance": "SELECT most, least, round(most / least::DOUBLE, 6) AS ratio, CASE WHEN most / least::DOUBLE > 5 THEN 'imbalanced' WHEN most / least::DOUBLE > 2 THEN 'moderate' ELSE 'balanced' END AS verdict FROM (SELECT max(n) AS most, min(n) AS least FROM (SELECT count(*) AS n FROM conversations GROUP BY role))",
        "gap_plan": "SELECT role, n AS have, 100 - n AS need FROM (SELECT v.role, count(c.role) AS n FROM (VALUES ('assistant'), ('narrator'), ('system'), ('user')) v(role) LEFT JOIN conversations c USING (role) GROUP BY 1) WHERE n < 100",
        "classify_files": f"SELECT doc_id, CASE WHEN {_SIGNALS} >= 2 THEN 'profile' WHEN {_QUOTES} >= 5 THEN 'quotes' WHEN {_LINES} >= 5 OR ({_LINES} >= 2 AND {_WIKI} >= 3) THEN 'script' WHEN {_WIKI} >= 10 AND {_LINES} < 3 THEN 'profile' WHEN {_SIGNALS} >= 1 THEN 'profile' ELSE 'script' END AS kind FROM documents",
        "parse_vote": f"WITH {VOTES} SELECT * FROM votes",
        "vote_tally": f"WITH {VOTES}, t AS (SELECT conv_id, count(*) FILTER (vote = 'yes') AS yes, count(*) FILTER (vote = 'no') AS no, count(*) FILTER (vote = 'abstain') AS abstain FROM votes GROUP BY 1) SELECT *, " + ", ".join(f"round({v} * 100.0::DOUBLE / greatest(yes + no + abstain, 1), 4) AS {v}_percent" for v in ("yes", "no", "abstain")) + ", CASE WHEN yes > no THEN 'APPROVED' WHEN no > yes THEN 'REJECTED' ELSE 'SPLIT' END AS verdict FROM t",
        "route_queries": f"WITH {ASKED} SELECT qid, CASE WHEN {_signals(scoring.GLOBAL_SIGNALS, _QL)} > {_signals(scoring.LOCAL_SIGNALS, _QL)} THEN 'global' ELSE 'local' END AS route, CASE " + " ".join(f"WHEN {_any(s, 'lower(question)')} THEN '{m}'" for m, s in scoring.MODE_SIGNALS.items()) + " ELSE 'standard' END AS mode FROM questions",
        "entity_scores": f"WITH {ASKED}, {LABELS} SELECT qid, name, round({_ENTITY}, 6) AS score FROM questions, names WHERE round({_ENTITY}, 6) > 0",
        "entity_best": f"WITH {ASKED}, {LABELS}, ac AS (SELECT {_ACRONYM.format(x='name')} AS a, min(name) AS name FROM names GROUP BY 1), asked AS (SELECT qid, unnest(regexp_split_to_array(lower(question), '{NW}')) AS a, unnest(range(len(regexp_split_to_array(lower(question), '{NW}')))) AS pos FROM questions), short AS (SELECT qid, arg_min(name, pos) AS short FROM asked JOIN ac USING (a) GROUP BY 1), s AS (SELECT qid, name, ord, {_ENTITY} AS score FROM questions, names), best AS (SELECT qid, name, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) = 1) SELECT qid, coalesce(short, name) AS name, round(CASE WHEN short IS NOT NULL THEN 0.92::DOUBLE ELSE coalesce(score, 0) END, 6) AS confidence FROM questions LEFT JOIN short USING (qid) LEFT JOIN best USING (qid)",
        "search_concepts": "WITH s AS (SELECT 'P:' || p_partkey AS name, CASE WHEN lower('P:' || p_partkey) = 'red' THEN 10 WHEN contains(lower('P:' || p_partkey), 'red') THEN 5 ELSE 0 END + CASE WHEN contains(lower(p_name || '. Made by ' || p_brand), 'red') THEN 2 ELSE 0 END + CASE WHEN contains(lower(p_type), 'red') OR contains(lower(p_brand), 'red') THEN 1 ELSE 0 END AS score FROM part) SELECT name, score FROM s WHERE score > 0 ORDER BY score DESC, name DESC LIMIT 10",
        "community_rank": f"WITH {QUESTIONS}, {RELEVANCE}, s AS (SELECT qid, doc_id::INTEGER AS community_id, round({_relevance('text')}, 6) AS score FROM documents, pairs WHERE length(text) > 0), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, community_id)::INTEGER AS rn FROM s QUALIFY rn <= 5) SELECT * FROM t QUALIFY score > 0 OR max(score) OVER (PARTITION BY qid) = 0",
        "fallback_answers": rf"WITH {QUESTIONS}, {RELEVANCE}, s AS (SELECT qid, doc_id::INTEGER AS community_id, text, round({_relevance('text')}, 6) AS score FROM documents, pairs WHERE length(text) > 0), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, community_id) AS rn FROM s QUALIFY rn <= 5), k AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w2 FROM t QUALIFY score > 0 OR max(score) OVER (PARTITION BY qid) = 0) SELECT qid, string_agg(CASE WHEN len(w2) <= 20 THEN text ELSE array_to_string(w2[1:20], ' ') || '...' END, chr(10) || chr(10) ORDER BY rn) AS answer FROM k GROUP BY qid",
        "flagship": f"WITH {QUESTIONS}, {RELEVANCE}, {CHUNKS}, s AS (SELECT qid, chunk_id, round({_relevance('text')}, 6) AS score FROM chunks, pairs) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INTEGER AS rn FROM s WHERE score > 0 QUALIFY rn <= 5",
        "cosine_topk": f"WITH {_NEAR} SELECT * FROM near",
        "cosine_topk_excluding": f"WITH {_NEAR} SELECT * FROM near WHERE vec_id NOT IN (0, 100, 200)",
        "context_text": f"""WITH {EDGES}, known AS (SELECT 'P:' || p_partkey AS name, p_name || '. Made by ' || p_brand AS definition FROM part),
lines AS (SELECT src AS name, rel, '→' AS arrow, dst AS other FROM edges UNION ALL SELECT dst, rel, '←', src FROM edges WHERE src <> dst),
told AS (SELECT l.name, string_agg('  - ' || rel || ' ' || arrow || ' ' || other || coalesce(': ' || string_split(k.definition, '. ')[1] || '.', ''), chr(10) ORDER BY coalesce(CASE rel {priority} END, 99), other, arrow, rel) AS r FROM lines l LEFT JOIN known k ON k.name = l.other GROUP BY 1),
full_ AS (SELECT name, '[CONCEPT: ' || name || ']' || chr(10) || 'Definition: ' || definition || chr(10) || 'Category: Model | Difficulty: intermediate' || chr(10) || coalesce(chr(10) || '[DIRECT RELATIONSHIPS]' || chr(10) || r || chr(10), '') AS t FROM known LEFT JOIN told USING (name))
SELECT name, CASE WHEN length(t) > 6000 THEN left(t, 6000) || chr(10) || '...[context truncated]' ELSE t END AS context FROM full_""",
        "graph_stats": f"WITH {NODES}, {EDGES} SELECT (SELECT count(*) FROM (SELECT DISTINCT name FROM nodes)) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT * FROM edges)) AS edges",
        "graph_stubs": "SELECT DISTINCT 'L:' || l_linenumber AS name FROM lineitem",
        "neighbors_khop": f"WITH RECURSIVE {EDGES}, {_reach(q.SOURCE, 2)} SELECT name, depth FROM reach ORDER BY depth, name LIMIT 25",
        "neighbors_edges": f"WITH RECURSIVE {EDGES}, {_reach(q.SOURCE, 2)} SELECT DISTINCT src, rel, dst FROM edges WHERE src IN (SELECT name FROM reach WHERE depth < 2) OR dst IN (SELECT name FROM reach WHERE depth < 2)",
        "neighbors_filtered": f"WITH RECURSIVE {EDGES}, {_reach(q.SOURCE, 4, PREREQ)} SELECT name, depth FROM reach ORDER BY depth, name LIMIT 25",
        "closure": f"WITH RECURSIVE {EDGES}, c(name) AS (SELECT dst FROM edges WHERE src = 'P:1' AND {PREREQ} UNION SELECT dst FROM c JOIN edges ON src = name WHERE {PREREQ}) SELECT name FROM c",
        "path_length": f"WITH RECURSIVE {EDGES}, {_reach(q.SOURCE, 8, PREREQ, 'pre')}, {_reach(q.SOURCE, 8, 'TRUE', 'every_')} SELECT coalesce((SELECT depth FROM pre WHERE name = {_s(q.TARGET)}), (SELECT depth FROM every_ WHERE name = {_s(q.TARGET)}), 1)::BIGINT AS steps",
        "curriculum_levels": f"WITH RECURSIVE {EDGES}, c(name) AS (SELECT 'P:1' UNION SELECT dst FROM c JOIN edges ON src = name WHERE {PREREQ}), n AS (SELECT DISTINCT src, dst FROM edges WHERE {PREREQ} AND src IN (SELECT name FROM c)), d(name, level) AS (SELECT name, 0 FROM c UNION SELECT n.src, d.level + 1 FROM d JOIN n ON n.dst = d.name), m AS (SELECT name, max(level) AS level FROM d GROUP BY 1) SELECT CASE WHEN name = 'P:1' THEN (SELECT max(level) + 1 FROM m) ELSE level END::INTEGER AS level, name FROM m",
        "compare": f"WITH RECURSIVE {EDGES}, {_reach('P:1', 2, TWO_TYPES, 'ra')}, {_reach('P:2', 2, TWO_TYPES, 'rb')} SELECT CASE WHEN a.name IS NULL THEN 'only_b' WHEN b.name IS NULL THEN 'only_a' ELSE 'shared' END AS side, coalesce(a.name, b.name) AS name FROM (SELECT name FROM ra WHERE depth > 0) a FULL JOIN (SELECT name FROM rb WHERE depth > 0) b ON a.name = b.name",
        "pagerank": _pagerank(120),
        "category_heatmap": f"WITH {NODES}, {EDGES}, p AS (SELECT a.category AS from_cat, b.category AS to_cat, rel, count(*) AS n FROM edges JOIN nodes a ON a.name = src JOIN nodes b ON b.name = dst GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY from_cat, to_cat ORDER BY n DESC, rel) AS rn FROM p), cells AS (SELECT from_cat, to_cat, sum(n)::BIGINT AS cnt, string_agg(rel, ',' ORDER BY rn) FILTER (rn <= 4) AS top_types FROM r GROUP BY 1, 2), cats AS (SELECT DISTINCT category FROM nodes) SELECT x.category AS from_cat, y.category AS to_cat, coalesce(cnt, 0)::BIGINT AS cnt, coalesce(top_types, '') AS top_types FROM cats x CROSS JOIN cats y LEFT JOIN cells ON from_cat = x.category AND to_cat = y.category",
        "category_rollup": f"WITH {NODES}, s AS (SELECT category, name, CASE WHEN name LIKE 'S:%' THEN 0.5 ELSE 0.01 END::DOUBLE AS score FROM nodes) SELECT category, name, count(*) AS cnt, round(sum(score), 6) AS total FROM s GROUP BY ROLLUP (category, name)",
        "edges_within": f"WITH {NODES}, {EDGES} SELECT DISTINCT src, rel, dst FROM edges WHERE src IN (SELECT name FROM nodes WHERE category IN ('Domain', 'Tool')) AND dst IN (SELECT name FROM nodes WHERE category IN ('Domain', 'Tool'))",
        "concept_list": "SELECT 'P:' || p_partkey AS name, CASE WHEN p_size / 64.0::DOUBLE > 0.4 THEN p_size / 64.0::DOUBLE ELSE 0.0 END AS score FROM part",
        "ingest_counts": "SELECT (SELECT count(*) FROM lineitem) AS triples, (SELECT count(*) FROM lineitem) AS new_relationships, (SELECT count(DISTINCT l_linenumber) FROM lineitem) AS new_concepts",
        "drawn_nodes": f"WITH {NODES} SELECT n.name, 15 + floor(coalesce(greatest(s_acctbal, 0), 0) / (SELECT max(s_acctbal) FROM supplier) * 35)::INTEGER AS size, n.name = {_s(q.SOURCE)} AS highlighted FROM (SELECT DISTINCT name FROM nodes) n LEFT JOIN supplier ON n.name = 'S:' || s_suppkey",
        "prompt_counts": "SELECT CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS character, count(*)::BIGINT AS cnt FROM conversations WHERE role IN ('assistant', 'user') GROUP BY 1",
        "topic_texts": f"WITH t AS (SELECT doc_id::VARCHAR AS id, source AS subreddit, string_split(text, chr(10))[1] || ' ' || text AS text FROM documents UNION ALL SELECT conv_id || ':' || turn, role, text FROM conversations) SELECT id, subreddit, sha256({_CLEAN.format(x='text')}) AS clean_sha FROM t WHERE {_CLEAN.format(x='text')} <> ''",
        "monologues": f"WITH l AS (SELECT doc_id AS source, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), s AS (SELECT source, pos::INTEGER AS pos, {_strip('raw')} AS line FROM l), c AS (SELECT source, pos, {_MONO} AS said FROM s WHERE length(line) >= 20 AND NOT regexp_matches(lower(line), '^(character overview|personality|speech style|cultural legacy|iconic moments)')) SELECT source, pos, sha256(said) AS line_sha FROM c WHERE length(said) > 20",
        "incident_edges": f"WITH {EDGES} SELECT rel, CASE WHEN src = {_s(q.SOURCE)} THEN 'out' ELSE 'in' END AS direction, count(*) AS n, string_agg(o, ',' ORDER BY o) AS others FROM (SELECT *, CASE WHEN src = {_s(q.SOURCE)} THEN dst ELSE src END AS o FROM edges WHERE src = {_s(q.SOURCE)} OR dst = {_s(q.SOURCE)}) GROUP BY 1, 2",
        "subgraph_nodes": _starts_sql("SELECT * FROM around"),
        "assembled_context": _context_sql(),
        "direct_nodes": f"WITH RECURSIVE {EDGES}, {_reach(q.SOURCE, 1)} SELECT name, depth FROM reach ORDER BY depth, name LIMIT 25",
        "use_case_nodes": f"WITH {EDGES}, s AS (SELECT 'B:' || min(p_brand) AS name FROM part), one AS (SELECT dst AS name FROM edges, s WHERE rel IN ('USED_IN', 'BUILT_WITH') AND src = name UNION SELECT src FROM edges, s WHERE rel IN ('USED_IN', 'BUILT_WITH') AND dst = name), two AS (SELECT dst AS name FROM edges WHERE rel IN ('USED_IN', 'BUILT_WITH') AND src IN (FROM one) UNION SELECT src FROM edges WHERE rel IN ('USED_IN', 'BUILT_WITH') AND dst IN (FROM one)), every AS (SELECT name, 0 AS depth FROM s UNION ALL SELECT name, 1 FROM one UNION ALL SELECT name, 2 FROM two) SELECT name, min(depth)::INTEGER AS depth FROM every GROUP BY name ORDER BY 2, 1 LIMIT 25",
        "canonical_node": f"WITH {NODES} SELECT name, category FROM nodes WHERE lower(name) = 's:1' ORDER BY name LIMIT 1",
        "comparison_lists": f"WITH RECURSIVE {EDGES}, {_reach('P:1', 2, TWO_TYPES, 'ra')}, {_reach('P:2', 2, TWO_TYPES, 'rb')}, c AS (SELECT CASE WHEN a.name IS NULL THEN 'only_b' WHEN b.name IS NULL THEN 'only_a' ELSE 'shared' END AS side, coalesce(a.name, b.name) AS name FROM (SELECT name FROM ra WHERE depth > 0) a FULL JOIN (SELECT name FROM rb WHERE depth > 0) b ON a.name = b.name) SELECT side, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY side ORDER BY name) <= 8) GROUP BY side",
        "community_top_members": f"WITH {_MEMBERS} SELECT community_id, name, rn FROM members WHERE rn <= 10",
        "community_prompts": f"WITH {_MEMBERS} SELECT community_id, string_agg(name, ',' ORDER BY name) AS names, string_agg('- ' || name || ': ' || s_name || '. A Tool', chr(10) ORDER BY rn) FILTER (rn <= 10) AS details FROM members GROUP BY community_id",
        "vector_index": f"WITH {NODES}, {_CARDS}, rows_ AS (SELECT replace(lower(name), ' ', '_') AS id, name || chr(10) || definition || chr(10) || 'Category: ' || category || chr(10) || 'Difficulty: intermediate' || chr(10) || 'Use cases: ' || category AS document, name FROM cards), one AS (SELECT id, document FROM rows_ QUALIFY row_number() OVER (PARTITION BY id ORDER BY name DESC) = 1), w AS (SELECT id, unnest(list_filter({_tokens('lower(document)')}, lambda x: x <> '')) AS w FROM one), c AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot, count(*) AS n FROM w GROUP BY 1, 2) SELECT id, any_value(document) AS document, string_agg(slot || ':' || n, ',' ORDER BY slot) AS slots FROM one JOIN c USING (id) GROUP BY id",
        "candidate_names": f"WITH {ASKED}, {LABELS}, s AS (SELECT qid, name, len(list_intersect({_tokens('lower(question)')}, {_tokens('lower(name)')})) AS n FROM questions, names), told AS (SELECT qid, string_agg(name, ', ' ORDER BY n DESC, name DESC) AS told FROM (SELECT * FROM s WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, name DESC) <= 30) GROUP BY qid) SELECT qid, coalesce(told, (SELECT string_agg(name, ', ' ORDER BY ord) FROM names WHERE ord < 30)) AS listed FROM questions LEFT JOIN told USING (qid)",
        "name_suggestions": "WITH a(qid, w) AS (VALUES (0, 'red'), (1, 'steel'), (2, 'nothing')), s AS (SELECT qid, 'P:' || p_partkey AS name, CASE WHEN lower('P:' || p_partkey) = w THEN 10 WHEN contains(lower('P:' || p_partkey), w) THEN 5 ELSE 0 END + CASE WHEN contains(lower(p_name || '. Made by ' || p_brand), w) THEN 2 ELSE 0 END + CASE WHEN contains(lower(p_type), w) OR contains(lower(p_brand), w) THEN 1 ELSE 0 END AS score FROM part, a) SELECT qid, name, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name DESC)::INTEGER AS rn FROM s WHERE score > 0 QUALIFY rn <= 5",
        "resumed_chunks": f"WITH {CHUNKS}, done AS (SELECT 'doc_' || doc_id || '.txt' AS f FROM labels) SELECT count(*) FILTER (source_file NOT IN (FROM done)) AS chunks_processed, count(*) FILTER (source_file IN (FROM done)) AS chunks_skipped FROM chunks",
        "line_counts": "SELECT character, n AS cnt, CASE WHEN n = 0 THEN 'MISSING' WHEN n < 30 THEN 'LOW' ELSE 'OK' END AS status FROM (SELECT v.character, count(c.role) AS n FROM (VALUES ('assistant'), ('narrator'), ('system'), ('user')) v(character) LEFT JOIN conversations c ON c.role = v.character GROUP BY 1)",
        "duplicate_report": "WITH g AS (SELECT sha256(text) AS text_sha, count(*) AS cnt FROM documents GROUP BY text HAVING count(*) > 1) SELECT text_sha, cnt, (SELECT count(*) FROM g) AS groups, row_number() OVER (ORDER BY cnt DESC, text_sha)::INTEGER AS rn FROM g QUALIFY rn <= 5",
        "fetch_titles": "SELECT p_partkey, CASE WHEN contains(name, '/') OR (length(name) <= 2) OR name = 'goldenrod' THEN NULL WHEN name = 'ab' THEN 'about' ELSE name END AS title FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name || '/x' WHEN p_partkey % 11 = 0 THEN 'ab' ELSE p_name END AS name FROM part)",
        "stream_upsert": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "stream_dedupe": "SELECT date_trunc('day', ts)::TIMESTAMP AS period, event_type, count(*) AS cnt FROM (SELECT DISTINCT ON (event_id) * FROM events ORDER BY ALL) GROUP BY 1, 2",
        "stream_trend": "SELECT date_trunc('day', ts)::TIMESTAMP AS period, event_type, count(DISTINCT event_id) AS cnt FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2",
        "learning_path": f"WITH RECURSIVE {EDGES}, {NODES}, {_CARDS}, pre AS (SELECT src AS a, dst AS b FROM edges WHERE {PREREQ} UNION SELECT dst, src FROM edges WHERE {PREREQ}), {_way('pre')}, every_ AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), {_way('every_')}, best AS (SELECT coalesce((SELECT way FROM best_pre), (SELECT way FROM best_every_), [{_s(q.SOURCE)}, {_s(q.TARGET)}]) AS way), steps AS (SELECT unnest(way) AS name, unnest(range(0, len(way)))::INTEGER AS place FROM best) SELECT place, name, definition, category FROM steps LEFT JOIN cards USING (name)",
        "study_plan": f"WITH RECURSIVE {EDGES}, {NODES}, {_CARDS}, c(name) AS (SELECT 'P:1' UNION SELECT dst FROM c JOIN edges ON src = name WHERE {PREREQ}), n AS (SELECT DISTINCT src, dst FROM edges WHERE {PREREQ} AND src IN (SELECT name FROM c)), d(name, level) AS (SELECT name, 0 FROM c UNION SELECT n.src, d.level + 1 FROM d JOIN n ON n.dst = d.name), m AS (SELECT name, max(level) AS level FROM d GROUP BY 1) SELECT CASE WHEN name = 'P:1' THEN (SELECT max(level) + 1 FROM m) ELSE level END::INTEGER AS level, name, definition FROM m JOIN cards USING (name) WHERE lower(name) NOT IN ('r:region_0', lower({_s(q.SOURCE)}))",
        "dataset_report": _report("WITH examples AS (" + _CHATS + r'''), e AS (SELECT regexp_extract(system, '^You are (.*?)\. ', 1) AS character, assistant, system || ' ' || "user" || ' ' || assistant AS whole FROM examples)'''),
        "seeded_corpus": rf"WITH f AS (SELECT p_partkey, p_name AS name, {_SAFE} AS safe, p_brand, p_type FROM part), have AS (SELECT DISTINCT safe || '_wiki.txt' AS file FROM f WHERE p_partkey % 2 = 0), lost AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM have WHERE starts_with(file, safe || '_'))), made AS (SELECT name, safe || '_seed.txt' AS source_file, '# ' || name || chr(10) || chr(10) || 'Category: Model | Difficulty: intermediate' || chr(10) || chr(10) || 'Source: Seed knowledge base' || chr(10) || chr(10) || chr(10) || '## Definition' || chr(10) || chr(10) || name || ' by ' || p_brand || chr(10) || chr(10) || '## Example Use Cases' || chr(10) || chr(10) || '- ' || p_type AS text FROM lost) SELECT DISTINCT ON (source_file) source_file, text FROM made ORDER BY source_file, name, text",
    }
