"""DuckDB SQL of the registered queries, over the same tables."""

from __future__ import annotations

from quernstone.config import LONG_SUFFIXES, OFFICIAL_DOMAINS, SENSITIVE_PATTERNS, SHORT_SUFFIXES, STEP_STOP_WORDS, STOP_WORDS, VISITOR_DOMAINS, AnswerParams, Topic
from quernstone.plans.dims import DOMAINS, FIXED_QUERIES, FLOW_STEPS, FLOWS, FOLLOW_UPS, INTENTS, LABELS, LINKS, PAGE_QUERY, STEP_PARTS, STEPS, TASKS, TOPIC_PHRASES, TOPICS, VISITOR


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def names(xs) -> str:
    return ", ".join(map(lit, xs))


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[^\p{{L}}\p{{N}}\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


def route(x: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def stem(w: str) -> str:
    return f"CASE WHEN regexp_full_match({w}, '[a-z]{{5,}}') THEN regexp_replace(regexp_replace({w}, '({'|'.join(LONG_SUFFIXES)})$', ''), '({'|'.join(SHORT_SUFFIXES)})$', '') ELSE {w} END"


def toks(n: str) -> str:
    return f"list_transform(list_filter(string_split({n}, ' '), lambda w: length(w) > 2 AND w NOT IN ({names(STOP_WORDS)})), lambda w: {stem('w')})"


DOCS = "SELECT doc_id AS ord, source AS url, text, '' AS title FROM documents"
ASKED = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {lit(t)})" for i, t in FIXED_QUERIES) + ") v(query_id, text)"


def index(passages: str) -> str:
    return f"""p AS (SELECT ord, url, {norm('text')} AS body, {norm('title')} AS head FROM ({passages}) WHERE trim(coalesce(text, '')) <> ''),
tk AS (SELECT ord, url, body, head, {toks('body')} AS bt, list_distinct({toks('head')}) AS ht FROM p),
st AS (SELECT count(*) AS n, coalesce(avg(len(bt)), 1.0) AS avg_length FROM tk),
po AS (SELECT ord, term, sum(tf) AS tf, max(t) AS in_title FROM (SELECT ord, unnest(bt) AS term, 1 AS tf, 0 AS t FROM tk UNION ALL SELECT ord, unnest(ht), 0, 1 FROM tk) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term)"""


def analyzed(asked: str, topics: list[Topic]) -> str:
    """query_id, normalized, terms (distinct, in first order), paths."""

    def fires(t: Topic) -> str:
        return "(" + " OR ".join(f"contains(normalized, {lit(x)})" for x in t.phrases) + ")"

    terms = "".join(f" || CASE WHEN {fires(t)} THEN list_transform([{names(t.terms)}]::VARCHAR[], lambda w: {stem('w')}) ELSE []::VARCHAR[] END" for t in topics)
    paths = "[]::VARCHAR[]" + "".join(f" || CASE WHEN {fires(t)} THEN [{names(t.paths)}]::VARCHAR[] ELSE []::VARCHAR[] END" for t in topics if t.paths)
    first = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
    return f"qa AS (SELECT query_id, normalized, {first.format('a')} AS terms, {first.format('b')} AS paths FROM (SELECT query_id, normalized, {toks('normalized')}{terms} AS a, {paths} AS b FROM (SELECT query_id, {norm('text')} AS normalized FROM ({asked}))))"


def ranked(passages: str, asked: str, k: int, page: str = "ord", topics: list[Topic] = (), key: str = "doc_id") -> str:
    return f"""WITH {index(passages)}, {analyzed(asked, list(topics))},
qt AS (SELECT query_id, len(terms) AS asked, unnest(terms) AS term FROM qa),
h AS (SELECT query_id, po.ord, asked, tf, in_title, len(tk.bt) AS length, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avg_length FROM po JOIN qt USING (term) JOIN df USING (term) JOIN tk ON tk.ord = po.ord CROSS JOIN st),
s AS (SELECT query_id, ord, sum(CASE WHEN tf > 0 THEN idf * (tf * 2.35) / (tf + 1.35 * (1 - 0.72 + 0.72 * length / avg_length)) ELSE 0 END + CASE WHEN in_title = 1 THEN 5 * idf ELSE 0 END) AS score, count(*) AS matched, first(asked) AS asked FROM h GROUP BY ALL),
f AS (SELECT query_id, ord, url, round(score * (0.65 + 0.35 * matched / asked)
 + CASE WHEN length(normalized) > 8 AND contains(body, normalized) THEN 8 ELSE 0 END + CASE WHEN length(normalized) > 8 AND contains(head, normalized) THEN 12 ELSE 0 END
 + CASE WHEN len(list_filter(paths, lambda x: contains(coalesce(url, ''), x))) > 0 THEN 40 ELSE 0 END
 + CASE WHEN contains(coalesce(url, ''), '/policy-manual/') THEN 4 ELSE 0 END + CASE WHEN contains(coalesce(url, ''), '/forms/') THEN 2 ELSE 0 END - CASE WHEN contains(coalesce(url, ''), '/newsroom/') THEN 3 ELSE 0 END, 4) AS score
 FROM s JOIN tk USING (ord) JOIN qa USING (query_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, {page} ORDER BY score DESC, ord) AS nth FROM f),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank, ord AS {key}, score FROM c WHERE nth <= 2)
SELECT * FROM r WHERE rank <= {k}"""


def best(scores: list[str]) -> str:
    return f"greatest({', '.join(scores)})"


def match(q: str, c: str) -> str:
    qt, ct = f"list_filter(string_split({q}, ' '), lambda w: length(w) > 1)", [w for w in c.split(" ") if len(w) > 1]
    one = lambda t: f"CASE WHEN len(list_filter({qt}, lambda w: starts_with(w, {lit(t)}) OR starts_with({lit(t)}, w) OR (length(w) > 4 AND {len(t)} > 4 AND (contains({lit(t)}, w) OR contains(w, {lit(t)}))))) > 0 THEN 1 ELSE 0 END"
    m = "(" + " + ".join(one(t) for t in ct) + ")"
    words = f"CASE WHEN {m} > 0 THEN {m} + 2.0::DOUBLE * {m} / {len(ct)} + {m}::DOUBLE / greatest(len({qt}), 1) ELSE 0 END"
    inside = f"CASE WHEN contains({q}, {lit(c)}) OR contains({lit(c)}, {q}) THEN {min(10, 4 + len(ct))} ELSE 0 END"
    return f"CASE WHEN {q} = '' THEN 0::DOUBLE WHEN {q} = {lit(c)} THEN 12 ELSE greatest({inside}, {words})::DOUBLE END"


def match_of(q: str, c: str) -> str:
    """``match`` for a column of phrases."""
    qt, ct = (f"list_filter(string_split({x}, ' '), lambda w: length(w) > 1)" for x in (q, c))
    m = f"len(list_filter({ct}, lambda t: len(list_filter({qt}, lambda w: starts_with(w, t) OR starts_with(t, w) OR (length(w) > 4 AND length(t) > 4 AND (contains(t, w) OR contains(w, t))))) > 0))::DOUBLE"
    words = f"CASE WHEN {m} > 0 THEN {m} + 2.0::DOUBLE * {m} / len({ct}) + {m} / greatest(len({qt}), 1) ELSE 0 END"
    inside = f"CASE WHEN contains({q}, {c}) OR contains({c}, {q}) THEN least(10, 4 + len({ct})) ELSE 0 END"
    return f"CASE WHEN {q} = '' OR {c} = '' THEN 0::DOUBLE WHEN {q} = {c} THEN 12 ELSE greatest({inside}, {words})::DOUBLE END"


def exact(q: str, c: str) -> str:
    return f"CASE WHEN contains(' ' || {q} || ' ', {lit(' ' + c + ' ')}) THEN {min(10, 4 + len(c.split()))} ELSE 0 END"


def argmax(topics: list[tuple[str, tuple[str, ...]]], least: float, otherwise: str) -> str:
    cols = ", ".join(f"{best([match('q', p) for p in ps])} AS s{i}" for i, (_, ps) in enumerate(topics))
    top = best([f"s{i}" for i in range(len(topics))])
    cases = " ".join(f"WHEN top = s{i} THEN {lit(n)}" for i, (n, _) in enumerate(topics))
    return f"SELECT conv_id, turn, CASE WHEN top < {least} THEN {otherwise} {cases} END AS topic, round(top, 4) AS topic_score FROM (SELECT *, {top} AS top FROM (SELECT conv_id, turn, {cols} FROM (SELECT conv_id, turn, {route('text')} AS q FROM conversations WHERE role = 'user')))"


def rules(plain: str, table: list[tuple[tuple[str, ...], str]], otherwise: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({plain}, {lit(t)})" for t in terms) + f" THEN {lit(v)}" for terms, v in table) + f" ELSE {lit(otherwise)} END"


PARTS = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^[^@]*@|:[0-9]*$', '', 'g')"
ORIGIN = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))"
PATH = f"CASE WHEN {PARTS} = '' THEN '/' ELSE {PARTS} END"
USERS = "SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'"
LAST = f"""u AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS text, {route('text')} AS plain FROM conversations WHERE role = 'user'),
l AS (SELECT *, lag(text) OVER w AS previous, lead(turn) OVER w AS nxt FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
FOUND = "fd AS (SELECT max(page_id) AS page_id, url, regexp_extract(url, '://[^/]*/([a-z]*)', 1) AS last_modified FROM pages GROUP BY url)"
EVENTS = "e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
DAY = 86_400_000_000


def edges(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def cleaned(x: str) -> str:
    """Output text without formats, as far as texts of the tables have any."""
    for pattern, by in ((r"\*\*([^*]+)\*\*", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"[ \t]+([,.;:!?])", r"\1"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"
    return x


def item_grams(*sizes: int) -> str:
    runs = " || ".join(f"list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: array_to_string(w[i : i + {n - 1}], ' '))" for n in sizes)
    return f"g AS (SELECT DISTINCT item_id, unnest({runs}) AS phrase FROM (SELECT item_id, string_split({route('text')}, ' ') AS w FROM benchmark))"


def last_at(w: str, p: str) -> str:
    """Where the last ``p`` in ``w`` begins, from 0; -1 if nowhere."""
    return f"CASE WHEN strpos(reverse({w}), reverse({p})) > 0 THEN length({w}) - strpos(reverse({w}), reverse({p})) + 1 - length({p}) ELSE -1 END"


def cut_end(at: str) -> str:
    """The end of the part of ``text`` that begins at ``at``."""
    end = f"least({at} + 2000, length(text))"
    spots = ", ".join(f"{at} + {last_at(f'substr(text, {at} + 1, {end} + length({p}) - {at})', p)}" for p in ("'. '", "chr(10)", "' '"))
    return f"CASE WHEN {end} < length(text) AND greatest({spots}) > {at} + 1300 THEN greatest({spots}) + 1 ELSE {end} END"


SPLIT = rf"""sp AS (SELECT doc_id, source, coalesce(text, '') AS text, 0::BIGINT AS part, 0::BIGINT AS b, CASE WHEN length(text) > 2000 THEN {cut_end('0')} ELSE length(coalesce(text, '')) END AS e FROM documents
 UNION ALL SELECT doc_id, source, text, part + 1, b, {cut_end('b')} FROM (SELECT doc_id, source, text, part, greatest(e - 240, b + 1) AS b FROM sp WHERE e < length(text))),
parts AS (SELECT doc_id, source, part, CASE WHEN length(text) <= 2000 THEN text ELSE regexp_replace(substr(text, b + 1, e - b), '^\s+|\s+$', '', 'g') END AS text FROM sp)"""


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{A0}}]+', ' ', 'g'))"


def sentences(src: str) -> str:
    """id, passage of the rows (id, excerpt, question) of ``src``."""
    found = lambda x: rf"regexp_extract_all(strip_accents(lower({x})), '[\p{{L}}\p{{N}}-]{{3,}}')"
    return rf"""sq AS (SELECT id, {squeezed("coalesce(excerpt, '')")} AS flat, {found('question')} AS w FROM {src}),
ss AS (SELECT id, w, list_filter(string_split(regexp_replace(flat, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: length(s) BETWEEN 45 AND 520 AND NOT regexp_matches(s, '^[a-z]')) AS f FROM sq),
si AS (SELECT id, w, unnest(f) AS s, unnest(range(len(f))) AS i FROM ss),
sn AS (SELECT id, s, i, row_number() OVER (PARTITION BY id ORDER BY len(list_filter({found('s')}, lambda x: list_contains(w, x))) * 5 - i * 0.08 DESC, i) AS n FROM si),
sb AS (SELECT id, string_agg(s, ' ' ORDER BY i) AS best FROM sn WHERE n <= 3 GROUP BY id),
passages AS (SELECT sq.id, coalesce(best, substr(flat, 1, 900)) AS passage FROM sq LEFT JOIN sb USING (id))"""


def under(p: str, prefixes) -> str:
    return "(" + " OR ".join(f"{p} = {lit(x)} OR starts_with({p}, {lit(x + '/')})" for x in prefixes) + ")"


def sql() -> dict[str, str]:
    title = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
    pages = f"SELECT page_id AS ord, url, {title} AS text, {title} AS title FROM pages"
    one_path = rf"regexp_replace({PATH}, '/{{2,}}', '/', 'g')"
    turns = "SELECT {conv_id: conv_id, turn: turn} AS query_id, text FROM conversations WHERE role = 'user'"
    nested = r"""raw AS (SELECT doc_id, lang, source || '.k' || (doc_id % 13) AS p, '{{n' || (n_chars % 3) || '}} ' || left(text, 8) AS title, '["' || lang || '","' || (doc_id % 5) || '"]' AS tags FROM documents),
nk AS (SELECT doc_id, lang, p || '.title' AS key_path, title AS value FROM raw WHERE title IS NOT NULL UNION ALL SELECT doc_id, lang, p || '.tags', tags FROM raw)"""
    strings = f"{nested}, s AS (SELECT lang, key_path, arg_max(value, doc_id) AS value FROM nk GROUP BY ALL)"
    holders = lambda x: rf"list_sort(regexp_extract_all({x}, '\{{\{{\s*([A-Za-z0-9_.]+)\s*\}}\}}', 1))"
    refers = r"(len(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}-]{3,}')) < 7 OR regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(it|that|this|they|them|those|these)($|[^A-Za-z0-9_])'))"
    plain_turns = f"SELECT conv_id, turn, {route('text')} AS plain FROM conversations WHERE role = 'user'"
    guard = lambda x: {k: f"regexp_matches(coalesce({x}, ''), {lit(p)})" for k, p in SENSITIVE_PATTERNS.items()}
    official = " OR ".join(f"h = {lit(d)} OR ends_with(h, {lit('.' + d)})" for d in DOMAINS)
    topk = ranked(DOCS, ASKED, 10)
    score = {n: best([exact("q", t) for t in ts]) for n, ts in TASKS.items()}
    wants, has = {k: f"({v}) >= 4" for k, v in score.items()}, {k: f"({v}) >= 1" for k, v in score.items()}
    named, literal = "flow_id IS NOT NULL", "d <> ''"
    date = f"({named} AND (({literal} AND ({has['date_verb']} OR {has['date_noun']})) OR (NOT {has['question']} AND {has['date_verb']} AND {has['date_noun']})))"
    w = {"summary": f"(({named} AND {wants['summary']}) OR {wants['checklist']} OR {wants['summary_phrase']})", "ask": f"({named} AND {has['date_noun']} AND {has['question']} AND NOT {literal})", "undo": f"({named} AND {wants['undo']})",
         "mark": f"({named} AND {wants['mark']} AND NOT {has['question']})", "clear": f"({named} AND {wants['clear']} AND {wants['checklist']})", "remind": f"({named} AND {wants['reminder']} AND {wants['create']})", "open": f"({wants['open']} AND NOT {has['question']})"}
    decide = (
        f"CASE WHEN ({w['summary']} OR {w['remind']} OR {w['ask']} OR {date} OR {w['undo']} OR {w['mark']} OR {w['clear']}) AND conv_id % 4 = 0 THEN 'requires_plus' WHEN {w['open']} AND {named} THEN 'open_flow'"
        + "".join(f" WHEN {w['open']} AND {has[k]} THEN '{v}'" for k, v in (("link", "open_link"), ("resource", "open_resources"), ("privacy", "open_privacy"), ("reminder", "open_reminders")))
        + f" WHEN {w['summary']} AND {named} THEN 'summary' WHEN {w['summary']} THEN 'progress' WHEN {w['remind']} THEN CASE WHEN contains(q, '30') THEN 'reminder_30' WHEN contains(q, '7') THEN 'reminder_7' ELSE 'reminder_0' END WHEN {w['ask']} THEN 'date_query'"
        + f" WHEN {date} AND try_cast(nullif(d, '') AS DATE) IS NULL THEN 'need_date' WHEN {date} THEN 'save_date' WHEN {has['all']} AND {w['mark']} AND NOT {w['undo']} THEN 'mark_all' WHEN ({w['mark']} OR {w['undo']}) AND NOT contains(q, 'der') THEN 'need_step'"
        + f" WHEN {w['undo']} THEN 'undo_step' WHEN {w['mark']} THEN 'mark_step' WHEN {w['clear']} THEN 'clear' WHEN {wants['capability']} THEN 'capabilities' END"
    )
    flow_steps = ", ".join(f"({lit(f)}, {o}, {lit(n)})" for f, o, n in FLOW_STEPS)
    lists = f"""fs AS (SELECT * FROM (VALUES {flow_steps}) v(flow_id, step_ord, step)), dn AS (SELECT DISTINCT user_id, event_type AS step FROM events WHERE event_id % 3 = 0),
pl AS (SELECT c_custkey AS user_id, flow_id, count(*) AS total, coalesce(string_agg(fs.step, ',' ORDER BY step_ord) FILTER (dn.step IS NOT NULL), '') AS completed, coalesce(string_agg(fs.step, ',' ORDER BY step_ord) FILTER (dn.step IS NULL), '') AS remaining, round(100.0 * count(dn.step) / count(*))::BIGINT AS percent, count(dn.step) AS n
 FROM customer CROSS JOIN fs LEFT JOIN dn ON dn.user_id = c_custkey AND dn.step = fs.step GROUP BY ALL)"""
    shown = lambda c: f"CASE WHEN {c} = '' THEN {lit(LABELS['none'])} ELSE replace({c}, ',', ', ') END"
    step_scores = []
    for _, o, name, parts in STEP_PARTS:
        inside = " OR ".join(f"contains(q, {lit(x)}) OR contains({lit(x)}, q)" for x in parts)
        hits = f"len(list_filter(list_filter(string_split(q, ' '), lambda x: length(x) > 2 AND x NOT IN ({names(STEP_STOP_WORDS)})), lambda x: contains({lit(' '.join(parts))}, x)))"
        step_scores.append(f"SELECT query_id, {o} AS o, {lit(name)} AS step_id, ({inside}) AS inside, CASE WHEN {inside} THEN 999.0 ELSE greatest({hits}::DOUBLE, {', '.join(match('q', x) for x in parts)}) END AS score FROM q")
    en = AnswerParams().copy["en"]
    chunk_passages = "SELECT doc_id * 1000 + part AS ord, source AS url, text, '' AS title FROM parts"
    answered = f"""WITH RECURSIVE {SPLIT}, hits AS ({ranked(chunk_passages, USERS, 1, 'url', TOPICS)}),
hx AS (SELECT u.query_id AS id, u.text AS question, substr(parts.text, 1, 2000) AS excerpt, parts.source AS url FROM ({USERS}) u LEFT JOIN hits ON hits.query_id = u.query_id LEFT JOIN parts ON parts.doc_id * 1000 + parts.part = hits.doc_id), {sentences('hx')}
SELECT hx.id AS query_id, CASE WHEN excerpt IS NULL THEN {lit(en['missing'])} ELSE {lit(en['intro'])} || chr(10) || chr(10) || passage || chr(10) || chr(10) || {lit(en['verify'])} END AS output_text, CASE WHEN excerpt IS NULL THEN 'no_matching_source' ELSE 'local_corpus' END AS grounded_on, url FROM hx JOIN passages ON passages.id = hx.id"""
    official_pages = f"s AS (SELECT page_id, {HOST} AS h, regexp_replace({ORIGIN} || {PATH}, '/$', '') AS url, regexp_extract(url, '://[^/]*/([a-z]*)', 1) AS lang FROM pages)"
    found = {
        "split_oversized": f"WITH RECURSIVE {SPLIT} SELECT doc_id, part, length(text) AS n_chars, md5(text) AS md5 FROM parts",
        "pack_paragraphs": r"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents),
r AS (SELECT doc_id, p, 1 AS i, []::VARCHAR[] AS done, '' AS open FROM l UNION ALL SELECT doc_id, p, i + 1, CASE WHEN open = '' OR length(open) + 1 + length(p[i]) <= 1800 THEN done ELSE done || [open] END,
 CASE WHEN open = '' THEN p[i] WHEN length(open) + 1 + length(p[i]) <= 1800 THEN open || chr(10) || p[i] ELSE right(open, 220) || chr(10) || p[i] END FROM r WHERE i <= len(p)),
f AS (SELECT doc_id, CASE WHEN open = '' THEN done ELSE done || [open] END AS c FROM r WHERE i = len(p) + 1)
SELECT doc_id, n AS part, length(t) AS n_chars, md5(t) AS md5 FROM (SELECT doc_id, unnest(c) AS t, unnest(range(len(c))) AS n FROM f)""",
        "useful_sentences": f"WITH src AS (SELECT doc_id AS id, text AS excerpt, {lit(FIXED_QUERIES[0][1])} AS question FROM documents), {sentences('src')} SELECT id AS doc_id, passage FROM passages",
        "citation_alignment": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, i, t, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM l),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS paragraph, base + length(t) - length(ltrim(t)) AS s, base + length(t) AS e FROM o WHERE trim(t) <> '')
SELECT doc_id AS answer_id, paragraph, s AS start, e AS "end", array_to_string(list_filter([CASE WHEN 0 < e AND 10 > s THEN 'a' END, CASE WHEN 150 < e AND 400 > s THEN 'b' END, CASE WHEN 300 < e AND 300 >= s THEN 'c' END], lambda x: x IS NOT NULL), ',') AS cited FROM p""",
        "annotation_join": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, i, t, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM l),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS paragraph, base + length(t) - length(ltrim(t)) AS s, base + length(t) AS e FROM o WHERE trim(t) <> ''),
m AS (SELECT doc_id, unnest(range(0, greatest(length(replace(text, chr(10), chr(10) || chr(10))), 1), 97)) AS a FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, a, CASE WHEN (a // 97) % 3 <> 2 THEN a + 150 END AS b FROM m)
SELECT doc_id, paragraph, count(*) AS marks, min(a) AS first, max(a) AS last FROM n JOIN p USING (doc_id) WHERE a < e AND CASE WHEN b IS NULL THEN a >= s ELSE b > s END GROUP BY ALL""",
        "model_answers": f"""WITH a AS (SELECT conv_id, conv_id * 1000 + turn AS id, role, trim(coalesce(text, '')) AS q, lead(text) OVER w AS reply, lead(role) OVER w AS replier FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT *, CASE WHEN q = '' THEN 'question_required' WHEN length(q) > 4000 THEN 'question_too_long' WHEN {" OR ".join(guard("q || chr(10) || chr(10)").values())} THEN 'sensitive_identifier' END AS error FROM a WHERE role = 'user'),
g AS (SELECT *, coalesce(replier = 'assistant', false) AND error IS NULL AND (conv_id % 10 = 0 OR (conv_id % 5 > 1 AND conv_id % 7 <> 0)) AS good, {edges('reply')} AS said, conv_id % 4 > 0 AND {edges("coalesce(reply, '')")} <> '' AS cites FROM u)
SELECT id AS request_id, CASE WHEN error IS NULL THEN 200 ELSE 400 END::BIGINT AS status, error,
 CASE WHEN error IS NOT NULL THEN NULL WHEN good THEN {cleaned("coalesce(nullif(said, '') || chr(10) || chr(10), '')")} || 'See page ' || conv_id || '.' || chr(10) || chr(10) || 'End' ELSE {lit(en['missing'])} END AS output_text,
 CASE WHEN error IS NOT NULL THEN NULL WHEN good THEN len(list_filter(regexp_split_to_array(coalesce(reply, ''), '\n[ \t]*\n'), lambda x: trim(x) <> '')) + 2 ELSE 1 END::BIGINT AS n_sections,
 CASE WHEN error IS NOT NULL THEN NULL WHEN good AND cites THEN 'https://www.example.com/p/' || conv_id ELSE '' END AS sources,
 CASE WHEN error IS NOT NULL THEN NULL WHEN good AND cites THEN 'live_official_sources' WHEN good THEN 'local_corpus' ELSE 'no_matching_source' END AS grounded_on, CASE WHEN error IS NULL THEN NOT good END AS degraded FROM g""",
        "ask_conversations": f"""WITH {LAST}, lq AS (SELECT conv_id, text AS question, plain, CASE WHEN {refers} AND coalesce(previous, '') NOT IN ('', text) THEN text || chr(10) || 'Previous user question: ' || previous ELSE text END AS query,
 conv_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = l.conv_id AND u.turn < l.turn AND u.plain <> '' AND u.plain <> l.plain) AS alone,
 (SELECT string_agg(line, chr(10) ORDER BY turn) FROM (SELECT turn, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(c.text, '') AS line FROM conversations c WHERE c.conv_id = l.conv_id AND c.turn < l.turn AND role IN ('user', 'assistant') ORDER BY turn DESC LIMIT 8)) AS said FROM l WHERE nxt IS NULL),
gq AS (SELECT *, CASE WHEN question = '' THEN 'question_required' WHEN length(question) > 4000 THEN 'question_too_long' WHEN {" OR ".join(guard("question || chr(10) || left(coalesce(said, ''), 12000) || chr(10)").values())} THEN 'sensitive_identifier' END AS error FROM lq),
hits AS ({ranked(pages, "SELECT conv_id AS query_id, query AS text FROM gq WHERE error IS NULL", 8, key="page_id")}),
hx AS (SELECT gq.conv_id AS id, question, {title} AS excerpt, url FROM gq LEFT JOIN hits ON hits.query_id = gq.conv_id AND hits.rank = 1 LEFT JOIN pages USING (page_id)), {sentences('hx')},
ou AS (SELECT id, excerpt, url, passage, CASE WHEN {official.replace('h ', HOST + ' ').replace('(h,', '(' + HOST + ',')} THEN regexp_replace({ORIGIN} || {PATH}, '/$', '') END AS src FROM hx JOIN passages USING (id))
SELECT conv_id, CASE WHEN error IS NULL THEN 200 ELSE 400 END::BIGINT AS status, error, CASE WHEN error IS NOT NULL THEN NULL WHEN excerpt IS NULL THEN {lit(en['missing'])} ELSE {lit(en['intro'])} || chr(10) || chr(10) || passage || chr(10) || chr(10) || {lit(en['verify'])} END AS output_text,
 CASE WHEN error IS NOT NULL THEN NULL WHEN excerpt IS NULL THEN 'no_matching_source' ELSE 'local_corpus' END AS grounded_on, CASE WHEN error IS NULL THEN true END AS degraded, CASE WHEN error IS NULL THEN coalesce(src, '') END AS sources,
 CASE WHEN error IS NOT NULL THEN NULL WHEN alone AND plain <> '' THEN 'v3|en|m|no-vector|' || left(plain, 900) ELSE '' END AS cache_key, CASE WHEN error IS NULL THEN {rules('plain', FOLLOW_UPS, 'next,documents,official')} END AS followups,
 CASE WHEN error IS NULL THEN CASE WHEN src IS NULL THEN 0 ELSE 1 END END::BIGINT AS source_count, CASE WHEN error IS NULL THEN (SELECT count(*) FROM hits WHERE query_id = conv_id) END::BIGINT AS retrieval_count FROM gq JOIN ou ON ou.id = gq.conv_id""",
        "extractive_answer": answered,
        "local_context": f"SELECT query_id, length(c) AS n_chars, md5(c) AS md5 FROM (SELECT query_id, string_agg('[Passage ' || rank || ']' || chr(10) || 'Title: ' || chr(10) || 'URL: ' || coalesce(source, '') || chr(10) || 'Last modified: unknown' || chr(10) || 'Passage: ' || substr(text, 1, 2000), chr(10) || chr(10) ORDER BY rank) AS c FROM ({ranked(DOCS, ASKED, 3)}) JOIN documents USING (doc_id) GROUP BY query_id)",
        "answer_cache_keys": f"WITH {LAST}, c AS (SELECT conv_id, plain, conv_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = l.conv_id AND u.turn < l.turn AND u.plain <> '' AND u.plain <> l.plain) AS ok FROM l WHERE nxt IS NULL) SELECT conv_id, ok AS cacheable, CASE WHEN ok AND plain <> '' THEN 'v3|en|m|no-vector|' || substr(plain, 1, 900) ELSE '' END AS key FROM c",
        "answer_profiles": f"WITH {official_pages}, g AS (SELECT lang, url, min(page_id) AS page_id FROM s WHERE {official} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY page_id) AS n FROM g), a AS (SELECT lang, count(*) AS retrieved FROM s GROUP BY lang), k AS (SELECT lang, count(*) AS n, bool_or(contains(url, 'example.org')) AS org FROM r WHERE n <= 6 GROUP BY lang) SELECT lang AS answer_id, coalesce(n, 0) AS source_count, retrieved AS retrieval_count, lang = 'fr' AS degraded, 'unknown' AS grounded_on, CASE WHEN contains(lang, 'es') THEN 'fees,forms,next' WHEN contains(lang, 'de') OR org THEN 'documents,official,next' ELSE 'next,documents,official' END AS followups FROM a LEFT JOIN k USING (lang)",
        "section_sources": f"WITH {official_pages} SELECT page_id AS answer_id, p AS paragraph, url, 'Official U.S. government source' AS title, 1::BIGINT AS source_rank FROM s, (VALUES (0::BIGINT), (1::BIGINT)) v(p) WHERE {official}",
        "phrase_intents": f"WITH {item_grams(1, 2, 3, 4)}, q AS (SELECT conv_id, turn, {route('text')} AS q FROM conversations WHERE role = 'user') SELECT conv_id, turn, item_id, max(least(10, 4 + len(string_split(phrase, ' '))))::BIGINT AS score FROM q JOIN g ON contains(' ' || q || ' ', ' ' || phrase || ' ') WHERE phrase <> '' AND q <> '' GROUP BY ALL",
        "phrase_expansion": f"""WITH {item_grams(2)}, q AS (SELECT query_id, {norm('text')} AS normalized FROM ({USERS})), f AS (SELECT DISTINCT query_id, item_id FROM q JOIN g ON contains(normalized, phrase) WHERE phrase <> ''),
a AS (SELECT query_id, list('topic' || item_id ORDER BY item_id) AS t, list('/item/' || item_id ORDER BY item_id) AS p FROM f GROUP BY query_id)
SELECT query_id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ' ') AS terms, coalesce(array_to_string(p, ' '), '') AS paths FROM (SELECT query_id, {toks('normalized')} || coalesce(t, []) AS x, p FROM q LEFT JOIN a USING (query_id))""",
        "phrase_best_topic": f"""WITH p AS (SELECT DISTINCT item_id, {route('s')} AS c FROM (SELECT item_id, unnest(string_split(text, '.')) AS s FROM benchmark)), q AS (SELECT conv_id, turn, {route('text')} AS q FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, turn, item_id, {match_of('q', 'c')} AS score FROM q CROSS JOIN p), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, item_id) AS n FROM s)
SELECT conv_id, turn, CASE WHEN score >= 1 THEN item_id::VARCHAR ELSE 'general' END AS topic, round(score, 4) AS topic_score FROM r WHERE n = 1""",
        "task_action": f"WITH f AS ({argmax(list(FLOWS.items()), 4, 'NULL')}), q AS (SELECT conv_id, turn, {route('text')} AS q, regexp_extract(coalesce(text, ''), '(^|[^0-9A-Za-z_])([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})($|[^0-9A-Za-z_])', 2) AS d FROM conversations WHERE role = 'user') SELECT conv_id, turn, {decide} AS action FROM (SELECT q.*, f.topic AS flow_id FROM q JOIN f USING (conv_id, turn))",
        "official_link": f"SELECT conv_id, turn, CASE {' '.join('WHEN ' + best([exact('q', t) for t in ts] + ['0']) + f' > 0 THEN {lit(u)}' for ts, u in LINKS)} ELSE 'https://example.com' END AS url FROM (SELECT conv_id, turn, {route('text')} AS q FROM conversations WHERE role = 'user')",
        "step_match": f"WITH q AS (SELECT query_id, {route('text')} AS q FROM ({USERS})), s AS ({' UNION ALL '.join(step_scores)}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE WHEN inside THEN -o ELSE o END) AS n FROM s WHERE score >= 1) SELECT query_id, step_id, round(score, 4) AS score FROM r WHERE n = 1",
        "reminder_times": "SELECT o_orderkey, days::BIGINT AS days, CASE WHEN days <> 14 THEN strftime(CAST(o_orderdate AS DATE) - days + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') END AS fires, CASE WHEN days = 14 THEN 'no_such_reminder' WHEN CAST(o_orderdate AS DATE) - days + INTERVAL 9 HOUR <= TIMESTAMP '1997-01-01 09:00:00' THEN 'past' ELSE 'set' END AS status FROM orders, (VALUES (30), (14), (7), (0)) v(days)",
        "date_parts": "SELECT o_orderkey, day(last_day(o_orderdate)) AS days, least(31, day(last_day(o_orderdate))) AS last, array_to_string(range(year(o_orderdate) - 10, year(o_orderdate) + 11), ',') AS years FROM orders",
        "shared_contexts": "SELECT event_id, given, CASE WHEN given AND event_id % 2 = 0 THEN event_type ELSE '' END AS context, CASE WHEN event_id % 5 = 0 THEN 'ai.quotaIssue' WHEN event_type = 'error' THEN 'privacy.consentSensitive' WHEN event_id % 7 = 0 THEN event_type ELSE 'ai.requestFailed' END AS error FROM (SELECT *, user_id % 2 = 0 AND event_id % 3 = 1 AS given FROM events)",
        "progress_lists": f"WITH {lists} SELECT user_id, flow_id, total, completed, remaining, percent FROM pl",
        "flow_summary": f"WITH {lists} SELECT user_id, flow_id, flow_id || ': ' || n || '/' || total || ' {LABELS['complete']} (' || percent || '%).' || chr(10) || '{LABELS['due']}: ' || CASE WHEN user_id % 2 = 0 THEN '2024-03-01' ELSE {lit(LABELS['not_set'])} END || '.' || chr(10) || '{LABELS['completed']}: ' || {shown('completed')} || '.' || chr(10) || '{LABELS['remaining']}: ' || {shown('remaining')} || '.' || chr(10) || '{LABELS['key_dates']}: ' || CASE WHEN user_id % 2 = 0 THEN 'reminder_30: 2024-01-31; reminder_7: 2024-02-23; target_date: 2024-03-01' ELSE {lit(LABELS['not_calculated'])} END || '.' AS summary FROM pl",
        "nested_keys": f"WITH {nested} SELECT doc_id, key_path, value FROM nk",
        "localized_strings": f"WITH {strings} SELECT w.lang, w.key_path, coalesce(o.value, b.value, w.key_path) AS text FROM (SELECT DISTINCT l.lang, k.key_path FROM s k, s l) w LEFT JOIN s o USING (lang, key_path) LEFT JOIN s b ON b.lang = 'en' AND b.key_path = w.key_path",
        "discovered_pages": f"WITH a AS (SELECT page_id, lang, CASE WHEN length(o) > 1 THEN regexp_replace(o, '/$', '') ELSE o END AS p FROM (SELECT page_id, regexp_extract(url, '://[^/]*/([a-z]*)', 1) AS lang, {one_path} AS o FROM pages)) SELECT 'https://www.uscis.gov' || p AS url, arg_max(lang || page_id, page_id) AS last_modified FROM a WHERE NOT (regexp_matches(p, '(?i)\\.html$') OR p = '/en/1' OR starts_with(p, '/de/9') OR {under('p', ['/en/2'])}) AND (p = '/fr' OR {under('p', ['/en', '/de'])}) GROUP BY p",
        "crawl_run": f"WITH {FOUND}, x AS (SELECT *, starts_with(url, 'https:') AS known FROM fd WHERE last_modified <> 'fr'), y AS (SELECT *, (NOT known OR last_modified <> 'en') AND page_id % 3 <> 0 AS fresh FROM x) SELECT url, CASE WHEN fresh THEN last_modified ELSE 'en' END AS last_modified, CASE WHEN fresh THEN 'new' ELSE 'old' END AS html FROM y WHERE fresh OR known",
        "normalize_text": f"SELECT doc_id, {norm('text')} AS normalized FROM documents",
        "token_stems": f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {toks('n')} AS t FROM (SELECT doc_id, {norm('text')} AS n FROM documents))",
        "term_frequency": f"WITH {index(DOCS)} SELECT ord AS doc_id, term, tf::BIGINT AS tf FROM po",
        "document_frequency": f"WITH {index(DOCS)} SELECT term, df FROM df",
        "corpus_stats": f"WITH {index(DOCS)} SELECT n, round(avg_length, 6) AS avg_length, (SELECT count(DISTINCT doc_id) FROM documents) AS page_count FROM st",
        "bm25_topk": topk,
        "bm25_page_cap": ranked(DOCS, ASKED, 20, "url"),
        "bm25_phrase_path_boost": ranked(pages, f"SELECT 0::BIGINT AS query_id, {lit(PAGE_QUERY)} AS text", 20, topics=[Topic("page", (PAGE_QUERY.split()[0],), (), ("/de/",))], key="page_id"),
        "topic_expansion": f"WITH {analyzed(turns, TOPICS)} SELECT query_id.conv_id, query_id.turn, array_to_string(terms, ' ') AS terms, array_to_string(paths, ' ') AS paths FROM qa",
        "batch_search": ranked(DOCS, USERS, 3, "url", TOPICS),
        "relative_cut": f"SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM ({topk})) WHERE rank = 1 OR best = 0 OR score >= 0.85 * best) WHERE nth <= 4",
        "normalize_url": f"SELECT page_id, {ORIGIN} || CASE WHEN length({one_path}) > 1 THEN regexp_replace({one_path}, '/$', '') ELSE {one_path} END AS normalized, {HOST} AS host FROM pages",
        "url_relevance": f"SELECT page_id, NOT (regexp_matches(p, '(?i)\\.html$') OR p = '/en/1' OR starts_with(p, '/de/9') OR {under('p', ['/en/2'])}) AND (p = '/fr' OR {under('p', ['/en', '/de'])}) AS relevant FROM (SELECT page_id, CASE WHEN length(o) > 1 THEN regexp_replace(o, '/$', '') ELSE o END AS p FROM (SELECT page_id, {one_path} AS o FROM pages))",
        "incremental_pending": f"WITH {FOUND} SELECT page_id, url, last_modified FROM fd WHERE NOT starts_with(url, 'https:') OR last_modified <> 'en'",
        "corpus_merge": f"WITH {FOUND}, x AS (SELECT url, regexp_matches(url, '://[^/]*[.]org(/|$)') AS org, starts_with(url, 'https:') AS tls FROM fd WHERE last_modified <> 'fr') SELECT url, CASE WHEN org THEN 'new' ELSE 'old' END AS state FROM x WHERE org OR tls",
        "dedupe_last_wins": f"SELECT max(page_id) AS page_id, host, arg_max(url, page_id) AS url FROM (SELECT page_id, {HOST} AS host, url FROM pages) GROUP BY host",
        "source_dedup": f"WITH s AS (SELECT page_id, {HOST} AS h, regexp_replace({ORIGIN} || {PATH}, '/$', '') AS url, regexp_extract(url, '://[^/]*/([a-z]*)', 1) AS lang FROM pages), g AS (SELECT lang, url, min(page_id) AS page_id FROM s WHERE {official} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY page_id) AS source_rank FROM g) SELECT lang, url, page_id, source_rank FROM r WHERE source_rank <= 6",
        "pii_guard": "SELECT doc_id, " + ", ".join(f"{g} AS {k}" for k, g in guard("text").items()) + " FROM documents",
        "request_validation": "SELECT conv_id, turn, CASE WHEN error IS NULL THEN 200 ELSE 400 END::BIGINT AS status, error FROM (SELECT conv_id, turn, CASE WHEN q = '' THEN 'question_required' WHEN length(q) > 4000 THEN 'question_too_long' WHEN " + " OR ".join(guard("q || chr(10) || chr(10)").values()) + " THEN 'sensitive_identifier' END AS error FROM (SELECT conv_id, turn, trim(coalesce(text, '')) AS q FROM conversations))",
        "last_user_turn": f"WITH {LAST} SELECT conv_id, turn, text AS question FROM l WHERE nxt IS NULL",
        "prior_different_question": f"WITH {LAST} SELECT conv_id, EXISTS (SELECT 1 FROM u WHERE u.conv_id = l.conv_id AND u.turn < l.turn AND u.plain <> '' AND u.plain <> l.plain) AS has_prior_different FROM l WHERE nxt IS NULL",
        "retrieval_query": f"WITH {LAST} SELECT conv_id, CASE WHEN {refers} AND coalesce(previous, '') NOT IN ('', text) THEN text || chr(10) || 'Previous user question: ' || previous ELSE text END AS query FROM l WHERE nxt IS NULL",
        "transcript_last8": "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, ''), chr(10) ORDER BY turn) AS transcript FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant')) WHERE n <= 8 GROUP BY conv_id",
        "intent_scores": "SELECT conv_id, turn, " + ", ".join(f"{best([exact('q', t) for t in ts])}::BIGINT AS {n}" for n, ts in INTENTS.items()) + f" FROM (SELECT conv_id, turn, {route('text')} AS q FROM conversations WHERE role = 'user')",
        "topic_argmax": argmax(TOPIC_PHRASES, 1, "'general'"),
        "flow_match": f"SELECT conv_id, turn, topic AS flow_id FROM ({argmax(list(FLOWS.items()), 4, 'NULL')})",
        "followup_rules": f"SELECT conv_id, turn, {rules('plain', FOLLOW_UPS, 'next,documents,official')} AS followups FROM ({plain_turns})",
        "domain_routing": f"SELECT conv_id, turn, {rules('plain', [(VISITOR, ','.join(VISITOR_DOMAINS))], ','.join(OFFICIAL_DOMAINS))} AS domains FROM ({plain_turns})",
        "rate_limit": f"WITH RECURSIVE {EVENTS}, r AS (SELECT user_id, event_id, n, true AS admitted, [t] AS times FROM e WHERE n = 1 UNION ALL SELECT user_id, event_id, n, len(k) < 3, CASE WHEN len(k) < 3 THEN k || [t] ELSE k END FROM (SELECT e.user_id, e.event_id, e.n, e.t, list_filter(r.times, lambda x: e.t - x < {DAY}) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)) SELECT user_id, event_id, admitted FROM r",
        "answer_replay": f"""WITH RECURSIVE a AS (SELECT conv_id * 1000 + turn AS id, {route('text')} AS plain, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role, conv_id FROM conversations),
k AS (SELECT id, answer, CASE WHEN conv_id % 7 > 0 AND plain <> '' AND length(plain) <= 900 THEN plain ELSE '' END AS key FROM a WHERE role = 'user'),
e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM k WHERE key <> ''),
r AS (SELECT id, key, n, false AS hit, id AS made, answer FROM e WHERE n = 1 UNION ALL SELECT e.id, e.key, e.n, e.id - r.made <= 200000, CASE WHEN e.id - r.made <= 200000 THEN r.made ELSE e.id END, CASE WHEN e.id - r.made <= 200000 THEN r.answer ELSE e.answer END FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT id AS request_id, hit, md5(answer) AS answer FROM r UNION ALL SELECT id, false, md5(answer) FROM k WHERE key = ''""",
        "cache_ttl_hits": f"WITH RECURSIVE {EVENTS}, r AS (SELECT user_id, event_id, n, false AS hit, t AS made FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, e.t - r.made <= {DAY}, CASE WHEN e.t - r.made <= {DAY} THEN r.made ELSE e.t END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT user_id, event_id, hit FROM r",
        "monthly_quota": "SELECT user_id, event_id, month, used, used <= 5 AS allowed FROM (SELECT user_id, event_id, strftime(ts, '%Y-%m') AS month, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS used FROM events)",
        "answered_quota": "SELECT user_id, event_id, month, used, user_id % 4 = 0 OR used < 5 AS allowed FROM (SELECT user_id, event_id, strftime(ts, '%Y-%m') AS month, least(5, count(*) FILTER (event_type <> 'error' AND user_id % 4 <> 0) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS used FROM events)",
        "progress_rollup": f"SELECT user_id, {len(STEPS)}::BIGINT AS total, count(DISTINCT CASE WHEN event_type IN ({names(STEPS)}) THEN event_type END) AS completed, round(100.0 * count(DISTINCT CASE WHEN event_type IN ({names(STEPS)}) THEN event_type END) / {len(STEPS)})::BIGINT AS percent FROM events GROUP BY user_id",
        "key_dates": "SELECT o_orderkey, id, strftime(CAST(o_orderdate AS DATE) - days, '%Y-%m-%d') AS iso FROM orders, (VALUES ('reminder_30', 30), ('reminder_7', 7), ('target_date', 0)) v(id, days)",
        "key_parity": f"WITH {strings}, b AS (SELECT l.lang, s.key_path, s.value FROM s, (SELECT DISTINCT lang FROM s WHERE lang <> 'en') l WHERE s.lang = 'en'), o AS (SELECT * FROM s WHERE lang <> 'en'), j AS (SELECT coalesce(b.lang, o.lang) AS lang, coalesce(b.key_path, o.key_path) AS key_path, CASE WHEN o.value IS NULL THEN 'missing' WHEN b.value IS NULL THEN 'extra' WHEN {holders('o.value')} <> {holders('b.value')} THEN 'placeholders' END AS problem FROM b FULL JOIN o ON b.lang = o.lang AND b.key_path = o.key_path) SELECT lang, key_path, problem FROM j WHERE problem IS NOT NULL",
    }
    # streams give what their batch forms give
    found |= {"rate_limit_stream": found["rate_limit"], "crawl_stream": found["crawl_run"]}
    return found
