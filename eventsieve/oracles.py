"""The registered queries again, in DuckDB's SQL, written apart from the Spark code."""

from __future__ import annotations

from eventsieve.functions.lexicon import PHRASES, STOP_WORDS, SUFFIXES, TOKEN
from eventsieve.operators.knowledge import COMMON_ENTITIES, CUT_HEADINGS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _fold(x: str) -> str:
    return f"translate(lower(coalesce({x}, '')), '’‘“”', '''''\"\"')"


def _canon(folded: str) -> str:
    for pattern, replacement in PHRASES:
        folded = f"regexp_replace({folded}, {_text(pattern)}, {_text(replacement)}, 'g')"
    return folded


def _stem(w: str) -> str:
    cases = " ".join(
        f"WHEN length({w}) > {len(s) + 3} AND ends_with({w}, '{s}') THEN left({w}, length({w}) - {len(s)}) || '{r}'"
        for s, r in SUFFIXES
    )
    return f"CASE {cases} ELSE {w} END"


_STOP = ", ".join(map(_text, STOP_WORDS))


def _words(x: str) -> str:
    found = f"regexp_extract_all({_canon(_fold(x))}, {_text(TOKEN)})"
    bare = f"[trim(replace(w, '''s', ''), '''') for w in {found}]"
    kept = f"[w for w in {bare} if length(w) >= 2 AND w NOT IN ({_STOP})]"
    return f"list_sort(list_distinct([{_stem('w')} for w in {kept}]))"


_PREFIX = r"(?:^|[^0-9A-Za-z_.])"
_UNIT = r"(?i:%|percent|b\b|bn\b|billion|m\b|mn\b|million|k\b)"


def _anchors(x: str) -> str:
    found = f"regexp_extract_all(replace({_fold(x)}, ',', ''), {_text(_PREFIX + r'([0-9]+(?:\.[0-9]+)?(?:\s*' + _UNIT + r')?)')}, 1)"
    digits = r"regexp_extract(m, '^[0-9]+(?:\.[0-9]+)?')"
    dull = f"(strpos({digits}, '.') = 0 AND ({digits} = m OR {digits}::DOUBLE BETWEEN 1900 AND 2100))"
    return f"list_sort(list_distinct([printf('%g', {digits}::DOUBLE) for m in {found} if NOT {dull}]))"


def _lead(x: str, n: int) -> str:
    parts = rf"string_split_regex(regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g'), '\s+')"
    return f"array_to_string({parts}[1:{n}], ' ')"


_ARTICLES = f"""
    articles AS MATERIALIZED (
      SELECT doc_id AS id, doc_id % 5 AS issue, {_lead('text', 12)} AS headline, {_lead('text', 30)} AS lead,
        DATE '2024-01-01' + (doc_id % 30)::INTEGER AS day, source, length(text) AS n_chars
      FROM documents),
    prints AS MATERIALIZED (
      SELECT id, issue, source, day, title, list_sort(list_distinct(list_concat(title, rest))) AS body, nums
      FROM (SELECT *, {_words('headline')} AS title, {_words('lead')} AS rest,
        {_anchors("headline || ' ' || lead")} AS nums FROM articles))"""


def _classes(name: str, where: str = "TRUE") -> str:
    return f"""
    {name} AS MATERIALIZED (
      SELECT title, body, nums, day, min(id) AS cid, count(*) AS size FROM prints WHERE {where}
      GROUP BY title, body, nums, day)"""


def _pairs(where: str = "TRUE", context: str = "FALSE") -> str:
    return f"{_ARTICLES}, {_edges(where, context)}"


def _edges(where: str = "TRUE", context: str = "FALSE") -> str:
    """Scores of all classes that share a word, then those of 0.34 or more."""
    return f"""{_classes('classes', where)},
    total AS (SELECT count(*) AS n FROM prints WHERE ({where}) OR ({context})),
    df AS (SELECT token, count(*) AS df FROM (
        SELECT unnest(body) AS token FROM prints WHERE ({where}) OR ({context})) GROUP BY token),
    tokens AS MATERIALIZED (
      SELECT cid, day, token, list_contains(title, token) AS in_title, ln((n + 1) / (df + 1)) + 1 AS w
      FROM (SELECT cid, day, title, unnest(body) AS token FROM classes) JOIN df USING (token), total),
    sums AS (
      SELECT cid, coalesce(sum(w) FILTER (in_title), 0) AS tw, sum(w) AS bw FROM tokens GROUP BY cid),
    shared AS (
      SELECT a.cid AS a_id, b.cid AS b_id,
        coalesce(sum(a.w) FILTER (a.in_title AND b.in_title), 0) AS t, sum(a.w) AS b
      FROM tokens a JOIN tokens b ON a.token = b.token AND a.cid < b.cid
        AND (a.day IS NULL OR b.day IS NULL OR abs(a.day - b.day) <= 7)
      GROUP BY ALL),
    scored AS (
      SELECT a_id, b_id, round(
        (CASE WHEN x.tw > 0 AND y.tw > 0 THEN 2 * t / (x.tw + y.tw) ELSE 0 END + 2 * b / (x.bw + y.bw)) / 2
        + CASE WHEN list_has_any(c.nums, d.nums) THEN 0.1 ELSE 0 END, 12) AS score
      FROM shared JOIN sums x ON x.cid = a_id JOIN sums y ON y.cid = b_id
        JOIN classes c ON c.cid = a_id JOIN classes d ON d.cid = b_id),
    edges AS MATERIALIZED (SELECT a_id, b_id, score FROM scored WHERE score >= 0.34)"""


def _components(where: str = "TRUE") -> str:
    return f"{_ARTICLES}, {_clusters(where)}"


def _clusters(where: str = "TRUE", context: str = "FALSE") -> str:
    return f"""{_edges(where, context)},
    linked AS (SELECT a_id AS u, b_id AS v FROM edges UNION ALL SELECT b_id, a_id FROM edges),
    reach(u, v) AS (SELECT cid, cid FROM classes UNION SELECT r.u, l.v FROM reach r JOIN linked l ON r.v = l.u),
    named AS (SELECT u AS cid, min(v) AS component, count(*) AS reached FROM reach GROUP BY u),
    clusters AS MATERIALIZED (
      SELECT p.id, CASE WHEN len(p.body) = 0 AND len(p.title) = 0 THEN p.id ELSE n.component END AS component
      FROM prints p JOIN classes c
        ON p.title = c.title AND p.body = c.body AND p.nums = c.nums AND p.day IS NOT DISTINCT FROM c.day
        JOIN named n USING (cid) WHERE {where.replace('id ', 'p.id ')})"""


_RANK = r"""CASE WHEN ends_with(host, 'example.org') THEN 0
      WHEN contains(host, 'spam') OR contains(host, 'cheap-') THEN 2 ELSE 1 END"""
_HOST = r"split_part(regexp_replace(lower(coalesce(url, '')), '^https?://(www\.)?', ''), '/', 1)"
_RANKED = f"""
    items AS (
      SELECT c.component, c.id, a.n_chars, p.url, {_RANK} AS source_rank
      FROM clusters c JOIN articles a USING (id) LEFT JOIN pages p ON p.page_id = c.id,
        LATERAL (SELECT {_HOST.replace('url', 'p.url')} AS host)),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY component ORDER BY source_rank, n_chars DESC, id) AS ord,
        count(*) OVER (PARTITION BY component) AS size FROM items)"""


def _published(old_prints: str, fresh: str) -> str:
    """Best matches of fresh fingerprints among old ones (id, day, title, body, nums)."""
    return f"""
    old AS MATERIALIZED ({old_prints}),
    p AS (SELECT count(*) AS n FROM old),
    odf AS (SELECT token, count(*) AS df FROM (SELECT unnest(body) AS token FROM old) GROUP BY token),
    mine AS MATERIALIZED (
      SELECT f.id, f.day, f.nums, token, list_contains(f.title, token) AS in_title,
        ln((n + 2) / (coalesce(df, 0) + 2)) + 1 AS w
      FROM (SELECT *, unnest(body) AS token FROM ({fresh})) f LEFT JOIN odf USING (token), p),
    theirs AS MATERIALIZED (
      SELECT o.id, token, list_contains(o.title, token) AS in_title,
        ln((n + 2) / (df + 2)) + 1 AS w_in, ln((n + 2) / (df + 1)) + 1 AS w_out
      FROM (SELECT *, unnest(body) AS token FROM old) o JOIN odf USING (token), p),
    mine_sums AS (SELECT id, coalesce(sum(w) FILTER (in_title), 0) AS tw, sum(w) AS bw FROM mine GROUP BY id),
    near AS (
      SELECT DISTINCT m.id, t.id AS old_id FROM mine m JOIN theirs t USING (token) JOIN old o ON o.id = t.id
      WHERE m.day IS NULL OR o.day IS NULL OR abs(m.day - o.day) <= 10),
    sides AS (
      SELECT n.id, n.old_id,
        sum(CASE WHEN m.token IS NULL THEN w_out ELSE w_in END) AS obw,
        coalesce(sum(CASE WHEN m.token IS NULL THEN w_out ELSE w_in END) FILTER (t.in_title), 0) AS otw,
        sum(w_in) FILTER (m.token IS NOT NULL) AS b,
        coalesce(sum(w_in) FILTER (m.in_title AND t.in_title), 0) AS t
      FROM near n JOIN theirs t ON t.id = n.old_id LEFT JOIN mine m ON m.id = n.id AND m.token = t.token
      GROUP BY ALL),
    matched AS (
      SELECT s.id, s.old_id, round(
        (CASE WHEN tw > 0 AND otw > 0 THEN 2 * t / (tw + otw) ELSE 0 END + 2 * b / (bw + obw)) / 2
        + CASE WHEN list_has_any(f.nums, o.nums) THEN 0.1 ELSE 0 END, 12) AS score
      FROM sides s JOIN mine_sums USING (id) JOIN ({fresh}) f ON f.id = s.id JOIN old o ON o.id = s.old_id),
    best AS MATERIALIZED (
      SELECT id, old_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, old_id DESC) AS k
        FROM matched WHERE score >= 0.34) WHERE k = 1)"""


def _issue_loop(issue: str, numbers: range, look_back: int | None) -> str:
    """pub_<number>: what each issue publishes, one after the other."""
    stages = []
    for k in numbers:
        history = " UNION ALL ".join(
            ["SELECT id, day, title, body, nums, n_chars FROM pub_none"] + [f"SELECT id, day, title, body, nums, n_chars FROM pub_{i}" for i in numbers if i < k]
        )
        seen = f"WHERE day >= (SELECT min(day) FROM dated WHERE issue = {k}) - {look_back}" if look_back is not None else ""
        stages.append(f"""
    pub_{k} AS MATERIALIZED (
      WITH RECURSIVE prints AS MATERIALIZED (
        SELECT id, day, title, body, nums, n_chars, TRUE AS cur FROM dated WHERE issue = {k}
        UNION ALL SELECT id, day, title, body, nums, n_chars, FALSE FROM ({history}) {seen}),
      {_clusters('cur', 'NOT cur')},
      {_published('SELECT id, day, title, body, nums FROM prints WHERE NOT cur', 'SELECT id, day, title, body, nums FROM prints WHERE cur')},
      fresh AS (
        SELECT c.component, p.*, row_number() OVER (PARTITION BY c.component ORDER BY p.n_chars DESC, p.id) AS ord
        FROM clusters c JOIN prints p ON p.id = c.id AND p.cur
        WHERE c.component NOT IN (SELECT component FROM clusters JOIN best USING (id)))
      SELECT id, day, title, body, nums, n_chars FROM fresh WHERE ord = 1)""")
    return f"""{_ARTICLES},
    dated AS MATERIALIZED (
      SELECT p.id, {issue} AS issue, p.day, title, body, nums, n_chars FROM prints p JOIN articles a USING (id)),
    pub_none AS (SELECT * FROM dated WHERE FALSE), {', '.join(stages)}"""


_OLD = "SELECT id, day, title, body, nums FROM prints WHERE id % 5 = 0"
_FRESH = "SELECT id, day, title, body, nums FROM prints WHERE id % 5 <> 0"


def _html_text(x: str) -> str:
    for tag in ("script", "style", "svg", "form"):
        x = f"regexp_replace({x}, '<{tag}[^>]*>.*?</{tag}>', '', 'gs')"
    x = f"regexp_replace({x}, '</(td|th)>', ' | ', 'g')"
    x = rf"regexp_replace({x}, '</(p|li|tr|h2|h3|summary|details|figcaption)>|<br\s*/?>', chr(10), 'g')"
    x = _unescape(f"regexp_replace({x}, '<[^>]+>', '', 'g')")
    lines = f"[trim(regexp_replace(l, '[ \\t]+', ' ', 'g'), ' |') for l in string_split({x}, chr(10))]"
    return f"array_to_string([l for l in {lines} if l <> ''], chr(10))"


def _unescape(x: str) -> str:
    for entity, char in COMMON_ENTITIES:
        x = f"replace({x}, {_text(entity)}, {_text(char)})"
    return x


def _first(x: str, pattern: str, options: str = "s") -> str:
    return f"CASE WHEN regexp_matches({x}, {_text(pattern)}, '{options}') THEN regexp_extract({x}, {_text(pattern)}, 1, '{options}') END"


def _facts(page: str) -> str:
    article = f"coalesce({_first(page, '<article[^>]*>(.*?)</article>')}, '')"
    cut = f"string_split_regex(chr(10) || {_html_text(article)}, {_text(chr(10) + '(?:' + '|'.join(CUT_HEADINGS) + ')' + chr(10))})[1]"
    return rf"left(regexp_replace({cut}, '^\s+|\s+$', '', 'g'), 6000)"


_TITLE = rf"regexp_replace({_unescape(_first('html', '<title>(.*?)</title>'))}, '^\s+|\s+$', '', 'g')"
_LEADS = """
    leads AS (
      SELECT c_custkey AS lead_id, CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE c_name END AS name,
        CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'no at sign' WHEN 2 THEN 'a@b.c'
          ELSE 'buyer' || c_custkey || '@example.com' END AS email,
        c_custkey % 13 <> 0 AS consent, c_custkey % 17 = 0 AS trapped, lower(c_mktsegment) AS segment
      FROM customer)"""
_UTM = r"nullif(regexp_extract(split_part(url, '#', 1), '\?(?:[^#]*&)?utm_source=([^&#]*)', 1), '')"
_LANDINGS = f"""
    landings AS (
      SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN {_UTM} END AS utm_source,
        CASE WHEN event_type = 'click' THEN {_HOST} END AS referrer
      FROM events JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages))"""

SQL: dict[str, str] = {
    "fold_words": f"""
        SELECT doc_id, len(w)::INTEGER AS n_words, md5(array_to_string(w, ' ')) AS words_md5
        FROM (SELECT doc_id, {_words('text')} AS w FROM documents)""",
    "stem_tokens": f"""
        SELECT token, {_stem('token')} AS stem, count(*) AS uses
        FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY token""",
    "phrase_canon": f"""
        SELECT doc_id, length(c)::INTEGER AS n_chars_canon, md5(c) AS canon_md5
        FROM (SELECT doc_id, {_canon(_fold("'Tonnes of record-high Shipments: European Union raises cuts. ' || text"))} AS c
          FROM documents)""",
    "anchors_numbers": f"""
        SELECT l_orderkey, l_linenumber, array_to_string({_anchors('told')}, ',') AS anchors
        FROM (SELECT *, 'Paid $' || (l_extendedprice / 10)::DECIMAL(15, 1) || 'M for ' || l_quantity::INTEGER
            || ' million units in 1998 at ' || l_linenumber || ',500% or x9.5 on line ' || l_linenumber AS told
          FROM lineitem)""",
    "parse_dates": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders""",
    "source_rank_hosts": f"""
        SELECT page_id, host, {_RANK} AS source_rank FROM (SELECT page_id, {_HOST} AS host FROM pages)""",
    "token_df_idf": f"""
        WITH {_ARTICLES}
        SELECT token, count(*) AS df, round(ln(((SELECT count(*) FROM prints) + 1) / (count(*) + 1)) + 1, 9) AS idf
        FROM (SELECT unnest(body) AS token FROM prints) GROUP BY token""",
    "doc_weights": f"""
        WITH {_pairs()}
        SELECT cid AS class_id, size, round(coalesce(tw, 0), 6) AS title_weight, round(coalesce(bw, 0), 6) AS body_weight
        FROM classes LEFT JOIN sums USING (cid)""",
    "similar_pairs": f"WITH {_pairs()} SELECT a_id, b_id, round(score, 6) AS score FROM edges",
    "similar_pairs_context": f"""
        WITH {_pairs("source <> 'src1'", "source = 'src1'")} SELECT a_id, b_id, round(score, 6) AS score FROM edges""",
    "near_dup_components": f"WITH RECURSIVE {_components()} SELECT id, component FROM clusters",
    "cluster_primary": f"""
        WITH RECURSIVE {_components()}, {_RANKED}
        SELECT component, size, id AS primary_id, source_rank, url FROM ranked WHERE ord = 1""",
    "also_reported": f"""
        WITH RECURSIVE {_components()}, {_RANKED}
        SELECT component, ord, id FROM ranked WHERE ord > 1""",
    "already_published_best": f"""
        WITH {_ARTICLES}, {_published(_OLD, _FRESH)} SELECT id, old_id, round(score, 6) AS score FROM best""",
    "drop_repeats_fresh": f"""
        WITH RECURSIVE {_components('id % 5 <> 0')}, {_published(_OLD, _FRESH)}
        SELECT component, id, row_number() OVER (PARTITION BY component ORDER BY id)::INTEGER AS ord FROM clusters
        WHERE component NOT IN (SELECT component FROM clusters JOIN best USING (id))""",
    "drop_repeats_repeats": f"""
        WITH RECURSIVE {_components('id % 5 <> 0')}, {_published(_OLD, _FRESH)},
        heads AS (SELECT component, min(id) AS primary_id FROM clusters GROUP BY component),
        firsts AS (SELECT component, arg_min(old_id, id) AS old_id FROM clusters JOIN best USING (id) GROUP BY component)
        SELECT component, primary_id, old_id FROM heads JOIN firsts USING (component)""",
    "exact_repeats": """
        SELECT id, first_id FROM (
          SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE id <> first_id""",
    "exact_repeats_links": r"""
        WITH p AS (SELECT page_id AS id, html, regexp_extract(url, '^[^?#]*/') AS link FROM pages),
        marks AS (
          SELECT id, id % 5 <> 0 AS late, html AS mark FROM p
          UNION ALL SELECT id, id % 5 <> 0, 'link ' || link FROM p),
        firsts AS (
          SELECT id, late, first_value(id) OVER w AS first_id, first_value(late) OVER w AS first_late FROM marks
          WINDOW w AS (PARTITION BY mark ORDER BY late, id)),
        ranked AS (
          SELECT id, first_id, row_number() OVER (PARTITION BY id ORDER BY first_late, first_id) AS k FROM firsts
          WHERE late AND (NOT first_late OR first_id <> id))
        SELECT id, first_id FROM ranked WHERE k = 1""",
    "issue_loop_shown": f"""
        WITH RECURSIVE {_issue_loop('p.issue', range(5), None)}
        {' UNION ALL '.join(f'SELECT {k}::BIGINT AS issue, count(*) AS shown FROM pub_{k} HAVING count(*) > 0' for k in range(5))}""",
    "issue_loop_look_back": f"""
        WITH RECURSIVE {_issue_loop('(p.id % 30) // 6', range(5), 3)}
        {' UNION ALL '.join(f'SELECT {k}::BIGINT AS issue, id FROM pub_{k}' for k in range(5))}""",
    "prompt_lines": f"""
        WITH RECURSIVE {_components()},
        heads AS (SELECT min(id) AS id FROM clusters GROUP BY component)
        SELECT batch, number, number || '. [' || day || '] ' || headline || ' :: ' || lead40 AS line
        FROM (
          SELECT a.id // 10 AS batch, row_number() OVER (PARTITION BY a.id // 10 ORDER BY a.id)::INTEGER AS number,
            strftime(a.day, '%Y-%m-%d') AS day, headline, {_lead('d.text', 40)} AS lead40
          FROM heads JOIN articles a USING (id) JOIN documents d ON d.doc_id = a.id)""",
    "verdict_merge": f"""
        WITH RECURSIVE {_components()},
        heads AS MATERIALIZED (
          SELECT h.component, p.id, p.id // 10 AS ten, title, body, nums
          FROM (SELECT component, min(id) AS id FROM clusters GROUP BY component) h JOIN prints p USING (id)),
        hdf AS (SELECT token, count(*) AS df FROM (SELECT unnest(body) AS token FROM heads) GROUP BY token),
        htokens AS MATERIALIZED (
          SELECT id, ten, token, list_contains(title, token) AS in_title, ln(((SELECT count(*) FROM heads) + 1) / (df + 1)) + 1 AS w
          FROM (SELECT id, ten, title, unnest(body) AS token FROM heads) JOIN hdf USING (token)),
        hsums AS (SELECT id, coalesce(sum(w) FILTER (in_title), 0) AS tw, sum(w) AS bw FROM htokens GROUP BY id),
        hshared AS (
          SELECT a.id AS a_id, b.id AS b_id, coalesce(sum(a.w) FILTER (a.in_title AND b.in_title), 0) AS t, sum(a.w) AS b
          FROM htokens a JOIN htokens b ON a.token = b.token AND a.ten = b.ten AND a.id < b.id GROUP BY ALL),
        told AS (
          SELECT a.component AS u, b.component AS v FROM hshared JOIN hsums x ON x.id = a_id JOIN hsums y ON y.id = b_id
            JOIN heads a ON a.id = a_id JOIN heads b ON b.id = b_id
          WHERE round((CASE WHEN x.tw > 0 AND y.tw > 0 THEN 2 * t / (x.tw + y.tw) ELSE 0 END + 2 * b / (x.bw + y.bw)) / 2
            + CASE WHEN list_has_any(a.nums, b.nums) THEN 0.1 ELSE 0 END, 12) >= 0.12),
        both_ways AS (SELECT u, v FROM told UNION ALL SELECT v, u FROM told),
        met(u, v) AS (SELECT component, component FROM heads UNION SELECT m.u, l.v FROM met m JOIN both_ways l ON m.v = l.u)
        SELECT u AS component, min(v) AS merged FROM met GROUP BY u""",
    "cluster_pair_quality": f"""
        WITH RECURSIVE {_components()},
        cells AS (SELECT component, source, count(*) AS n FROM clusters JOIN articles USING (id) WHERE source IS NOT NULL GROUP BY ALL),
        totals AS (
          SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY component))::BIGINT AS clustered,
            (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY source))::BIGINT AS labelled,
            (SELECT sum(n * (n - 1) // 2) FROM cells)::BIGINT AS both)
        SELECT clustered, labelled, "both", round("both" / clustered, 9) AS precision, round("both" / labelled, 9) AS recall FROM totals""",
    "page_urls": r"""
        SELECT page_id, 'https://site.example/' || regexp_extract(url, '://[^/]+/([^?#]*)', 1) || '/' AS page_url FROM pages""",
    "catalogue_urls": """
        SELECT p_partkey AS slug, p_name AS title,
          CASE WHEN p_partkey % 3 <> 0 THEN 'https://site.example/parts/' || p_partkey || '/#top' ELSE '' END AS page_url FROM part""",
    "knowledge_lines": f"""
        WITH p AS (
          SELECT 'https://site.example/' || regexp_extract(url, '://[^/]+/([^?#]*)', 1) || '/' AS url, md5({_facts('html')}) AS facts
          FROM pages WHERE NOT contains(html, 'name="robots" content="noindex')),
        c AS (
          SELECT p_partkey AS slug, p_name AS title,
            CASE WHEN p_partkey % 3 <> 0 THEN 'https://site.example/parts/' || p_partkey || '/#top' ELSE '' END AS page_url FROM part),
        entries AS (
          SELECT 1 AS part, to_json({{'slug': slug, 'title': title, 'page_url': page_url}})::VARCHAR AS line FROM c
          UNION ALL SELECT 3, to_json({{'url': url, 'facts': facts}})::VARCHAR FROM p)
        SELECT part, string_agg(line, ',') AS line FROM entries GROUP BY part, line
        UNION ALL SELECT 0, '{{"about":"About","rules":["Rule"],"directions":['
        UNION ALL SELECT 2, '],"pages":[' UNION ALL SELECT 4, ']}}'""",
    "knowledge_counts": """
        SELECT 'pages' AS kind, count(*) AS entries FROM pages UNION ALL SELECT 'directions', count(*) FROM part""",
    "click_files": r"""
        SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'email_click' WHEN 1 THEN 'whatsapp_click' ELSE 'download' END AS goal,
          CASE WHEN page_id % 5 = 2 THEN url || '.pdf' END AS file
        FROM pages WHERE page_id % 5 < 3""",
    "lead_display_texts": f"""
        WITH {_LEADS}
        SELECT lead_id, left(segment, 3) AS raw_segment, (SELECT c_mktsegment FROM customer WHERE c_custkey = lead_id) AS shown_segment,
          nullif(email, '') AS shown_email FROM leads""",
    "verdict_parse": """
        SELECT doc_id, CASE doc_id % 4
          WHEN 0 THEN CASE WHEN doc_id % 7 + 1 = 2 THEN '1' ELSE least(doc_id % 7, 1) || '+' || greatest(doc_id % 7, 1) END || ';2+3'
          WHEN 2 THEN CASE WHEN doc_id % 5 = 0 THEN '' ELSE (doc_id % 5 - 1)::VARCHAR END
          ELSE '' END AS groups
        FROM documents""",
    "cluster_audit": f"""
        WITH RECURSIVE {_components()}
        SELECT component, count(DISTINCT quality) AS labels, count(*) AS size
        FROM clusters JOIN labels ON doc_id = id GROUP BY component HAVING count(DISTINCT quality) > 1""",
    "benchmark_overlap": f"""
        WITH {_ARTICLES},
        tests AS MATERIALIZED (
          SELECT id, NULL::DATE AS day, title, list_sort(list_distinct(list_concat(title, rest))) AS body, nums
          FROM (SELECT item_id AS id, {_words(_lead('text', 12))} AS title, {_words(_lead('text', 30))} AS rest,
            {_anchors(_lead('text', 12) + " || ' ' || " + _lead('text', 30))} AS nums FROM benchmark)),
        {_published('SELECT id, day, title, body, nums FROM tests', 'SELECT id, day, title, body, nums FROM prints')}
        SELECT id, old_id, round(score, 6) AS score FROM best""",
    "page_fields": f"""
        SELECT page_id, lang, title, description, h1, nullif(concat_ws(',',
          CASE WHEN lang IS NULL THEN 'no lang' END, CASE WHEN title IS NULL THEN 'no title' END,
          CASE WHEN description IS NULL THEN 'no description' END, CASE WHEN h1 IS NULL THEN 'no h1' END), '') AS quarantine_reason
        FROM (SELECT page_id, {_first('html', '<html lang="([0-9A-Za-z_]+)"')} AS lang, {_TITLE} AS title,
          {_unescape(_first('html', '<meta name="description" content="([^"]*)"'))} AS description,
          CASE WHEN regexp_matches(html, '<h1[^>]*>(.*?)</h1>', 's') THEN
            {_html_text("regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's')")} END AS h1
          FROM pages WHERE NOT contains(html, 'name="robots" content="noindex'))""",
    "page_text": f"""
        SELECT page_id, length(f)::INTEGER AS n_chars, md5(f) AS facts_md5 FROM (SELECT page_id, {_facts('html')} AS f FROM pages)""",
    "page_faq": f"""
        SELECT page_id, 0 AS pos, {_html_text("'About ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || '?'")} AS q,
          'See page ' || page_id || ' & more' AS a FROM pages
        UNION ALL SELECT page_id, 1, 'Q', 'A' FROM pages""",
    "page_knowledge": f"""
        SELECT lang, count(*) AS pages, sum(length(facts))::BIGINT AS fact_chars, max(title) AS last_title
        FROM (SELECT {_first('html', '<html lang="([0-9A-Za-z_]+)"')} AS lang, {_TITLE} AS title, {_facts('html')} AS facts,
            regexp_extract(url, '://[^/]+/([^?#]*)', 1) || '/index.html' AS path FROM pages)
        WHERE path <> 'index.html' AND NOT contains(path, 'en/1') AND NOT contains(path, 'de/2') GROUP BY lang""",
    "utm_extract": f"""
        SELECT page_id, CASE WHEN {_UTM} IS NULL THEN 0 ELSE 1 END::INTEGER AS n_keys, {_UTM} AS utm_source FROM pages""",
    "last_touch": f"""
        WITH {_LANDINGS}
        SELECT event_id, last_value(utm_source IGNORE NULLS) OVER (
          PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS utm_source FROM landings""",
    "first_referrer": f"""
        WITH {_LANDINGS}
        SELECT event_id, first_value(referrer IGNORE NULLS) OVER (
          PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS first_referrer FROM landings""",
    "click_goals": """
        SELECT goal, count(*) AS clicks FROM (
          SELECT CASE page_id % 5 WHEN 0 THEN 'email_click' WHEN 1 THEN 'whatsapp_click' WHEN 2 THEN 'download' ELSE 'none' END AS goal
          FROM pages) GROUP BY goal""",
    "lead_validation": f"""
        WITH {_LEADS}
        SELECT lead_id, errors FROM (
          SELECT lead_id, trapped, concat_ws(',', CASE WHEN trim(name) = '' THEN 'name:required' END,
            CASE WHEN email = '' THEN 'email:required' END,
            CASE WHEN email IN ('no at sign', 'a@b.c') THEN 'email:email' END,
            CASE WHEN NOT consent THEN 'consent:consent' END) AS errors FROM leads)
        WHERE errors <> '' OR NOT trapped""",
    "lead_records": f"""
        WITH {_LEADS},
        parts AS (SELECT *, trim(name) AS company, CASE WHEN lead_id % 2 = 0 THEN 'ru' ELSE 'en' END AS lang FROM leads)
        SELECT lead_id,
          'company=' || company || '|consent=yes|email=' || email || '|form_type=inquiry|language=' || lang
            || '|page_url=https://example.com/p?x=1|referrer=|utm_source=' || segment AS raw,
          CASE WHEN company <> '' THEN 'Company=' || company || '|' ELSE '' END
            || CASE WHEN email <> '' THEN 'email=' || email || '|' ELSE '' END
            || 'language=' || lang || '|page_url=https://example.com/p?x=1|utm_source=' || segment AS display,
          CASE WHEN lang = 'ru' THEN 'Заявка с сайта: ' ELSE 'Website inquiry: ' END
            || coalesce(nullif(company, ''), 'inquiry') AS subject
        FROM parts""",
    "sessions_ttl": """
        WITH gaps AS (
          SELECT user_id, event_id, ts,
            epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, lag(event_type) OVER w = 'purchase' AS closed
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        marked AS (
          SELECT *, sum(CASE WHEN gap IS NULL OR gap > 24 * 3600000000 OR (closed AND gap > 2 * 3600000000) THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM gaps)
        SELECT user_id, session::BIGINT AS session, count(*) AS events, min(event_id) AS first_event, max(event_id) AS last_event
        FROM marked GROUP BY user_id, session""",
    "capped_log": """
        SELECT conv_id, turn, role FROM (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3""",
    "history_context": """
        SELECT conv_id, turn, coalesce(string_agg(said, ',') OVER (
          PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS history
        FROM (SELECT *, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END || ':' || length(text) AS said FROM conversations)""",
    "retry_dedup": "SELECT user_id, event_id, event_type FROM events",
    "error_rollup": """
        SELECT date_trunc('hour', ts) AS hour, CASE WHEN event_type = 'error' THEN 'timeout' ELSE event_type END AS kind,
          count(*) AS failures, round(avg(round(value)), 6) AS seconds FROM events GROUP BY ALL""",
    "delivery_status": "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS delivered FROM lineitem GROUP BY l_orderkey",
    "delivery_within": """
        SELECT o_orderkey, coalesce(bool_or(l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY), FALSE) AS delivered
        FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "cards_json": """
        SELECT 'https://site.example/' || doc_id AS url, (row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1)::INTEGER AS pos,
          (doc_id % 5)::INTEGER AS issue, strftime(DATE '2024-01-01' + (doc_id % 30)::INTEGER, '%d.%m.%Y') AS date, source AS title,
          md5(text) AS extract_md5 FROM documents""",
    "catalogue_json": """
        SELECT p_partkey::VARCHAR AS slug, p_name AS title_en, p_type AS category, p_brand || '|' || p_type AS products, p_size > 25 AS show_name,
          p_brand AS note, 'https://site.example/' || p_partkey AS note_url, TRUE AS no_moq FROM part""",
    "page_tree": """
        SELECT page_id % 10 || '/' || page_id || '/index.html' AS path, md5(html) AS html_md5 FROM pages""",
    "published_history": """
        SELECT doc_id % 5 AS issue, doc_id AS id, source, DATE '2024-01-01' + (doc_id % 30)::INTEGER AS date,
          CASE WHEN doc_id % 5 < 2 THEN 1 ELSE 2 END::INTEGER AS run FROM documents""",
    "feed_rss": """
        SELECT p_partkey::VARCHAR AS guid, p_name AS title, 'https://site.example/?a=1&b=' || p_partkey AS link,
          'Mon, 01 Jan 2024 08:00:00 +0800' AS "pubDate", p_brand || '|' || p_type AS headlines FROM part""",
    "sitemap_unlisted": """
        SELECT page_id, url || '#' || page_id AS url FROM pages WHERE page_id % 7 = 0""",
    "session_ids": """
        SELECT event_id, regexp_full_match(CASE WHEN event_id % 9 = 0 THEN upper(sid) ELSE sid END, '[a-f0-9]{24}') AS valid
        FROM (SELECT event_id, left(md5(user_id::VARCHAR), 24) AS sid FROM events)""",
    "link_extract": r"""
        SELECT doc_id, (i - 1)::INTEGER AS pos, CASE WHEN regexp_matches(found[i], '^https?://') THEN 'link' ELSE 'email' END AS kind,
          found[i] AS value
        FROM (SELECT doc_id, regexp_extract_all(text,
            'https?://[^\s<>"'')]+[^\s<>"'').,!?]|[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.]+') AS found FROM documents),
          LATERAL (SELECT unnest(range(1, len(found) + 1)) AS i)""",
}

SQL["verdict_fallback"] = SQL["verdict_merge"].replace("a.ten = b.ten", "a.ten = b.ten AND a.ten % 3 = 2")
SQL["knowledge_document"] = f"SELECT line FROM ({SQL['knowledge_lines']})"


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
