"""Builds the SQL: one chain of common table expressions, of which each query takes what it needs."""

from __future__ import annotations

from ...functions import lexicon, text as tx
from . import report

TOKEN = tx.TOKEN.replace("'", "''")
SPEAKER = r"^([A-Za-z가-힣][A-Za-z0-9가-힣 _.-]{0,60})\s*:\s+(.+)$"

CONV = """SELECT CAST(conv_id AS VARCHAR) AS corpus_id, turn AS doc_pos, 'conv_' || conv_id AS source_name,
    coalesce(role, '') || ': ' || coalesce(text, '') AS text FROM conversations"""
CONV_ONE = """SELECT 'all' AS corpus_id, conv_id * 65536 + turn AS doc_pos, 'conv_' || conv_id AS source_name,
    coalesce(role, '') || ': ' || coalesce(text, '') AS text FROM conversations"""
DOCS = "SELECT source AS corpus_id, doc_id AS doc_pos, 'doc_' || doc_id AS source_name, text FROM documents"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(quoted(x) for x in items) + "]"


def strip(c):
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def norm(c):
    return f"trim(regexp_replace(lower({c}), '{tx.NOT_MATCHED}', ' ', 'g'))"


def words(c):
    found = f"list_transform(regexp_extract_all({c}, '{TOKEN}'), lambda t: regexp_replace(lower(t), '^''+|''+$', '', 'g'))"
    return f"list_filter({found}, lambda t: t <> '' AND NOT regexp_full_match(t, 'p[0-9]+'))"


def content(c):
    return f"list_filter({words(c)}, lambda t: length(t) > 1 AND NOT list_contains({listed(lexicon.STOPWORDS)}, t))"


def aligned(c, focus):
    terms = tx.python_words(focus)
    hits = " + ".join(f"CAST(contains({norm(c)}, {quoted(t)}) AS INT)" for t in terms)
    return f"(({hits}) / {len(terms)}.0)"


def percent(v):
    return f"CAST(CAST(round_even(greatest(0.0, least(1.0, CAST({v} AS DOUBLE))) * 100, 0) AS INT) AS VARCHAR) || '%'"


def color(n):
    return f"{listed(lexicon.THEME_COLORS)}[(({n} + 9) % {len(lexicon.THEME_COLORS)}) + 1]"


def chain(source: str, focus: str = "", parts: str = "") -> str:
    own = f"CASE WHEN {aligned('text', focus)} > 0 THEN text || ' {focus} {focus}' ELSE text END" if focus else "text"
    return rf"""WITH docs AS ({source}),
    ln AS (SELECT corpus_id, doc_pos, source_name, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM
        (SELECT *, list_transform(string_split(text, chr(10)), lambda x: {strip('x')}) AS ls FROM docs
            WHERE {strip('text')} <> '')),
    st AS (SELECT *, regexp_extract(line, '{SPEAKER}', 1) AS who, regexp_extract(line, '{SPEAKER}', 2) AS said,
        lag(line) OVER (PARTITION BY corpus_id, doc_pos ORDER BY n) AS prev FROM ln),
    sg AS (SELECT *, sum(CASE WHEN line <> '' AND (said <> '' OR prev IS NULL OR prev = '') THEN 1 ELSE 0 END)
        OVER (PARTITION BY corpus_id, doc_pos ORDER BY n) AS seg_pos FROM st),
    segments AS (SELECT corpus_id, doc_pos, source_name, CAST(seg_pos AS BIGINT) AS seg_pos,
        coalesce(nullif(trim(arg_min(who, n)), ''), 'Unknown') AS speaker,
        trim(regexp_replace(string_agg(CASE WHEN said <> '' THEN said ELSE line END, ' ' ORDER BY n), '\s+', ' ', 'g')) AS text,
        CAST(min(n) AS BIGINT) AS source_line FROM sg WHERE line <> '' GROUP BY corpus_id, doc_pos, source_name, seg_pos),
    pieces AS (SELECT *, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)),
        lambda x: x <> '') AS ps FROM segments),
    cut AS (SELECT * EXCLUDE (text, ps), unnest(ps) AS piece, CAST(generate_subscripts(ps, 1) AS BIGINT) AS sent_pos
        FROM pieces),
    marked AS (SELECT * EXCLUDE (piece), CASE WHEN regexp_matches(piece, '[.!?]$') THEN piece ELSE piece || '.' END AS text
        FROM cut),
    sentences AS (SELECT *, CAST(len({words('text')}) AS BIGINT) AS word_count FROM marked),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY doc_pos, seg_pos, sent_pos) AS quote_idx
        FROM sentences WHERE word_count >= 4),
    quotes AS (SELECT corpus_id, doc_pos, seg_pos, quote_idx, printf('Q%04d', quote_idx) AS quote_id, speaker, text,
        source_line, word_count, source_name FROM numbered),
    lists AS (SELECT corpus_id, quote_idx, {content(own)} AS t FROM quotes),
    tf AS (SELECT corpus_id, quote_idx, term, count(*) AS tf FROM (SELECT corpus_id, quote_idx, unnest(t ||
        list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]) ||
        list_transform(range(1, len(t) - 1), lambda i: t[i] || '_' || t[i + 1] || '_' || t[i + 2])) AS term FROM lists)
            GROUP BY ALL),
    total AS (SELECT corpus_id, count(*) AS total FROM quotes GROUP BY 1),
    idf AS (SELECT corpus_id, term, df, ln((1.0 + total) / (1 + df)) + 1 AS idf FROM (SELECT corpus_id, term, count(*) AS df
        FROM tf GROUP BY 1, 2) JOIN total USING (corpus_id)),
    raw AS (SELECT corpus_id, quote_idx, term, tf, tf * idf AS w FROM tf JOIN idf USING (corpus_id, term)),
    weights AS (SELECT corpus_id, quote_idx, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY corpus_id, quote_idx)) AS weight
        FROM raw),
    assigned AS (SELECT corpus_id, quote_idx, dense_rank() OVER (PARTITION BY corpus_id ORDER BY speaker) AS cluster_pos
        FROM quotes),
    center AS (SELECT corpus_id, cluster_pos, term, s / sqrt(sum(s * s) OVER (PARTITION BY corpus_id, cluster_pos)) AS weight
        FROM
        (SELECT corpus_id, cluster_pos, term, sum(weight) AS s FROM weights JOIN assigned USING (corpus_id, quote_idx)
            GROUP BY 1, 2, 3)),
    dots AS (SELECT w.corpus_id, a.cluster_pos, w.quote_idx, sum(w.weight * c.weight) AS cos FROM weights w
        JOIN assigned a USING (corpus_id, quote_idx)
        JOIN center c ON c.corpus_id = w.corpus_id AND c.cluster_pos = a.cluster_pos AND c.term = w.term GROUP BY 1, 2, 3),
    relevance AS (SELECT a.corpus_id, a.cluster_pos, a.quote_idx, coalesce(d.cos, 0.0) AS cos FROM assigned a LEFT
        JOIN dots d USING (corpus_id, cluster_pos, quote_idx)),
    said_ AS (SELECT corpus_id, quote_idx, unnest(t) AS t1, generate_subscripts(t, 1) AS p FROM (SELECT corpus_id, quote_idx,
        {content('text')} AS t FROM quotes)),
    runs AS (SELECT corpus_id, cluster_pos, t1, lead(t1, 1) OVER o AS t2, lead(t1, 2) OVER o AS t3 FROM said_
        JOIN assigned USING (corpus_id, quote_idx)
        WINDOW o AS (PARTITION BY corpus_id, cluster_pos ORDER BY quote_idx, p)),
    cand AS (SELECT corpus_id, cluster_pos, t1 AS keyword, t1 AS term, 1.0 AS f FROM runs
        UNION ALL SELECT corpus_id, cluster_pos, t1 || ' ' || t2, t1 || '_' || t2, 1.75 FROM runs WHERE t2 IS NOT NULL
        UNION ALL SELECT corpus_id, cluster_pos, t1 || ' ' || t2 || ' ' || t3, t1 || '_' || t2 || '_' || t3, 1.75 FROM runs
            WHERE t3 IS NOT NULL),
    counted AS (SELECT corpus_id, cluster_pos, keyword, term, f, count(*) AS n FROM cand GROUP BY ALL),
    scored AS (SELECT c.*, CAST(n AS DOUBLE) * CAST(f AS DOUBLE) * coalesce(idf, 1.0) + CASE WHEN f = 1.0
        AND list_contains({listed(lexicon.THEME_HINTS)}, term) THEN 4.0 * n ELSE 0 END AS score
        FROM counted c LEFT JOIN idf USING (corpus_id, term) WHERE length(keyword) >= 3),
    keywords AS (SELECT * FROM (SELECT corpus_id, cluster_pos, keyword, score, row_number() OVER (PARTITION BY corpus_id,
        cluster_pos ORDER BY round(score, 9) DESC, keyword) AS k FROM scored) WHERE k <= 5),
    lists_k AS (SELECT corpus_id, cluster_pos, list(keyword ORDER BY k) AS ks FROM keywords GROUP BY 1, 2),
    labels AS (SELECT *, coalesce({hinted()}, nullif({title()}, ''), 'Emerging Theme') AS label FROM lists_k){parts}
    """


def hinted():
    whens = " ".join(f"WHEN {quoted(w)} THEN {quoted(v)}" for w, v in lexicon.THEME_HINTS.items())
    return f"list_filter(list_transform(string_split(array_to_string(ks, ' '), ' '), lambda w: CASE w {whens} END), lambda x: x IS NOT NULL)[1]"


def title():
    kept = f"list_filter(string_split(ks[1], ' '), lambda w: w <> '' AND NOT list_contains({listed(lexicon.STOPWORDS)}, w))"
    return f"array_to_string(list_transform({kept}[1:5], lambda w: upper(w[1]) || w[2:]), ' ')"


def ranked(focus, top):
    """CTEs of quotes ranked within themes, and of the shown ones' validation."""
    terms = tx.python_words(focus)
    found = " + ".join(f"max(CAST(contains({norm('text')}, {quoted(t)}) AS INT))" for t in terms)
    return f""",
    rows_ AS (SELECT r.corpus_id, r.cluster_pos, round(r.cos, 3) AS relevance, q.* EXCLUDE (corpus_id),
        {aligned('q.text', focus)} AS al
        FROM relevance r JOIN quotes q USING (corpus_id, quote_idx)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, cluster_pos ORDER BY round(relevance + al, 9) DESC,
        source_name, source_line, quote_id) AS quote_rank FROM rows_),
    valid AS (SELECT corpus_id, cluster_pos, max(n) AS evidence_count, count(*) AS displayed_quote_count,
        count(DISTINCT source_name) AS source_count,
        count(DISTINCT speaker) AS speaker_count, round(CAST(({found}) AS DOUBLE) / {len(terms)},
            3) AS central_theme_alignment, {quoted(lexicon.REVIEW_STATUS)} AS review_status
        FROM (SELECT *, count(*) OVER (PARTITION BY corpus_id, cluster_pos) AS n FROM ranked) WHERE quote_rank <= {top} GROUP BY 1, 2)"""


def coded(codebook):
    """CTEs of codebook matches."""
    each = []
    for pos, name, terms, phrases, _ in codebook:
        points = [f"CASE WHEN contains(nt, {quoted(tx.match_form(p))}) THEN 2.5 ELSE 0.0 END" for p in phrases]
        for t in map(tx.match_form, terms):
            compound = " " in t or "-" in t
            points.append(
                f"CASE WHEN {f'contains(nt, {quoted(t)})' if compound else f'list_contains(ct, {quoted(t)})'} THEN {1.5 if compound else 1.0} ELSE 0.0 END"
            )
        each.append(
            f"SELECT corpus_id, quote_id, speaker, text, source_name, source_line, CAST({pos} AS BIGINT) AS frame_pos, {quoted(name)} AS name, CAST({' + '.join(points)} AS DOUBLE) AS score FROM coding"
        )
    return f""",
    coding AS (SELECT *, {norm('text')} AS nt, {content('text')} AS ct FROM quotes),
    matches AS (SELECT *, round(least(1.0, score / 6.0), 3) AS relevance FROM ({' UNION ALL '.join(each)}) WHERE score > 0)"""


def seeds(base: str, count: int) -> str:
    """The farthest-first seeds, one chain of expressions for each step."""
    parts = ["""pool AS (SELECT q.corpus_id, q.quote_idx, coalesce(l1, 0.0) AS l1 FROM quotes q LEFT JOIN
        (SELECT corpus_id, quote_idx, sum(abs(weight)) AS l1 FROM weights GROUP BY 1, 2) USING (corpus_id, quote_idx))"""]
    first = "row_number() OVER (PARTITION BY corpus_id ORDER BY {} DESC, quote_idx) AS k"
    parts.append(f"s1 AS (SELECT corpus_id, quote_idx FROM (SELECT *, {first.format('round(l1, 10)')} FROM pool) WHERE k = 1)")
    near = "-1.0"
    for n in range(2, count + 1):
        parts.append(f"""c{n} AS (SELECT w.corpus_id, w.quote_idx, sum(w.weight * v.weight) AS cos FROM weights w
            JOIN s{n - 1} s ON s.corpus_id = w.corpus_id JOIN weights v ON v.corpus_id = s.corpus_id AND v.quote_idx = s.quote_idx AND v.term = w.term GROUP BY 1, 2)""")
        parts.append(f"""p{n} AS (SELECT p.corpus_id, p.quote_idx, l1, greatest({near}, coalesce(cos, 0.0)) AS near
            FROM {f'p{n - 1}' if n > 2 else 'pool'} p LEFT JOIN c{n} USING (corpus_id, quote_idx))""")
        taken = " AND ".join(
            f"NOT EXISTS (SELECT 1 FROM s{m} WHERE s{m}.corpus_id = p{n}.corpus_id AND s{m}.quote_idx = p{n}.quote_idx)" for m in range(
                1, n
            )
        )
        gain = "round(1 - near + least(0.25, l1 / 20), 10)"
        parts.append(
            f"s{n} AS (SELECT corpus_id, quote_idx FROM (SELECT *, {first.format(gain)} FROM p{n} WHERE {taken}) WHERE k = 1)"
        )
        near = "near"
    found = " UNION ALL ".join(
        f"SELECT corpus_id, CAST({n} AS BIGINT) AS step, quote_idx FROM s{n}" for n in range(1, count + 1)
    )
    return f"{base}, {', '.join(parts)} {found}"


def all(focus, codebook, settings) -> dict[str, str]:
    conv, docs = chain(CONV), chain(DOCS)
    rank = chain(CONV, focus, ranked(focus, settings.quotes_per_theme))
    code = chain(CONV, "", coded(codebook))
    themes = chain(CONV, "", """,
    best AS (SELECT r.corpus_id, r.cluster_pos, q.quote_id, row_number() OVER (PARTITION BY r.corpus_id,
        r.cluster_pos ORDER BY round(round(r.cos, 3), 9) DESC, q.source_name, q.source_line, q.quote_id) AS k
        FROM relevance r JOIN quotes q USING (corpus_id, quote_idx)),
    shown AS (SELECT corpus_id, cluster_pos, string_agg(quote_id, ',' ORDER BY k) AS best_quotes FROM best WHERE k <= 2
        GROUP BY 1, 2),
    sizes AS (SELECT corpus_id, cluster_pos, count(*) AS quote_count, round(greatest(0.0, least(1.0, avg(cos))), 3) AS score
        FROM relevance GROUP BY 1, 2),
    themes AS (SELECT s.corpus_id, cluster_pos, quote_count, score, coalesce(label, 'Emerging Theme') AS name,
        coalesce(array_to_string(ks, '; '), '') AS keywords, best_quotes,
        printf('T%02d', cluster_pos) AS id, row_number() OVER (PARTITION BY s.corpus_id ORDER BY quote_count DESC, score DESC,
            coalesce(label, 'Emerging Theme'), cluster_pos) AS theme_pos
        FROM sizes s LEFT JOIN labels USING (corpus_id, cluster_pos) JOIN shown USING (corpus_id, cluster_pos))""")
    first = listed(tx.python_words(focus))
    focused = chain(CONV, focus, ranked(focus, settings.quotes_per_theme)) + f""",
    al AS (SELECT corpus_id, cluster_pos, max({aligned('text', focus)}) AS al FROM quotes JOIN assigned USING (corpus_id, quote_idx) GROUP BY 1, 2),
    pk AS (SELECT corpus_id, cluster_pos, al, CASE WHEN al > 0 THEN ({first} || list_filter(coalesce(ks, []),
        lambda x: NOT list_contains({first}, x)))[1:5] ELSE coalesce(ks, []) END AS ks FROM al LEFT JOIN lists_k USING (corpus_id, cluster_pos)),
    lab AS (SELECT *, coalesce({hinted()}, nullif({title()}, ''), 'Emerging Theme') AS label FROM pk),
    best AS (SELECT corpus_id, cluster_pos, string_agg(quote_id, ',' ORDER BY quote_rank) AS shown, string_agg(q.text, ' ' ORDER BY quote_rank) AS said
        FROM ranked r JOIN quotes q USING (corpus_id, quote_id) WHERE quote_rank <= {settings.quotes_per_theme} GROUP BY 1, 2),
    sizes AS (SELECT corpus_id, cluster_pos, count(*) AS quote_count, round(greatest(0.0, least(1.0, avg(cos))), 3) AS score
        FROM relevance GROUP BY 1, 2),
    whole AS (SELECT *, label || ' ' || array_to_string(ks, ' ') || ' ' || said AS everything
        FROM sizes JOIN lab USING (corpus_id, cluster_pos) JOIN best USING (corpus_id, cluster_pos))
    SELECT corpus_id, row_number() OVER (PARTITION BY corpus_id ORDER BY round({aligned('everything', focus)}, 9) DESC, quote_count DESC,
            score DESC, label, cluster_pos) AS theme_pos, printf('T%02d', cluster_pos) AS id, label AS name,
        array_to_string(ks, '; ') AS keywords, quote_count, score, shown FROM whole"""
    office = r"""WITH c AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^ -\[\]-z|~\x{00a1}-\x{00ff}\n]', '', 'g') AS t FROM conversations)
        SELECT 'conv_' || conv_id || '_' || turn || CASE WHEN turn % 2 = 0 THEN '.docx' ELSE '.RTF' END AS path,
            array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))),
                lambda x: x <> ''), chr(10)) AS text, CAST(NULL AS VARCHAR) AS error FROM c"""
    v = "evidence_count"
    written = f"'evidence=' || {v} || ', sources=' || source_count || ', speakers=' || speaker_count || ', central alignment=' || central_theme_alignment || ', status=' || review_status"
    screen = f"'Evidence ' || {v} || ' | Sources ' || source_count || ' | Speakers ' || speaker_count || ' | Focus ' || {percent('central_theme_alignment')} || ' | ' || review_status"
    terms = tx.python_words(focus)
    cols = "corpus_id, cluster_pos, quote_rank, quote_id, speaker, source_name, source_line, relevance"
    frames = f"""{code}, t AS (SELECT corpus_id, frame_pos, name, count(*) AS quote_count, round(avg(CAST(relevance AS DECIMAL(10, 3))), 3) AS score,
        row_number() OVER (PARTITION BY corpus_id ORDER BY frame_pos) AS k FROM matches GROUP BY 1, 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, frame_pos ORDER BY relevance DESC, source_name,
            source_line, quote_id) AS k FROM matches),
        s AS (SELECT corpus_id, frame_pos, string_agg(quote_id, ',' ORDER BY k) AS shown FROM r WHERE k <= 2 GROUP BY 1, 2)
        SELECT corpus_id, row_number() OVER (PARTITION BY corpus_id ORDER BY quote_count DESC, score DESC, name,
            frame_pos) AS theme_pos, printf('C%02d', frame_pos) AS id, name, quote_count, score, shown
        FROM t JOIN s USING (corpus_id, frame_pos) WHERE t.k <= 2"""
    notes = "|".join(lexicon.NOTES)
    return report.all(code, codebook) | {
        "farthest_seeds": seeds(conv, 3),
        "flagship": f"{themes} SELECT corpus_id, theme_pos, id, name, keywords, quote_count, score, best_quotes FROM themes",
        "file_texts": r"""WITH c AS (SELECT conv_id, turn, turn % 3 AS kind, coalesce(text, '') AS t FROM conversations)
            SELECT 'conv_' || conv_id || '_' || turn || CASE kind WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' ELSE '.rtf' END AS path,
                CASE kind WHEN 0 THEN replace(replace(replace(t, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10)),
                    chr(13), chr(10))
                WHEN 1 THEN regexp_replace(t, '[^ -~\x{00a0}-\x{00ff}]', '', 'g') || chr(233)
                ELSE trim(regexp_replace(regexp_replace(t, '[^A-Za-z0-9 .,]', '', 'g'), ' +', ' ', 'g')) END AS text, CAST(NULL AS VARCHAR) AS error FROM c""",
        "doc_lines": f"{docs} SELECT corpus_id, doc_pos, CAST(n AS BIGINT) AS line_no, line FROM ln",
        "turn_segments": f"{conv} SELECT * FROM segments",
        "document_segments": f"{docs} SELECT * FROM segments",
        "sentence_units": f"{conv} SELECT * FROM sentences",
        "quote_units": f"{conv} SELECT * FROM quotes",
        "document_quotes": f"{docs} SELECT * FROM quotes",
        "token_stream": f"{conv} SELECT corpus_id, quote_idx, CAST(generate_subscripts(t, 1) AS BIGINT) AS token_pos, unnest(t) AS token FROM (SELECT corpus_id, quote_idx, {words('text')} AS t FROM quotes)",
        "token_freq": f"{docs} SELECT token, count(*) AS n FROM (SELECT unnest({words('text')}) AS token FROM quotes) GROUP BY 1",
        "stopword_filtered": f"{docs} SELECT corpus_id, token, count(*) AS n FROM (SELECT corpus_id, unnest(t) AS token FROM lists) GROUP BY 1, 2",
        "ngram_terms": f"{conv} SELECT * FROM tf",
        "idf_terms": f"{chain(CONV_ONE)} SELECT corpus_id, term, df, round(idf, 4) AS idf FROM idf",
        "tfidf_weights": f"{conv} SELECT corpus_id, quote_idx, term, tf, round(weight, 4) AS weight FROM weights",
        "vector_l1": f"{conv} SELECT corpus_id, quote_idx, round(sum(abs(weight)), 4) AS l1 FROM weights GROUP BY 1, 2",
        "pair_cosine": f"{conv} SELECT a.corpus_id, a.quote_idx AS left_idx, b.quote_idx AS right_idx, round(sum(a.weight * b.weight), 4) AS cos FROM weights a JOIN weights b ON a.corpus_id = b.corpus_id AND a.term = b.term AND a.quote_idx < b.quote_idx GROUP BY 1, 2, 3",
        "best_pair": f"""{conv}, p AS (SELECT a.corpus_id, a.quote_idx AS left_idx, b.quote_idx AS right_idx, round(sum(a.weight * b.weight), 6) AS cos FROM weights a JOIN weights b ON a.corpus_id = b.corpus_id AND a.term = b.term AND a.quote_idx < b.quote_idx GROUP BY 1, 2, 3)
            SELECT corpus_id, left_idx, right_idx, cos FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY cos DESC, left_idx, right_idx) AS k FROM p) WHERE k = 1""",
        "group_centroid": f"{conv} SELECT corpus_id, cluster_pos, term, round(weight, 4) AS weight FROM center",
        "quote_relevance": f"{conv} SELECT corpus_id, cluster_pos, quote_idx, round(cos, 4) AS cos FROM relevance",
        "theme_cohesion": f"{conv} SELECT corpus_id, cluster_pos, count(*) AS quote_count, round(avg(cos), 4) AS cohesion FROM relevance GROUP BY 1, 2",
        "group_keywords": f"{conv} SELECT corpus_id, cluster_pos, keyword, round(score, 4) AS score, k FROM keywords",
        "focused_keywords": f"""{chain(CONV, focus)}, a AS (SELECT corpus_id, cluster_pos, max({aligned('text', focus)}) AS al FROM quotes JOIN assigned USING (corpus_id, quote_idx) GROUP BY 1, 2)
            SELECT corpus_id, cluster_pos, array_to_string(CASE WHEN al > 0 THEN ({listed(terms)} || list_filter(ks,
                lambda x: NOT list_contains({listed(terms)}, x)))[1:5] ELSE ks END, '; ') AS keywords
            FROM lists_k JOIN a USING (corpus_id, cluster_pos)""".replace(chain(CONV, focus), conv),
        "hint_labels": f"{conv} SELECT corpus_id, cluster_pos, label FROM labels",
        "ranked_quotes": f"{rank} SELECT {cols} FROM ranked",
        "top_n_quotes": f"{rank} SELECT {cols} FROM ranked WHERE quote_rank <= {settings.quotes_per_theme}",
        "theme_validation": f"{rank} SELECT * FROM valid",
        "theme_order": f"{themes} SELECT corpus_id, theme_pos, id, name, quote_count, score FROM themes",
        "focused_themes": focused,
        "office_texts": office,
        "theme_ids_colors": f"SELECT DISTINCT CAST(o_custkey AS BIGINT) AS number, printf('T%02d', CAST(o_custkey AS BIGINT)) AS theme_id, {color('o_custkey')} AS color FROM orders",
        "codebook_gate": rf"""{docs} SELECT corpus_id, bool_or(len(list_filter({listed(lexicon.CONTEXT_TERMS)}, lambda t: contains({norm('text')}, t))) > 0)
            AND bool_or(regexp_matches(text, '(?i)\b4[-\s]?h\b')) AS gate FROM quotes GROUP BY 1""",
        "codebook_matches": f"{code} SELECT corpus_id, frame_pos, quote_id, score, relevance FROM matches",
        "codebook_themes": frames,
        "focus_alignment": f"{conv} SELECT corpus_id, quote_id, CAST(round({aligned('text', focus)}, 4) AS DOUBLE) AS alignment FROM quotes",
        "focus_augmented": f"{conv} SELECT corpus_id, quote_id, CASE WHEN {aligned('text', focus)} > 0 THEN text || ' {focus} {focus}' ELSE text END AS text FROM quotes",
        "normalized_text": f"WITH docs AS ({DOCS}) SELECT source_name, {norm('text')} AS normal FROM docs",
        "validation_text": f"{rank} SELECT corpus_id, cluster_pos, {written} AS report, {screen} AS screen FROM valid",
        "theme_row_label": f"{rank} SELECT corpus_id, cluster_pos, 'Theme  |  ' || evidence_count || ' quotes  |  ' || {percent('central_theme_alignment')} || ' focus' AS label FROM valid",
        "status_text": f"{conv} SELECT corpus_id, count(DISTINCT doc_pos) || ' documents | ' || count(*) || ' quote units | ' || count(DISTINCT speaker) || ' themes' AS status FROM quotes GROUP BY 1",
        "percent_text": f"SELECT DISTINCT round(v, 6) AS v, {percent('v')} AS percent FROM (SELECT CAST(l_discount AS DOUBLE) * CAST(12.5 AS DOUBLE) - CAST(0.1 AS DOUBLE) AS v FROM lineitem)",
        "file_selection": "SELECT conv_id, CASE WHEN count(*) = 1 THEN 'turn_' || min(turn) || '.txt' ELSE count(*) || ' transcripts selected' END AS selection FROM conversations GROUP BY 1",
        "corpus_summary": f"""{code}, d AS (SELECT corpus_id, count(*) AS document_count FROM docs WHERE {strip('text')} <> '' GROUP BY 1), q AS (SELECT corpus_id, count(*) AS n FROM quotes GROUP BY 1),
            m AS (SELECT DISTINCT corpus_id FROM matches)
            SELECT d.corpus_id, document_count, coalesce(n, 0) AS quote_count, {quoted(notes)} || CASE
                WHEN n IS NULL THEN {quoted('|' + lexicon.NO_QUOTES_NOTE)}
                WHEN m.corpus_id IS NOT NULL THEN {quoted('|' + '|'.join(lexicon.CODEBOOK_NOTES))} ELSE '' END AS notes,
                {quoted('|'.join(lexicon.VALIDATION_SUMMARY))} AS validation_summary
            FROM d LEFT JOIN q ON d.corpus_id = q.corpus_id LEFT JOIN m ON d.corpus_id = m.corpus_id""",
    }
