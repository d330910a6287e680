"""SQL of reports of coded corpora: the first two frames that match, two quotes of each."""

from __future__ import annotations

from ... import __version__
from ...functions import lexicon

FRAMES, QUOTES = 2, 2


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(quoted(x) for x in items) + "]"


def cases(codebook, by: str) -> str:
    whens = " ".join(f"WHEN {f[0]} THEN {quoted(by.join(f[4]))}" for f in codebook)
    return f"CASE frame_pos {whens} END"


def themes(code: str, codebook) -> str:
    """code, and: head (one row a corpus), t (its themes) and s (their shown quotes)."""
    blank = "regexp_replace(text, '\\s+', '', 'g') <> ''"
    color = f"{listed(lexicon.THEME_COLORS)}[((frame_pos - 1) % {len(lexicon.THEME_COLORS)}) + 1]"
    return f"""{code},
    f AS (SELECT corpus_id, frame_pos, name, count(*) AS quote_count, round(avg(CAST(relevance AS DECIMAL(10, 3))), 3) AS score,
        row_number() OVER (PARTITION BY corpus_id ORDER BY frame_pos) AS k FROM matches GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, frame_pos ORDER BY relevance DESC, source_name, source_line,
        quote_id) AS quote_rank
        FROM matches),
    v AS (SELECT corpus_id, frame_pos, count(*) AS displayed, count(DISTINCT source_name) AS sources,
        count(DISTINCT speaker) AS speakers
        FROM r WHERE quote_rank <= {QUOTES} GROUP BY 1, 2),
    t AS (SELECT f.*, printf('C%02d', frame_pos) AS id, {color} AS color, {cases(codebook, ', ')} AS words,
        {cases(codebook, '; ')} AS listed,
        displayed, sources, speakers, row_number() OVER (PARTITION BY corpus_id ORDER BY quote_count DESC, score DESC, name,
            frame_pos) AS theme_pos
        FROM f JOIN v USING (corpus_id, frame_pos) WHERE k <= {FRAMES}),
    s AS (SELECT t.corpus_id, theme_pos, quote_rank, t.id, t.color, t.name, t.listed, quote_id, speaker, source_name,
        source_line, relevance, text
        FROM t JOIN r USING (corpus_id, frame_pos) WHERE quote_rank <= {QUOTES}),
    head AS (SELECT d.corpus_id, count(*) FILTER (WHERE {blank}) AS documents,
        (SELECT count(*) FROM quotes q WHERE q.corpus_id = d.corpus_id) AS quotes, (SELECT count(*) FROM t
            WHERE t.corpus_id = d.corpus_id) AS themes
        FROM docs d GROUP BY 1),
    notes AS (SELECT corpus_id, {listed(lexicon.NOTES)} || CASE WHEN quotes = 0 THEN {listed([lexicon.NO_QUOTES_NOTE])}
        WHEN themes > 0 THEN {listed(lexicon.CODEBOOK_NOTES)} ELSE [] END AS notes FROM head)"""


def markdown(base: str) -> str:
    mark = "'[' || id || ' ' || color || '] '"
    check = f"""'- Validation: evidence=' || quote_count || ', sources=' || sources || ', speakers=' || speakers ||
        ', central alignment=0.0, status={lexicon.REVIEW_STATUS}'"""
    top = [
        "# Qualitative Thematic Coding Report", "", f"Generated with Glosswork v{__version__}.", "",
        "## Researcher review required", "", lexicon.REPORT_WARNING, "", "## Summary", ""
    ]
    checks = ["", "## Validation Framework", "", *[f"- {x}" for x in lexicon.VALIDATION_SUMMARY], ""]
    said = """'Source: ' || source_name || ' | Line: ' || source_line"""
    return f"""{base},
    parts AS (
        SELECT corpus_id, 1 AS a, 0 AS b, 0 AS c, {listed(top)} || ['- Documents analyzed: ' || documents,
            '- Quote units analyzed: ' || quotes,
            '- Suggested themes: ' || themes] || {listed(checks)} AS ls FROM head
        UNION ALL SELECT corpus_id, 2, theme_pos, 0, ['## Theme ' || theme_pos || ': ' || name, '', '- Theme ID: ' || id,
            '- Theme color: ' || color,
            '- Quote units in theme: ' || quote_count, printf('- Cohesion score: %.3f', score), '- Keywords: ' || words,
                {check}, '', '### Quote Evidence', ''] FROM t
        UNION ALL SELECT corpus_id, 2, theme_pos, quote_rank, ['> ' || text, '', '- ' || {mark} || 'Speaker: ' || speaker
            || ' | Quote ID: ' || quote_id || ' | ' ||
            {said} || printf(' | Relevance: %.3f', relevance), ''] FROM s
        UNION ALL SELECT corpus_id, 3, 0, 0, ['## Color-Coded Transcript Evidence', ''] FROM head WHERE themes > 0
        UNION ALL SELECT corpus_id, 3, theme_pos, quote_rank, ['- ' || {mark} || {said} || ' | Speaker: ' || speaker
            || ' | Quote ID: ' || quote_id, '  > ' || text] FROM s
        UNION ALL SELECT corpus_id, 4, 0, 0, [''] FROM head WHERE themes > 0
        UNION ALL SELECT corpus_id, 5, 0, 0, ['## Notes', ''] || list_transform(notes, lambda x: '- ' || x) || [''] FROM notes),
    all_lines AS (SELECT corpus_id, a, b, c, unnest(ls) AS line, generate_subscripts(ls, 1) AS d FROM parts)
    SELECT corpus_id, row_number() OVER (PARTITION BY corpus_id ORDER BY a, b, c, d) AS line_no, line FROM all_lines"""


def csv(base: str, columns) -> str:
    shown = {c: c for c in columns} | {
        "theme_id": "id", "theme_name": "name", "theme_keywords": "listed", "theme_color": "color", "source_file": "source_name",
        "source_line": "CAST(source_line AS VARCHAR)", "relevance": "printf('%.3f', relevance)", "quote": "text",
        "validation_review_status": quoted(lexicon.REVIEW_STATUS),
    }
    cell = """CASE WHEN regexp_matches({0}, '[",\\r\\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""
    row = " || ',' || ".join(cell.format(x) for x in shown.values())
    return f"""{base}, rows_ AS (SELECT corpus_id, string_agg({row} || chr(10), '' ORDER BY theme_pos, quote_rank) AS body FROM s GROUP BY 1)
    SELECT head.corpus_id, {quoted(','.join(columns))} || chr(10) || coalesce(body, '') AS report FROM head LEFT JOIN rows_ ON head.corpus_id = rows_.corpus_id"""


def indented(depth: int, items: list[str]) -> str:
    """SQL of an object's or a list's inside: items, each on a line of its own."""
    pad = "chr(10) || " + quoted(" " * depth)
    return " || ',' || ".join(f"{pad} || {x}" for x in items) + f" || chr(10) || {quoted(' ' * (depth - 2))}"


def field(name: str, value: str) -> str:
    return f"""'"{name}": ' || {value}"""


def json(base: str, codebook) -> str:
    text = lambda c: f"CAST(to_json({c}) AS VARCHAR)"
    words = lambda f: "'[' || " + indented(8, [text(quoted(k)) for k in f[4]]) + " || ']'"
    keywords = "CASE frame_pos " + " ".join(f"WHEN {f[0]} THEN {words(f)}" for f in codebook) + " END"
    strings = lambda c, pad: f"'[' || array_to_string(list_transform({c}, lambda x: chr(10) || '{' ' * pad}' || {text('x')}), ',') || chr(10) || '{' ' * (pad - 2)}]'"
    quote = indented(10, [
        field("quote_id", text("quote_id")), field("speaker", text("speaker")), field("text", text("text")), field(
            "relevance", "CAST(relevance AS VARCHAR)"
        ),
        field("source_line", "source_line"), field("source_name", text("source_name")),
    ])
    valid = indented(8, [
        field("evidence_count", "quote_count"), field("displayed_quote_count", "displayed"), field("source_count", "sources"),
        field("speaker_count", "speakers"), field("central_theme_alignment", "'0.0'"), field(
            "review_status", text(quoted(lexicon.REVIEW_STATUS))
        ),
    ])
    theme = indented(6, [
        field("id", text("id")), field("name", text("name")), field("color", text("color")), field("keywords", keywords),
        field("quote_count", "quote_count"), field("score", "CAST(CAST(score AS DOUBLE) AS VARCHAR)"), field("quotes", "qs"),
        field("validation", f"'{{' || {valid} || '}}'"),
    ])
    whole = indented(2, [
        field("version", text(quoted(__version__))), field("document_count", "documents"), field("quote_count", "quotes"),
        field("themes", "coalesce(ts, '[]')"), field("notes", strings("notes", 4)),
        field("validation_summary", strings(listed(lexicon.VALIDATION_SUMMARY), 4)),
    ])
    out = f"""{base},
    q_ AS (SELECT corpus_id, theme_pos, '[' || string_agg(chr(10) || '        {{' || {quote} || '}}', ',' ORDER BY quote_rank)
        || chr(10) || '      ]' AS qs FROM s GROUP BY 1, 2),
    t_ AS (SELECT corpus_id, '[' || string_agg(chr(10) || '    {{' || {theme} || '}}', ',' ORDER BY theme_pos) || chr(10)
        || '  ]' AS ts
        FROM t JOIN q_ USING (corpus_id, theme_pos) GROUP BY 1)
    SELECT head.corpus_id, '{{' || {whole} || '}}' || chr(10) AS report FROM head JOIN notes ON head.corpus_id = notes.corpus_id LEFT JOIN t_ ON head.corpus_id = t_.corpus_id"""
    return out


def detail(base: str) -> str:
    mark = "'[' || id || ' ' || color || '] '"
    quote = f"""{mark} || speaker || ' | ' || quote_id || ' | ' || source_name || ': line ' || source_line || printf(' | relevance %.3f', relevance) ||
        chr(10) || text || chr(10)"""
    screen = f"""'Evidence ' || quote_count || ' | Sources ' || sources || ' | Speakers ' || speakers || ' | Focus 0% | {lexicon.REVIEW_STATUS}'"""
    head = f"""id || ' | ' || color, printf('%d quote units | cohesion %.3f', quote_count, score), {screen}, '', 'Keywords: ' || words, '', 'Quote evidence', ''"""
    return f"""{base}, q_ AS (SELECT corpus_id, list({quote} ORDER BY quote_rank) AS qs FROM s WHERE theme_pos = 1 GROUP BY 1)
    SELECT t.corpus_id, array_to_string([{head}] || qs, chr(10)) AS detail FROM t JOIN q_ ON t.corpus_id = q_.corpus_id WHERE theme_pos = 1"""


COLUMNS = [
    "theme_id", "theme_name", "theme_keywords", "theme_color", "quote_id", "speaker", "source_file", "source_line", "relevance", "quote",
    "validation_review_status",
]


def all(code: str, codebook) -> dict[str, str]:
    base = themes(code, codebook)
    return {
        "markdown_lines": markdown(base),
        "result_csv": csv(base, COLUMNS),
        "result_json": json(base, codebook),
        "theme_list": f"{base} SELECT corpus_id, theme_pos, name || '  |  ' || quote_count || ' quotes  |  0% focus' AS label FROM t",
        "theme_detail": detail(base),
        "quotes_csv_rows": f"""{base} SELECT corpus_id, theme_pos, quote_rank, id AS theme_id, name AS theme_name, listed AS theme_keywords, color AS theme_color,
            quote_id, speaker, source_name AS source_file, source_line, printf('%.3f', relevance) AS relevance, text AS quote,
            {quoted(lexicon.REVIEW_STATUS)} AS validation_review_status FROM s""",
    }
