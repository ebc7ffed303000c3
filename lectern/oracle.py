"""DuckDB SQL for the reference operators, written in another shape than the Spark code where that is practical.

Constants (patterns, tables, fixture rows) come from the same Python values as the Spark expressions.
"""

from __future__ import annotations

from lectern.functions import text as T
from lectern.operators import layout as L
from lectern.operators import markup as M
from lectern.operators import voices as V
from lectern.sources import adapters as A
from lectern.streaming import player as P


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def rows(values, names: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in values)
    return f"(SELECT * FROM (VALUES {body}) AS t({names}))"


def listed(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def squash(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


def n_words(c: str) -> str:
    return f"len({words(c)})"


CLOSE = "[\"'')\\]”’]"
OPEN = "^[\"''(“‘—]?[A-Z0-9]"

PARAS = f"""paras AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para, text, (i - 1) // 40 + 1 AS page, false AS heading
  FROM (SELECT doc_id, i, {squash("l[i]")} AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))
  WHERE text <> '')"""


def sentences(source: str, keys: str, name: str) -> str:
    """name(keys, sid, text) from source(keys, text): each word looks at the next one; a running sum numbers sentences."""
    return f"""{name}_w AS (
  SELECT {keys}, i, w[i] AS w, w[i + 1] AS nx, lower(regexp_extract(w[i], '([^(]*)[.!?]{CLOSE}*$', 1)) AS stem
  FROM (SELECT {keys}, string_split(text, ' ') AS w FROM {source}), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
{name}_e AS (
  SELECT *, CASE WHEN NOT regexp_matches(w, '[.!?]{CLOSE}*$') THEN 0
    WHEN nx IS NOT NULL AND NOT regexp_matches(nx, '{OPEN}') THEN 0
    WHEN regexp_matches(w, '\\.{CLOSE}*$') AND (list_contains({listed(T.SENTENCE_ABBREVIATIONS)}, regexp_replace(stem, '[^a-z.]', '', 'g')) OR regexp_matches(stem, '^[a-z]$')
      OR (regexp_matches(stem, '[0-9]$') AND coalesce(regexp_matches(nx, '^[0-9]'), false))) THEN 0 ELSE 1 END AS e FROM {name}_w),
{name} AS (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY g) - 1 AS sid, text FROM (
    SELECT {keys}, g, string_agg(w, ' ' ORDER BY i) AS text FROM (
      SELECT *, coalesce(sum(e) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM {name}_e) GROUP BY {keys}, g) WHERE text <> '')"""


def pack(name: str, source: str, keys: str, limit: int = 320) -> str:
    """name(keys, part, text): pieces (n from 1) of source joined while they fit, by recursion over n."""
    same = " AND ".join(f"s.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""{name}_r AS (
  SELECT {keys}, n, length(piece) AS cur, 0 AS g FROM {source} WHERE n = 1
  UNION ALL
  SELECT {own}, s.n, CASE WHEN r.cur + length(s.piece) + 1 > {limit} THEN length(s.piece) ELSE r.cur + length(s.piece) + 1 END,
         CASE WHEN r.cur + length(s.piece) + 1 > {limit} THEN r.g + 1 ELSE r.g END
  FROM {name}_r r JOIN {source} s ON {same} AND s.n = r.n + 1),
{name} AS (
  SELECT {keys}, g AS part, string_agg(piece, ' ' ORDER BY n) AS text FROM {name}_r JOIN {source} USING ({keys}, n) GROUP BY {keys}, g)"""


def hard_split(source: str, keys: str) -> str:
    """hard(keys, part, text) of source(keys, text): clauses packed, then over-long parts packed word by word."""
    return f"""clauses AS (
  SELECT {keys}, i AS n, c[i] AS piece FROM (SELECT {keys}, string_split(regexp_replace(text, '([,;:—])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS c FROM {source}), LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i)),
{pack("cpack", "clauses", keys)},
wordy AS (
  SELECT {keys}, part AS p, i AS n, w[i] AS piece FROM (SELECT {keys}, part, string_split(text, ' ') AS w FROM cpack WHERE length(text) > 480), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
{pack("wpack", "wordy", keys + ", p")},
hard AS (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY a, b) - 1 AS part, text FROM (
    SELECT {keys}, part AS a, 0 AS b, text FROM cpack WHERE length(text) <= 480
    UNION ALL SELECT {keys}, p, part, text FROM wpack))"""


def chunks(paras: str = "paras") -> str:
    """chunks(doc_id, idx, text, page, para, starts_para, heading) of a paragraph table."""
    return f"""{sentences(f"(SELECT * FROM {paras} WHERE NOT heading)", "doc_id, para", "sents")},
longs AS (SELECT doc_id, para, sid, text FROM sents WHERE length(text) > 480),
{hard_split("longs", "doc_id, para, sid")},
roll AS (
  SELECT doc_id, para, sid, CASE WHEN length(text) > 480 THEN -1 ELSE length(text) END AS cur, 0 AS g FROM sents WHERE sid = 0
  UNION ALL
  SELECT s.doc_id, s.para, s.sid,
         CASE WHEN length(s.text) > 480 THEN -1 WHEN r.cur = -1 OR r.cur + length(s.text) + 1 > 320 THEN length(s.text) ELSE r.cur + length(s.text) + 1 END,
         CASE WHEN length(s.text) > 480 OR r.cur = -1 OR r.cur + length(s.text) + 1 > 320 THEN r.g + 1 ELSE r.g END
  FROM roll r JOIN sents s ON s.doc_id = r.doc_id AND s.para = r.para AND s.sid = r.sid + 1),
pieces AS (
  SELECT doc_id, para, g, 0 AS part, string_agg(text, ' ' ORDER BY sid) AS text FROM roll JOIN sents USING (doc_id, para, sid) WHERE cur <> -1 GROUP BY doc_id, para, g
  UNION ALL SELECT doc_id, para, g, part, hard.text FROM roll JOIN hard USING (doc_id, para, sid)
  UNION ALL SELECT doc_id, para, 0, 0, text FROM {paras} WHERE heading),
chunks AS (
  SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.para, g, part) - 1 AS idx, p.text, a.page, p.para,
         row_number() OVER (PARTITION BY p.doc_id, p.para ORDER BY g, part) = 1 AS starts_para, a.heading
  FROM pieces p JOIN {paras} a USING (doc_id, para))"""


def entities(c: str) -> str:
    """Numeric references first where they are not `&`, then the named ones, then whatever yields `&`."""
    out = c
    for name, value in M.ENTITIES.items():
        if name != "amp":
            out = f"replace({out}, '&{name};', {lit(value)})"
    return f"replace({out}, '&amp;', '&')"


def _named(c: str) -> str:
    for symbol, name in T.SYMBOLS.items():
        c = f"replace({c}, {lit(symbol)}, ' {name} ')"
    return c


PUNCT = "^[.,;:!?)\\]]+$"
ABBREVIATIONS = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in T.SPOKEN_ABBREVIATIONS.items()) + "}"


def speech(source: str, keys: str, name: str = "said") -> str:
    """name(keys, text), name_words(keys, token, w, off, glue) and name_tokens(keys, token, sp) of source(keys, text)."""
    return rf"""{name}_t AS (
  SELECT {keys}, i - 1 AS token, trim(regexp_replace(regexp_replace(w[i], '\[\s*\d+(\s*[–—,-]\s*\d+)*\s*\]', '', 'g'), '[¹²³⁰⁴-⁹]', '', 'g')) AS word
  FROM (SELECT {keys}, {words("text")} AS w FROM {source}), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
{name}_d AS (SELECT *, regexp_replace(word, '\s*[—–]\s*', ', ', 'g') AS dashed FROM {name}_t),
{name}_l AS (SELECT *, regexp_replace(lower(dashed), '^[("''“‘]+', '') AS low, list_filter({words(_named("dashed"))}, lambda p: NOT regexp_matches(p, '{T.BULLETS}')) AS ws FROM {name}_d),
{name}_g AS (
  SELECT *, coalesce({ABBREVIATIONS}[low], {ABBREVIATIONS}[regexp_replace(low, '[,;:)]+$', '')]) AS long,
         CASE WHEN len(ws) > 0 THEN list_reduce(ws, lambda a, b: a || CASE WHEN regexp_matches(b, '{PUNCT}') THEN b ELSE ' ' || b END) ELSE '' END AS glued FROM {name}_l),
{name}_tokens AS (
  SELECT {keys}, token, CASE WHEN word = '' OR regexp_matches(word, '{T.BULLETS}') THEN [] WHEN regexp_matches(word, '(?i)^(https?://|www\.)\S+$') THEN ['a link']
    WHEN regexp_matches(word, '(?i)^[^\s@]+@[^\s@]+\.[a-z]{{2,}}$') THEN ['an email address'] WHEN long IS NOT NULL THEN string_split(long, ' ')
    ELSE list_filter(string_split(glued, ' '), lambda p: p <> '') END AS sp FROM {name}_g),
{name}_w AS (SELECT {keys}, token, k, sp[k] AS w FROM {name}_tokens, LATERAL (SELECT unnest(range(1, len(sp) + 1)) AS k)),
{name}_o AS (SELECT *, row_number() OVER p = 1 AS first, row_number() OVER p > 1 AND regexp_matches(w, '{PUNCT}') AS glue, row_number() OVER p AS rn FROM {name}_w WINDOW p AS (PARTITION BY {keys} ORDER BY token, k)),
{name}_words AS (
  SELECT *, CASE WHEN first OR glue THEN 0 ELSE 1 END AS gap,
         coalesce(sum(length(w) + CASE WHEN first OR glue THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN first OR glue THEN 0 ELSE 1 END AS off FROM {name}_o),
{name} AS (
  SELECT s.*, coalesce(x.said, '') AS said, coalesce(x.words, '') AS words FROM {source} s LEFT JOIN (
    SELECT {keys}, string_agg(CASE WHEN gap = 1 THEN ' ' ELSE '' END || w, '' ORDER BY rn) AS said, string_agg(off || ':' || token, ',' ORDER BY rn) FILTER (NOT glue) AS words FROM {name}_words GROUP BY {keys}) x USING ({keys}))"""


TALK = f"""talk AS (
  SELECT conv_id * 1000 + turn + 1000 AS doc_id, text FROM conversations
  UNION ALL SELECT -(conv_id * 1000 + turn + 1000), {lit(A.DECORATED).replace("%1$s", "' || text || '").replace("%2$d", "' || conv_id || '").replace("%3$d", "' || turn || '").replace("%%", "%")} FROM conversations)"""

TOKENS = rf"""toks AS (
  SELECT doc_id, i - 1 AS pos, r[i] AS raw FROM (
    SELECT page_id AS doc_id, regexp_extract_all(html, '(?s)(<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?](?:[^>]*>|.*)|<(?:[^''">]|"[^"]*"|''[^'']*'')*>|[^<]+|<.*)') AS r FROM pages), LATERAL (SELECT unnest(range(1, len(r) + 1)) AS i)),
tokens AS (
  SELECT doc_id, pos, CASE WHEN raw LIKE '</%' AND raw LIKE '%>' THEN 'close' WHEN raw LIKE '<%' AND raw LIKE '%>' THEN 'open' ELSE 'text' END AS kind,
         CASE WHEN raw LIKE '<%>' THEN lower(regexp_replace(regexp_extract(raw, '^</?\s*([^\s/>]+)', 1), '^.*:', '')) END AS name,
         raw LIKE '%/>' AS self_closing, CASE WHEN NOT (raw LIKE '<%>') THEN {entities("raw")} END AS text
  FROM toks WHERE NOT regexp_matches(raw, '^<[!?]'))"""

PAGE_PARAS = rf"""{TOKENS},
skips AS (
  SELECT *, sum(CASE WHEN list_contains({listed(M.SKIPPED)}, name) THEN CASE kind WHEN 'close' THEN -1 WHEN 'open' THEN CASE WHEN self_closing THEN 0 ELSE 1 END ELSE 0 END ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM tokens),
shown AS (
  SELECT * FROM (SELECT *, c - least(0, min(c) OVER (PARTITION BY doc_id ORDER BY pos)) AS skip FROM skips) WHERE skip = 0 AND NOT coalesce(list_contains({listed(M.SKIPPED)}, name), false)),
depths AS (
  SELECT *, sum(CASE WHEN list_contains({listed(M.HEADINGS)}, name) THEN CASE kind WHEN 'open' THEN 1 ELSE -1 END ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS h,
         sum(CASE WHEN list_contains({listed(M.BLOCKS)}, name) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM shown),
flat AS (
  SELECT doc_id, b, {squash("string_agg(CASE WHEN kind = 'text' THEN text ELSE ' ' END, '' ORDER BY pos)")} AS text, bool_or(d > 0) AS heading FROM (
    SELECT *, h - least(0, min(h) OVER (PARTITION BY doc_id ORDER BY pos)) AS d FROM depths) WHERE kind = 'text' OR (name = 'br' AND kind = 'open') GROUP BY doc_id, b),
page_paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS para, text, heading, 1 AS page FROM flat WHERE text <> '')"""

DOC_CHUNKS = f"WITH RECURSIVE {PARAS}, {chunks()}"
PAGE_CHUNKS = f"WITH RECURSIVE {PAGE_PARAS}, {chunks('page_paras')}"
UNITS = f"""{sentences("(SELECT doc_id, idx AS chunk_idx, " + squash("text") + " AS text FROM chunks)", "doc_id, chunk_idx", "us")},
units AS (
  SELECT doc_id, chunk_idx, sid AS unit, text, coalesce(sum(n) OVER (PARTITION BY doc_id, chunk_idx ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS token_start, n AS token_count,
         CASE WHEN regexp_matches(text, '[.!?]["'')\\]”’]?$') THEN 1 ELSE 0 END AS ends_sentence FROM (SELECT *, {n_words("text")} AS n FROM us))"""
SPOKEN = f"""{speech("units", "doc_id, chunk_idx, unit", "said")},
planned AS (
  SELECT p.*, s.said AS speech, coalesce(sum(CASE WHEN s.said <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.chunk_idx, p.unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
  FROM unit_pauses p JOIN said s USING (doc_id, chunk_idx, unit)),
owing AS (SELECT *, CASE WHEN grp = 0 THEN 0 ELSE first_value(pause_ms) OVER (PARTITION BY doc_id, grp ORDER BY chunk_idx, unit) END AS owed FROM planned),
utterances AS (SELECT *, sum(CASE WHEN owed > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_idx, unit) AS breath_group, doc_id || ':' || chunk_idx || ':' || token_start AS cache_key FROM owing WHERE speech <> '')"""
PAUSES = """structural AS (
  SELECT doc_id, idx, heading, CASE WHEN idx = 0 THEN 0 WHEN heading THEN 900 WHEN lag(heading) OVER w THEN 650 WHEN starts_para THEN 460 ELSE 0 END AS pause_ms FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY idx))"""
UNIT_PAUSES = f"""{UNITS}, {PAUSES},
unit_pauses AS (
  SELECT u.*, s.heading, CASE WHEN lag(u.chunk_idx) OVER w IS NULL THEN 0 WHEN u.chunk_idx <> lag(u.chunk_idx) OVER w AND s.pause_ms > 0 THEN s.pause_ms WHEN lag(u.ends_sentence) OVER w = 1 THEN 220 ELSE 0 END AS pause_ms,
         lead(u.chunk_idx) OVER w AS next_chunk, lead(u.unit) OVER w AS next_unit
  FROM units u JOIN structural s ON s.doc_id = u.doc_id AND s.idx = u.chunk_idx WINDOW w AS (PARTITION BY u.doc_id ORDER BY u.chunk_idx, u.unit))"""
TIMES = f"times AS (SELECT doc_id, idx AS chunk_idx, w AS words, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, {n_words('text')} AS w FROM chunks))"
SAID = "events AS (SELECT event_id, (user_id % (SELECT count(*) FROM documents)) AS book_id, event_id % 17 AS chunk_idx, event_id % 23 AS token_idx, ts, event_type FROM main.events)"
LATEST = "latest AS (SELECT book_id, arg_max(chunk_idx, (ts, event_id)) AS chunk_idx FROM ev GROUP BY book_id)"
EV = SAID.replace("events AS", "ev AS", 1).replace("main.events", "events")
BOOKS = "books AS (SELECT doc_id AS book_id, upper(lang[1]) || lower(lang[2:]) || ' book ' || doc_id AS title, CASE WHEN doc_id % 3 > 0 THEN source END AS author, 1700000000000 + doc_id * 60000 AS added_at FROM documents)"
SHELF = f"""{TIMES}, {EV}, {LATEST}, {BOOKS},
whole AS (SELECT doc_id AS book_id, sum(words) AS words, max(chunk_idx) AS last FROM times GROUP BY doc_id),
placed AS (
  SELECT b.*, w.words, coalesce(w.last, 0) AS last, l.chunk_idx AS saved, least(greatest(coalesce(l.chunk_idx, 0), 0), coalesce(w.last, 0)) AS spot FROM books b LEFT JOIN whole w USING (book_id) LEFT JOIN latest l USING (book_id)),
shelf AS (
  SELECT p.book_id, title, author, added_at, round(greatest(coalesce(p.words, 0) - coalesce(t.before, 0), 0) / 165.0 * 60, 6) AS remaining_s,
         CASE WHEN p.words > 0 THEN round(coalesce(t.before, 0) / p.words, 6) ELSE 0.0 END AS fraction, CASE WHEN saved IS NULL THEN 0 ELSE 1 END AS started, CASE WHEN saved IS NOT NULL AND spot >= last THEN 1 ELSE 0 END AS finished
  FROM placed p LEFT JOIN times t ON t.doc_id = p.book_id AND t.chunk_idx = p.spot)"""
CHAPTERS = r"""heads AS (
  SELECT doc_id, left(text, 120) AS title, idx AS chunk_idx, page, CASE WHEN regexp_matches(text, '(?i)^(chapter|part|section|book|appendix|prologue|epilogue|introduction|conclusion|preface|foreword)([^A-Za-z0-9_]|$)') THEN 0 ELSE 1 END AS level,
         count(*) OVER (PARTITION BY doc_id) AS n FROM chunks WHERE heading),
useful AS (SELECT * FROM heads WHERE n <= 80 OR level = 0),
chapters AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) - 1 AS seq, title, chunk_idx, page, level FROM (
    SELECT doc_id, title, chunk_idx, page, level FROM useful
    UNION ALL SELECT doc_id, 'Beginning', 0, page, 0 FROM chunks c WHERE idx = 0 AND NOT EXISTS (SELECT 1 FROM useful u WHERE u.doc_id = c.doc_id AND u.chunk_idx = 0)))"""
ACTIVE = """active AS (
  SELECT c.doc_id, c.idx AS chunk_idx, coalesce(max(CASE WHEN h.chunk_idx <= c.idx THEN h.seq END), min(h.seq)) AS seq FROM chunks c JOIN chapters h USING (doc_id) GROUP BY c.doc_id, c.idx)"""
SET = r"""tw AS (SELECT doc_id, para, string_split(text, ' ') AS w FROM paras),
tl AS (
  SELECT doc_id, para, k, len(w) AS n, array_to_string(list_slice(w, k * 9 + 1, k * 9 + 9), ' ') AS text FROM tw, LATERAL (SELECT unnest(range(0, (len(w) - 1) // 9 + 1)) AS k)),
tg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para, k) - 1 AS g, CASE WHEN doc_id % 4 = 1 THEN 64 ELSE 32 END AS per FROM tl),
ts AS (SELECT *, g % per AS slot, CASE WHEN g % per >= 32 THEN 320.0 ELSE 60.0 END AS base FROM tg),
body AS (
  SELECT doc_id, g // per + 1 AS page, slot + 1 AS line_no, text, base + CASE WHEN k = 0 AND doc_id % 2 = 0 THEN 14.0 ELSE 0.0 END AS x0, base + CASE WHEN doc_id % 4 = 1 THEN 240.0 ELSE 490.0 END AS most,
         CAST(700 - (slot % 32) * 15 AS DOUBLE) AS y, CASE WHEN n <= 3 AND doc_id % 4 <> 1 THEN 14.0 ELSE 11.0 END AS font_size FROM ts),
pgs AS (SELECT DISTINCT doc_id, page FROM body),
lines AS (
  SELECT doc_id, page, line_no, text, x0, least(x0 + length(text) * 8.0, most) AS x1, y, font_size FROM body
  UNION ALL SELECT doc_id, page, 0, 'Running title ' || doc_id, 72.0, 200.0, 750.0, 9.0 FROM pgs
  UNION ALL SELECT doc_id, page, 900, 'Page ' || page, 290.0, 320.0, 30.0, 9.0 FROM pgs
  UNION ALL SELECT doc_id, page, 901, 'note ' || page || ' see the sources', 60.0, 200.0, 120.0, 7.0 FROM pgs WHERE page % 3 = 0),
bodies AS (
  SELECT doc_id, CAST(min(font_size) AS DOUBLE) AS body FROM (
    SELECT doc_id, font_size, sum(w) OVER (PARTITION BY doc_id ORDER BY font_size) AS c, sum(w) OVER (PARTITION BY doc_id) AS a FROM (SELECT doc_id, font_size, sum(greatest(1, floor(length(text) / 10.0 + 0.5))) AS w FROM lines GROUP BY 1, 2)) WHERE c > floor(a / 2) GROUP BY doc_id),
keyed AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '\d+', '#', 'g'), '\s+', ' ', 'g')) AS key, y > 792 * 0.92 OR y < 792 * 0.08 AS edge FROM lines),
repeated AS (
  SELECT doc_id, key FROM (SELECT doc_id, key, count(DISTINCT page) AS n FROM keyed WHERE edge AND key <> '' GROUP BY 1, 2) JOIN (SELECT doc_id, count(*) AS pages FROM pgs GROUP BY 1) USING (doc_id)
  WHERE n >= CASE WHEN pages <= 4 THEN 2 ELSE greatest(3, ceil(pages * 0.25)) END),
judged AS (
  SELECT k.*, b.body, CASE WHEN edge AND (regexp_matches(text, '(?i)^(page\s+)?[ivxlcdm\d]{1,6}$') OR r.key IS NOT NULL) THEN 'margin' WHEN font_size <= body * 0.86 AND y < 792 * 0.28 THEN 'footnote' END AS gone
  FROM keyed k LEFT JOIN repeated r ON r.doc_id = k.doc_id AND r.key = k.key JOIN bodies b ON b.doc_id = k.doc_id),
kept AS (SELECT * FROM judged WHERE gone IS NULL)"""
CANDS = ", ".join(f"({i}, {f!r})" for i, f in enumerate(L.gutter_fractions()))
ORDER = f"""tried AS (
  SELECT doc_id, page, i, 612.0 * f AS x, count(*) FILTER (x0 < 612.0 * f AND x1 > 612.0 * f) AS cr, count(*) FILTER (NOT (x0 < 612.0 * f AND x1 > 612.0 * f) AND x1 <= 612.0 * f) AS le, count(*) AS n
  FROM kept, (VALUES {CANDS}) AS c(i, f) GROUP BY doc_id, page, i, f),
ranked AS (SELECT *, least(le, n - cr - le) / n AS bal, row_number() OVER (PARTITION BY doc_id, page ORDER BY cr, -least(le, n - cr - le) / n, i) AS k FROM tried),
gutters AS (SELECT doc_id, page, x AS gutter FROM ranked WHERE k = 1 AND n >= 6 AND cr / n <= 0.15 AND bal >= 0.2),
spans AS (
  SELECT k.*, gutter, coalesce(x0 < gutter AND x1 > gutter, false) AS spanning FROM kept k LEFT JOIN gutters USING (doc_id, page)),
turns AS (SELECT *, CASE WHEN spanning <> lag(spanning) OVER (PARTITION BY doc_id, page ORDER BY y DESC, x0, line_no) THEN 1 ELSE 0 END AS t FROM spans),
bands AS (
  SELECT *, sum(t) OVER (PARTITION BY doc_id, page ORDER BY y DESC, x0, line_no) AS band, CASE WHEN gutter IS NULL OR spanning OR x1 <= gutter THEN 0 ELSE 1 END AS col FROM turns),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, col, y DESC, x0, line_no) - 1 AS pos FROM bands)"""
GAPS = """steps AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page, band, col ORDER BY pos) - y AS d FROM ordered),
gaps AS (
  SELECT doc_id, page, band, col, CAST(coalesce(g[len(g) // 2 + 1], 0.0) AS DOUBLE) AS gap FROM (SELECT doc_id, page, band, col, coalesce(list_sort(list(d) FILTER (d > 0)), []) AS g FROM steps GROUP BY ALL))"""
HYPHENS = r"""regexp_replace(array_to_string(list_filter(list_transform(LINES, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)), '[‐-—-]' || chr(10) || '([a-z])', '\1', 'g')"""
ASSEMBLED = f"""widths AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page) - min(x0) OVER (PARTITION BY doc_id, page) AS page_width FROM ordered),
blocks AS (
  SELECT *, min(x0) OVER b AS l, max(x1) OVER b AS r, row_number() OVER (PARTITION BY doc_id, page, band, col ORDER BY pos) - 1 AS i FROM widths JOIN gaps USING (doc_id, page, band, col) WINDOW b AS (PARTITION BY doc_id, page, band, col)),
marked AS (
  SELECT *, greatest(r - l, 1.0) AS w, regexp_matches(text, '[.!?]["'')\\]]?$') AS stops, length(text) <= 90 AND (regexp_matches(text, '(?i)^(chapter|part|section|appendix|prologue|epilogue)([^A-Za-z0-9_]|$)')
         OR (font_size >= body * 1.18 AND x1 - x0 < page_width * 0.75 AND NOT regexp_matches(text, '[.!?]["'')\\]]?$'))) AS heading FROM blocks),
flows AS (
  SELECT *, lag(heading) OVER f AS ph, lag(spanning) OVER f AS ps, lag(x1) OVER f AS px1, lag(r) OVER f AS pr, lag(w) OVER f AS pw, lag(y) OVER f AS py, lag(stops) OVER f AS pstops, x0 - l > w * 0.03 AND x0 - l < w * 0.25 AS dent
  FROM marked WINDOW f AS (PARTITION BY doc_id ORDER BY page, pos)),
joins AS (
  SELECT *, CASE WHEN ph IS NULL OR heading OR ph OR (i = 0 AND (spanning OR ps)) OR dent OR (i > 0 AND ((gap > 0 AND py - y > gap * 1.5) OR (pstops AND px1 < r - w * 0.12))) OR (i = 0 AND px1 < pr - pw * 0.12) THEN 1 ELSE 0 END AS begins FROM flows),
paragraphed AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY page, pos) AS p FROM joins),
page_texts AS (
  SELECT doc_id, p, {squash(HYPHENS.replace("LINES", "list(text ORDER BY page, pos)"))} AS text, min(page) AS page, bool_or(heading) AS heading FROM paragraphed GROUP BY doc_id, p),
set_paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS para, text, page, heading FROM page_texts WHERE text <> '')"""
RUN_LINES = """word_runs AS (
  SELECT doc_id, page, line_no * 1000 + k - 1 AS seq, w[k] AS text, spot AS x0, spot + length(w[k]) * 5.0 AS x1, y, font_size FROM (
    SELECT *, x0 + coalesce(list_sum(list_transform(list_slice(w, 1, k - 1), lambda x: length(x) * 5.0 + 4.0)), 0) AS spot FROM (SELECT *, string_split(text, ' ') AS w FROM lines), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k))),
run_steps AS (SELECT *, x0 - lag(x1) OVER o AS gap, lag(y) OVER o AS py FROM word_runs WINDOW o AS (PARTITION BY doc_id, page ORDER BY y DESC, x0, seq)),
run_turns AS (SELECT *, CASE WHEN py = y AND gap < font_size * 3.5 THEN 0 ELSE 1 END AS t FROM run_steps),
run_groups AS (SELECT *, sum(t) OVER (PARTITION BY doc_id, page ORDER BY y DESC, x0, seq) AS n FROM run_turns),
run_lines AS (
  SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY n) - 1 AS line_no, text, x0, x1, y, font_size FROM (
    SELECT doc_id, page, n, SQUASHED AS text, min(x0) AS x0, max(x1) AS x1, max(y) AS y, max(font_size) AS font_size
    FROM run_groups GROUP BY doc_id, page, n) WHERE text <> '')""".replace("SQUASHED", squash("string_agg(CASE WHEN t = 0 AND gap > font_size * 0.2 THEN ' ' ELSE '' END || text, '' ORDER BY x0, seq)"))
SETTING = f"WITH {PARAS}, {SET}"
VOICES = f"""voices AS (
  SELECT CAST(s_suppkey AS INTEGER) AS pos, 'v' || s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 THEN {listed(A.JOKES)}[s_suppkey % {len(A.JOKES)} + 1] ELSE upper(n_name[1]) || lower(n_name[2:]) || {listed(A.VOICE_ENDS)}[s_suppkey % {len(A.VOICE_ENDS)} + 1] END AS name,
         {listed(A.VOICE_LANGUAGES)}[n_nationkey % {len(A.VOICE_LANGUAGES)} + 1] AS lang, s_suppkey % 13 = 0 AS is_default, CASE WHEN s_suppkey % 5 = 0 THEN false WHEN s_suppkey % 5 > 1 THEN true END AS local_service
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
TIER = rf"""{VOICES},
tiers AS (
  SELECT *, CASE tier WHEN 'good' THEN 2 WHEN 'legacy' THEN 1 ELSE 0 END AS rank FROM (
    SELECT *, CASE WHEN list_contains({listed(V.NOVELTY)}, lower(base)) THEN 'novelty' WHEN local_service IS NOT DISTINCT FROM false OR regexp_matches(name, '(?i)(^|[^A-Za-z0-9_])(enhanced|premium|natural|neural|online|siri|google|microsoft)([^A-Za-z0-9_]|$)') THEN 'good' ELSE 'legacy' END AS tier
    FROM (SELECT *, trim(regexp_replace(regexp_replace(name, '(?i)\s*\((enhanced|premium|compact)\)\s*', ' ', 'g'), '\s+', ' ', 'g')) AS base FROM voices))),
usable AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(base), lower(lang) ORDER BY rank DESC, pos) AS k FROM (
    SELECT *, max(rank) OVER (PARTITION BY lower(lang[:2])) AS top FROM tiers WHERE tier <> 'novelty') WHERE rank = top) WHERE k = 1),
best AS (
  SELECT *, CASE WHEN lower(replace(lang, '_', '-')) = 'en-us' THEN 30 WHEN lower(lang) LIKE 'en%' THEN 20 ELSE 0 END + 2 * rank + CASE WHEN is_default THEN 1 ELSE 0 END AS score FROM usable)"""
STARRED = ["v8", "gone", "v3", "v26"]
STAR = f"CASE WHEN list_contains({listed(STARRED)}, id) THEN list_position({listed(STARRED)}, id) - 1 WHEN lower(lang) LIKE 'en%' AND is_default THEN 7 WHEN lower(lang) LIKE 'en%' THEN 8 ELSE 9 END"


def filled(forms: list[str]) -> str:
    """The Spark format strings of a document's property, by turns."""
    cases = " ".join(f"WHEN {i} THEN " + lit(f).replace("%1$.1s", "' || source[1] || '").replace("%1$s", "' || source || '").replace("%2$d", "' || doc_id || '") for i, f in enumerate(forms))
    return f"CASE doc_id % {len(forms)} {cases} END"


#: The books that adapters make of ten pages each: their folder, reading order and contents entries.
SHELVED = """spines AS (
  SELECT page_id, page_id // 10 AS doc_id, CASE WHEN page_id // 10 % 2 = 0 THEN 'OEBPS/' ELSE '' END AS root, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id * 7 % 10) AS section FROM pages WHERE page_id % 10 <> 4),
rooted AS (SELECT page_id, page_id // 10 AS doc_id, CASE WHEN page_id // 10 % 2 = 0 THEN 'OEBPS/' ELSE '' END AS root FROM pages),
navs AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_id) - 1 AS INTEGER) AS seq, CASE WHEN page_id % 2 = 0 THEN 'Part ' ELSE 'Inner ' END || page_id AS title, root || 'text/p' || page_id || '.xhtml' AS href, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END AS level
  FROM rooted WHERE doc_id % 3 <> 2 AND (page_id % 2 = 0 OR (page_id % 4 = 1 AND page_id % 10 >= 1))),
ncxs AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_id) - 1 AS INTEGER) AS seq, CASE WHEN page_id % 3 = 0 THEN 'Section ' ELSE 'Sub ' END || page_id AS title, root || 'text/p' || page_id || '.xhtml' AS href, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS level
  FROM rooted WHERE doc_id % 3 <> 0 AND (page_id % 3 = 0 OR (page_id % 3 = 1 AND page_id % 2 = 1 AND page_id % 10 >= 1))),
tocs AS (SELECT * FROM navs UNION ALL SELECT * FROM ncxs WHERE doc_id % 3 = 2)"""
BOOKED = f"""{SHELVED},
bchunks AS (
  SELECT s.doc_id, section AS page, row_number() OVER (PARTITION BY s.doc_id ORDER BY section, c.idx) - 1 AS idx, text, heading FROM chunks c JOIN spines s ON s.page_id = c.doc_id WHERE s.page_id % 7 <> 3),
{CHAPTERS.replace("FROM chunks", "FROM bchunks")},
bstarts AS (SELECT doc_id, page, min(idx) AS chunk_idx FROM bchunks GROUP BY ALL),
bplaced AS (
  SELECT t.doc_id, t.seq, t.title, b.chunk_idx, b.page, t.level, count(*) OVER (PARTITION BY t.doc_id) AS n
  FROM tocs t JOIN spines s ON s.doc_id = t.doc_id AND t.href = s.root || 'text/p' || s.page_id || '.xhtml' JOIN bstarts b ON b.doc_id = t.doc_id AND b.page = s.section),
blist AS (
  SELECT doc_id, seq, title, chunk_idx, page, level FROM bplaced WHERE n >= 2
  UNION ALL SELECT f.doc_id, -1, 'Beginning', 0, c.page, 0 FROM (SELECT doc_id, arg_min(chunk_idx, seq) AS at FROM bplaced WHERE n >= 2 GROUP BY doc_id) f JOIN bchunks c ON c.doc_id = f.doc_id AND c.idx = 0 WHERE f.at > 0),
bchapters AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS seq, title, chunk_idx, page, level FROM blist
  UNION ALL SELECT doc_id, seq, title, chunk_idx, page, level FROM chapters WHERE doc_id NOT IN (SELECT doc_id FROM blist))"""


def ordered_voices(source: str) -> str:
    return f"SELECT id, row_number() OVER (ORDER BY {STAR}, replace(lang, '_', '!'), name, pos) - 1 AS place FROM {source}"


PLAYER = f"""{EV},
acts AS (SELECT *, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in P.ACTIONS.items())} END AS action FROM ev),
runs AS (
  SELECT *, last_value(CASE WHEN action IN ('play', 'stop') THEN action END IGNORE NULLS) OVER w AS turn, last_value(CASE WHEN action IN ('play', 'pause', 'resume') THEN action END IGNORE NULLS) OVER w AS toggle,
         last_value(CASE WHEN action IN ('play', 'seek') THEN chunk_idx END IGNORE NULLS) OVER w AS spot FROM acts WINDOW w AS (PARTITION BY book_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, book_id, CASE WHEN coalesce(turn, 'stop') = 'stop' THEN 'idle' WHEN toggle = 'pause' THEN 'paused' ELSE 'playing' END AS status, coalesce(spot, 0) AS chunk_idx FROM runs"""
PROGRESS = f"WITH {EV}, {LATEST} SELECT book_id, chunk_idx FROM latest"
CLOCK = "SELECT doc_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT doc_id, CASE WHEN n_chars * 3.5 - 20 < 0 THEN 0 ELSE CAST(floor(n_chars * 3.5 - 20 + 0.5) AS BIGINT) END AS s FROM documents)"

OUTLINE = r"""WITH RECURSIVE nodes AS (
  SELECT doc_id, node, CASE WHEN node >= 3 THEN node // 3 - 1 END AS parent, 20 - node AS place, CASE WHEN node = 1 THEN '' ELSE trim(regexp_replace(left(text, 12), '\s+', ' ', 'g')) END AS title, CASE WHEN node % 4 > 0 THEN node END AS page
  FROM documents, (SELECT unnest(range(12)) AS node)),
walk AS (
  SELECT doc_id, node, title, page, 0 AS level, [place] AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.doc_id, n.node, n.title, n.page, level + 1, list_append(path, n.place) FROM walk w JOIN nodes n ON n.doc_id = w.doc_id AND n.parent = w.node)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS INTEGER) AS seq, title, CAST(page AS INTEGER) AS page, level FROM walk WHERE title <> ''"""


def oracle_sql() -> dict[str, str]:
    found = {
        "s1_format": "SELECT page_id, CASE WHEN regexp_matches(CASE WHEN page_id % 3 = 0 THEN url || '.EPUB' ELSE url END, '(?i)\\.epub$') THEN 'epub' ELSE 'pdf' END AS format FROM pages",
        "s2_supported": "SELECT page_id FROM pages WHERE page_id % 3 < 2",
        "s7_container": f"WITH {SHELVED} SELECT DISTINCT doc_id, root || 'b' || doc_id || '.opf' AS opf_path FROM rooted",
        "s8_spine": f"WITH {SHELVED} SELECT doc_id, CAST(section - 1 AS INTEGER) AS seq, root || 'text/p' || page_id || '.xhtml' AS path FROM spines",
        "s8_package": f"WITH {SHELVED} SELECT DISTINCT doc_id, 'Pages of ' || doc_id || ' & more' AS title, 'Site ' || (doc_id % 4) AS author, CASE WHEN doc_id % 3 <> 2 THEN root || 'nav.xhtml' END AS nav_path, CASE WHEN doc_id % 3 <> 0 THEN root || 'toc.ncx' END AS ncx_path FROM rooted",
        "m2_nav": f"WITH {SHELVED} SELECT * FROM navs",
        "m3_ncx": f"WITH {SHELVED} SELECT * FROM ncxs",
        "m4_toc": f"WITH {SHELVED} SELECT * FROM tocs",
        "m6_book_ingest": f"""{PAGE_CHUNKS}, {BOOKED}, counted AS (SELECT doc_id, count(*) AS chunk_count, CAST(sum({n_words('text')}) AS BIGINT) AS word_count FROM bchunks GROUP BY doc_id)
SELECT doc_id, 'Pages of ' || doc_id || ' & more' AS title, 'Site ' || (doc_id % 4) AS author, (SELECT count(*) FROM spines s WHERE s.doc_id = counted.doc_id) AS page_count, chunk_count, word_count, (SELECT count(*) FROM bchapters b WHERE b.doc_id = counted.doc_id) AS chapters FROM counted""",
        "m6_book_chapters": f"{PAGE_CHUNKS}, {BOOKED} SELECT * FROM bchapters",
        "s10_tokens": f"WITH {TOKENS} SELECT doc_id, kind, count(*) AS n, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, max(pos) AS last_pos FROM tokens GROUP BY doc_id, kind",
        "s10_names": f"WITH {TOKENS} SELECT kind, name, count(*) AS n FROM tokens WHERE kind <> 'text' GROUP BY kind, name",
        "s11_entities": f"SELECT page_id, md5({entities('t')}) AS decoded FROM (SELECT page_id, replace(html, '<', '&lt;') AS t FROM pages)",
        "s14_parse_voices": f"WITH {VOICES} SELECT pos AS n, place, CASE place WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END || pos AS id, CASE place WHEN 0 THEN name WHEN 1 THEN name || ': bright' ELSE 'c' || pos END AS name, 'en-US' AS lang FROM voices, (VALUES (0), (1), (2)) AS p(place)",
        "s4_glyph_runs": f"{SETTING} SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no, k) - 1 AS INTEGER) AS seq, w[k] AS text, round(spot, 3) AS x0, round(spot + length(w[k]) * 5.0, 3) AS x1, CAST(y AS DOUBLE) AS y, CAST(font_size AS DOUBLE) AS font_size FROM (SELECT *, x0 + coalesce(list_sum(list_transform(list_slice(w, 1, k - 1), lambda x: length(x) * 5.0 + 4.0)), 0) AS spot FROM (SELECT *, string_split(text, ' ') AS w FROM lines), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k))",
        "s9_resolve_path": f"""WITH asked AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS base, {listed(A.HREFS)}[page_id % {len(A.HREFS)} + 1] AS href FROM pages),
cut AS (SELECT *, split_part(href, '#', 1) AS path, list_filter(string_split(regexp_replace(base, '[^/]*$', '') || split_part(href, '#', 1), '/'), lambda p: p NOT IN ('', '.')) AS parts FROM asked)
SELECT page_id, CASE WHEN path = '' THEN base WHEN path LIKE '/%' THEN path[2:] ELSE array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(parts, lambda p: [p])), lambda done, p: CASE WHEN p[1] = '..' THEN list_slice(done, 1, len(done) - 1) ELSE done || p END), '/') END AS path FROM cut""",
        "l1_group_lines": f"{SETTING}, {RUN_LINES} SELECT doc_id, page, CAST(line_no AS INTEGER) AS line_no, text, round(x0, 3) AS x0, round(x1, 3) AS x1, CAST(y AS DOUBLE) AS y, CAST(font_size AS DOUBLE) AS font_size FROM run_lines",
        "l11_paragraphs": f"{SETTING}, {ORDER}, {GAPS}, {ASSEMBLED} SELECT doc_id, para, text, page, CAST(heading AS INTEGER) AS heading FROM set_paras",
        "c9_page_chunks": f"WITH RECURSIVE {PARAS}, {SET}, {ORDER}, {GAPS}, {ASSEMBLED}, {chunks('set_paras')} SELECT doc_id, idx, text, page, para, CAST(starts_para AS INTEGER) AS starts_para, CAST(heading AS INTEGER) AS heading FROM chunks",
        "c9_page_ingest": f"""WITH RECURSIVE {PARAS}, {SET}, {ORDER}, {GAPS}, {ASSEMBLED}, {chunks('set_paras')}, {CHAPTERS},
counted AS (SELECT doc_id, count(*) AS chunk_count, CAST(sum({n_words('text')}) AS BIGINT) AS word_count FROM chunks GROUP BY doc_id),
noise AS (SELECT doc_id, count(*) FILTER (gone = 'margin') AS margin_lines, count(*) FILTER (gone = 'footnote') AS footnote_lines, count(DISTINCT page) AS page_count FROM judged GROUP BY doc_id),
sided AS (SELECT doc_id, count(*) AS c FROM (SELECT doc_id, page FROM ordered GROUP BY doc_id, page HAVING count(DISTINCT (band, col)) > 1 OR max(col) > 0) GROUP BY doc_id)
SELECT doc_id, chunk_count, word_count, page_count, (SELECT count(*) FROM chapters h WHERE h.doc_id = counted.doc_id) AS chapters, margin_lines, footnote_lines, coalesce(c, 0) AS column_pages FROM counted JOIN noise USING (doc_id) LEFT JOIN sided USING (doc_id)""",
        "m5_toc_chapters": f"""{DOC_CHUNKS}, starts AS (SELECT doc_id, page, min(idx) AS chunk_idx, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks GROUP BY doc_id, page),
listing AS (
  SELECT doc_id, 100 - page AS k, 'Part ' || page AS title, chunk_idx, page FROM starts WHERE n >= 2
  UNION ALL SELECT s.doc_id, -1, 'Beginning', 0, c.page FROM (SELECT doc_id, arg_max(chunk_idx, page) AS f FROM starts WHERE n >= 2 GROUP BY doc_id) s JOIN chunks c ON c.doc_id = s.doc_id AND c.idx = 0 WHERE f > 0
  UNION ALL SELECT doc_id, -1, 'Beginning', 0, page FROM starts WHERE n = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS seq, title, chunk_idx, page, 0 AS level FROM listing""",
        "l2_body_size": f"{SETTING} SELECT * FROM bodies",
        "l3_margins": f"{SETTING} SELECT * FROM repeated",
        "l4_margin_noise": f"{SETTING} SELECT doc_id, page, line_no, text FROM judged WHERE gone = 'margin'",
        "l5_footnotes": f"{SETTING} SELECT doc_id, page, line_no, text FROM judged WHERE gone = 'footnote'",
        "l6_gutters": f"{SETTING}, {ORDER} SELECT doc_id, page, round(gutter, 6) AS gutter FROM gutters",
        "l7_reading_order": f"{SETTING}, {ORDER} SELECT doc_id, page, line_no, CAST(band AS INTEGER) AS band, col, CAST(spanning AS INTEGER) AS spanning, pos FROM ordered",
        "l8_block_gaps": f"{SETTING}, {ORDER}, {GAPS} SELECT doc_id, page, CAST(band AS INTEGER) AS band, col, gap FROM gaps",
        "l12_join_lines": rf"SELECT doc_id, md5({squash('''regexp_replace(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)), '[‐-—-]' || chr(10) || '([a-z])', '\\1', 'g')''')}) AS joined FROM (SELECT doc_id, regexp_replace(text, '([a-z]{{4}})([a-z]{{4}})', '\1-' || chr(10) || '\2', 'g') AS t FROM documents)",
        "l13_stats": f"{SETTING}, {ORDER} SELECT doc_id, body, m AS margin_lines, f AS footnote_lines, coalesce(c, 0) AS column_pages FROM (SELECT doc_id, any_value(body) AS body, count(*) FILTER (gone = 'margin') AS m, count(*) FILTER (gone = 'footnote') AS f FROM judged GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS c FROM (SELECT doc_id, page FROM ordered GROUP BY doc_id, page HAVING count(DISTINCT (band, col)) > 1 OR max(col) > 0) GROUP BY doc_id) USING (doc_id)",
        "m1_paragraphs": f"WITH {PAGE_PARAS} SELECT doc_id, para, text, CAST(heading AS INTEGER) AS heading FROM page_paras",
        "c1_sentences": f"WITH {PARAS}, {sentences('paras', 'doc_id, para', 'sents')} SELECT doc_id, para, sid, text FROM sents",
        "c2_pack_counts": f"{DOC_CHUNKS} SELECT doc_id, para, count(*) AS pieces, max(length(text)) AS longest FROM chunks GROUP BY doc_id, para",
        "c3_hard_split": f"{DOC_CHUNKS} SELECT doc_id, para, sid, part, text FROM hard",
        "c4_chunks": f"{DOC_CHUNKS} SELECT doc_id, idx, text, page, para, CAST(starts_para AS INTEGER) AS starts_para, CAST(heading AS INTEGER) AS heading FROM chunks",
        "c5_chapters": f"{PAGE_CHUNKS}, {CHAPTERS} SELECT * FROM chapters",
        "c6_outline": rf"""{DOC_CHUNKS}, plain AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS p FROM chunks),
o AS (SELECT doc_id, idx AS seq, left(text, 30) AS title, page, left(trim(regexp_replace(regexp_replace(lower(left(text, 30)), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), 24) AS head FROM chunks WHERE starts_para AND idx % 5 > 0)
SELECT o.doc_id, o.seq, o.title, coalesce(min(c.idx) FILTER (c.page = o.page AND starts_with(c.p, o.head)), min(c.idx)) AS chunk_idx, o.page, 0 AS level FROM o JOIN plain c ON c.doc_id = o.doc_id AND c.page BETWEEN o.page AND o.page + 1 GROUP BY ALL""",
        "c7_match_title": f"WITH {PARAS} SELECT doc_id, para, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS plain FROM paras",
        "c8_heading_chapters": f"{PAGE_CHUNKS}, {CHAPTERS} SELECT doc_id, title, chunk_idx, page, level FROM useful",
        "c10_word_count": f"SELECT doc_id, {n_words('text')} AS words FROM documents WHERE {n_words('text')} > 0",
        "c11_titles": f"SELECT doc_id, CASE WHEN length(trim(text)) < 2 OR regexp_matches(trim(text), '(?i)^(untitled|unknown|document[0-9]*|microsoft word|pdf document)$|^microsoft word\\s*-|\\.(docx?|pdf|epub|indd|tex|pages|odt)$') THEN NULL ELSE trim(text) END AS title FROM (SELECT doc_id, regexp_replace({filled(A.TITLES)}, '^\\s+|\\s+$', '', 'g') AS text FROM documents)",
        "c12_authors": f"SELECT doc_id, CASE WHEN trim(text) = '' OR regexp_matches(trim(text), '(?i)^(anonymous|unknown|user|administrator|owner)$') THEN NULL ELSE trim(text) END AS author FROM (SELECT doc_id, regexp_replace({filled(A.AUTHORS)}, '^\\s+|\\s+$', '', 'g') AS text FROM documents)",
        "t1_speak_tokens": f"WITH {TALK}, {speech('talk', 'doc_id')} SELECT doc_id, CAST(token AS INTEGER) AS token, array_to_string(sp, '|') AS spoken FROM said_tokens",
        "t4_speech": f"WITH {TALK}, {speech('talk', 'doc_id')} SELECT doc_id, said AS text, words FROM said",
        "t5_token_at": f"WITH {TALK}, {speech('talk', 'doc_id')} SELECT doc_id, spot AS \"at\", CAST(coalesce(arg_max(token, off) FILTER (NOT glue AND off <= spot), -1) AS INTEGER) AS token FROM talk CROSS JOIN (VALUES (-1), (0), (7), (40), (10000)) AS p(spot) LEFT JOIN said_words USING (doc_id) GROUP BY doc_id, spot",
        "x3_highlights": f"WITH {TALK}, {speech('talk', 'doc_id')}, asked AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN -1 ELSE 1 END * (event_id % 150 * 1000 + event_id % 9 + 1000) AS doc_id, event_id % 401 - 3 AS spot FROM events) SELECT event_id, doc_id, CAST(spot AS INTEGER) AS \"at\", CASE WHEN doc_id IN (SELECT doc_id FROM talk) THEN CAST(coalesce(arg_max(token, off) FILTER (NOT glue AND off <= spot), 0) AS INTEGER) END AS token FROM asked LEFT JOIN said_words USING (doc_id) GROUP BY event_id, doc_id, spot",
        "x5_ingest": f"{PAGE_CHUNKS} SELECT doc_id, idx, text, page, para, CAST(starts_para AS INTEGER) AS starts_para, CAST(heading AS INTEGER) AS heading FROM chunks",
        "x5_progress": "SELECT stage, fraction::DOUBLE AS fraction, CASE WHEN stage = 'reading' THEN 0 ELSE n END AS page, n AS page_count FROM (SELECT count(*) + count(*) FILTER (page_id % 5 = 0) AS n FROM pages), (VALUES ('reading', 0), ('extracting', 0.9), ('cleaning', 0.92), ('done', 1)) AS t(stage, fraction)",
        "n6_utterances": f"{PAGE_CHUNKS}, {UNIT_PAUSES}, {SPOKEN} SELECT doc_id, chunk_idx, unit, speech, round(CASE WHEN heading THEN 0.94 ELSE 1 END, 6)::DOUBLE AS rate, owed AS pause_ms, cache_key FROM utterances",
        "s3_page_scan": f"""{SETTING}, {RUN_LINES}, counted AS (SELECT doc_id, page, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM run_lines GROUP BY ALL),
named AS (SELECT doc_id, regexp_replace({filled(A.TITLES)}, '^\\s+|\\s+$', '', 'g') AS title, nullif(regexp_replace({filled(A.AUTHORS)}, '^\\s+|\\s+$', '', 'g'), '') AS author FROM documents)
SELECT p.doc_id, p.page, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, coalesce(lines, 0) AS lines, coalesce(chars, 0) AS chars, title, author, count(*) OVER (PARTITION BY p.doc_id) AS page_count FROM pgs p LEFT JOIN counted c ON c.doc_id = p.doc_id AND c.page = p.page JOIN named n ON n.doc_id = p.doc_id""",
        "u1_provider_plans": f"""{PAGE_CHUNKS}, {UNIT_PAUSES}, {SPOKEN}, engines AS (SELECT * FROM (VALUES ('web', true, true, false), ('http', false, false, false), ('system', true, true, true), ('plain', true, false, true)) AS t(provider, bounds, queues, delays)),
planned2 AS (SELECT provider, bounds, doc_id, chunk_idx, unit, owed, row_number() OVER w > 1 AND queues AND (owed = 0 OR delays) AS q FROM utterances, engines WINDOW w AS (PARTITION BY provider, doc_id ORDER BY chunk_idx, unit)),
grouped2 AS (SELECT *, sum(CASE WHEN q THEN 0 ELSE 1 END) OVER (PARTITION BY provider, doc_id ORDER BY chunk_idx, unit) - 1 AS g FROM planned2)
SELECT provider, doc_id, chunk_idx, unit, CAST(g AS INTEGER) AS breath_group, CAST(least(row_number() OVER (PARTITION BY provider, doc_id, g ORDER BY chunk_idx, unit) - 1, 3) AS INTEGER) AS queued_behind, CASE WHEN q THEN owed ELSE 0 END AS pre_delay_ms, CASE WHEN q THEN 0 ELSE owed END AS timer_ms, CASE WHEN bounds THEN 'word' ELSE 'unit' END AS highlight FROM grouped2""",
        "n8_breath_groups": f"{PAGE_CHUNKS}, {UNIT_PAUSES}, {SPOKEN} SELECT doc_id, chunk_idx, unit, CAST(breath_group AS INTEGER) AS breath_group, CAST(least(row_number() OVER (PARTITION BY doc_id, breath_group ORDER BY chunk_idx, unit) - 1, 3) AS INTEGER) AS queued_behind FROM utterances",
        "t6_token_index": f"SELECT conv_id, turn, spot AS \"at\", CASE WHEN spot <= 0 THEN 0 ELSE greatest(0, {n_words('left(text, spot + 1)')} - 1) END AS token FROM conversations, (VALUES (-1), (0), (2), (30), (9999)) AS p(spot)",
        "t7_seconds": f"SELECT doc_id, round({n_words('text')} / (165 * 1.25) * 60, 6) AS seconds FROM documents",
        "n1_units": f"{DOC_CHUNKS}, {UNITS} SELECT doc_id, chunk_idx, unit, text, CAST(token_start AS INTEGER) AS token_start, token_count, ends_sentence FROM units",
        "n2_structural_pauses": f"{PAGE_CHUNKS}, {PAUSES} SELECT doc_id, idx, pause_ms FROM structural",
        "n3_unit_pauses": f"{DOC_CHUNKS}, {UNIT_PAUSES} SELECT doc_id, chunk_idx, unit, pause_ms FROM unit_pauses",
        "n4_rates": f"{PAGE_CHUNKS} SELECT doc_id, idx, CASE WHEN heading THEN round(1.25 * 0.94, 6) ELSE 1.25 END::DOUBLE AS rate FROM chunks",
        "n5_successors": f"{DOC_CHUNKS}, {UNIT_PAUSES} SELECT doc_id, chunk_idx, unit, next_chunk, next_unit FROM unit_pauses",
        "n7_begin": f"""{PAGE_CHUNKS}, {UNITS}, asks AS (SELECT doc_id, idx AS chunk_idx, token FROM chunks, (VALUES (0), (5), (20), (500)) AS p(token)),
met AS (SELECT a.*, u.unit, u.token_start, u.text, row_number() OVER (PARTITION BY a.doc_id, a.chunk_idx, a.token ORDER BY CASE WHEN a.token < u.token_start + u.token_count THEN u.unit ELSE 1000000 - u.unit END) AS k, a.token < u.token_start + u.token_count AS hit FROM asks a JOIN units u USING (doc_id, chunk_idx))
SELECT doc_id, chunk_idx, token, unit, CASE WHEN hit THEN CAST(token - token_start AS INTEGER) ELSE 0 END AS dropped, array_to_string(list_slice({words('text')}, CASE WHEN hit THEN CAST(token - token_start AS INTEGER) ELSE 0 END + 1, 100000), ' ') AS rest FROM met WHERE k = 1""",
        "n10_timeline": f"{DOC_CHUNKS}, {TIMES} SELECT doc_id, chunk_idx, words, round(before / 165.0 * 60, 6) AS start_s, round(words / 165.0 * 60, 6) AS duration_s FROM times",
        "n11_chunk_at": f"{DOC_CHUNKS}, {TIMES}, probes AS (SELECT DISTINCT doc_id, s::DOUBLE AS seconds FROM times, (VALUES (-5), (0), (30), (100), (100000)) AS p(s)) SELECT doc_id, seconds, max(chunk_idx) AS chunk_idx FROM probes JOIN times USING (doc_id) WHERE before / 165.0 * 60 <= greatest(seconds, 0) GROUP BY doc_id, seconds",
        "n12_elapsed": f"{DOC_CHUNKS}, {TIMES} SELECT doc_id, chunk_idx, CAST(chunk_idx % 11 AS INTEGER) AS token, round(before / (165 * 1.5) * 60 + CASE WHEN words > 0 THEN least(chunk_idx % 11, words) / words ELSE 0 END * (words / (165 * 1.5) * 60), 6) AS elapsed_s, round(sum(words) OVER (PARTITION BY doc_id) / (165 * 1.5) * 60, 6) AS duration_s FROM times",
        "n13_seek": f"{DOC_CHUNKS} SELECT doc_id, target, least(greatest(target, 0), last) AS chunk_idx, least(greatest(target / 2.0, 0.5), 3.0)::DOUBLE AS rate FROM (SELECT doc_id, max(idx) AS last FROM chunks GROUP BY doc_id), (VALUES (-3), (2), (9999)) AS p(target)",
        "n14_status": "SELECT event_id, CASE WHEN event_id & 1 = 0 THEN CASE WHEN event_id & 4 > 0 THEN 'ended' ELSE 'idle' END WHEN event_id & 2 > 0 THEN 'paused' ELSE 'playing' END AS status FROM events",
        "n9_player_states": f"WITH {PLAYER}",
        "q1_transcript": f"{DOC_CHUNKS} SELECT doc_id, idx FROM chunks WHERE idx BETWEEN 30 AND 269",
        "q2_blocks": f"{PAGE_CHUNKS}, f AS (SELECT doc_id, idx, CASE WHEN heading OR starts_para OR coalesce(lag(heading) OVER w, true) OR lag(para) OVER w <> para THEN 1 ELSE 0 END AS n FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) SELECT doc_id, idx, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS block FROM f",
        "q3_active_chapter": f"{PAGE_CHUNKS}, {CHAPTERS}, {ACTIVE} SELECT a.doc_id, a.chunk_idx, a.seq, h.title FROM active a JOIN chapters h USING (doc_id, seq)",
        "q4_chapter_step": f"{PAGE_CHUNKS}, {CHAPTERS}, {ACTIVE}, goal AS (SELECT a.doc_id, a.chunk_idx AS from_chunk, least(a.seq + 1, (SELECT max(seq) FROM chapters h WHERE h.doc_id = a.doc_id)) AS seq FROM active a) SELECT g.doc_id, g.seq, from_chunk, title, chunk_idx FROM goal g JOIN chapters h ON h.doc_id = g.doc_id AND h.seq = g.seq",
        "q5_bookmarks": f"WITH {EV} SELECT book_id, event_id AS id, chunk_idx, token_idx, row_number() OVER (PARTITION BY book_id ORDER BY chunk_idx, token_idx, event_id) AS place FROM ev WHERE event_type = 'click'",
        "q6_bookmark_here": f"WITH {EV}, here AS (SELECT DISTINCT book_id, chunk_idx, token_idx FROM ev WHERE event_type = 'view') SELECT h.book_id, h.chunk_idx, h.token_idx, arg_min(b.event_id, (b.token_idx, b.event_id)) AS bookmark_id FROM here h JOIN ev b ON b.event_type = 'click' AND b.book_id = h.book_id AND b.chunk_idx = h.chunk_idx AND abs(b.token_idx - h.token_idx) <= 8 GROUP BY ALL",
        "q7_excerpts": f"{DOC_CHUNKS}, {EV} SELECT event_id AS id, CASE WHEN len(w) > token_idx THEN array_to_string(list_slice(w, token_idx + 1, token_idx + 9), ' ') ELSE left(text, 60) END AS excerpt FROM (SELECT event_id, token_idx, text, {words('text')} AS w FROM ev JOIN chunks ON doc_id = book_id AND idx = chunk_idx WHERE event_type = 'click')",
        "q8_preview": rf"SELECT conv_id, turn, CASE WHEN length(t) < 40 THEN {lit(T.PREVIEW_STOCK)} WHEN length(t) > 220 THEN regexp_replace(left(t, 220), '\s\S*$', '') || '…' ELSE t END AS sample FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)",
        "b1_shelf": f"{DOC_CHUNKS}, {SHELF} SELECT * FROM shelf",
        "b2_reading": f"{DOC_CHUNKS}, {SHELF} SELECT book_id, fraction FROM shelf WHERE started = 1 AND finished = 0",
        "b3_search": f"WITH {BOOKS} SELECT book_id, title FROM books WHERE contains(lower(title || ' ' || coalesce(author, '')), 'en book 1')",
        "b4_sorted": f"{DOC_CHUNKS}, {SHELF} SELECT book_id, row_number() OVER (ORDER BY remaining_s, book_id) AS place FROM shelf",
        "b5_time_left": f"{DOC_CHUNKS}, {SHELF}, m AS (SELECT book_id, greatest(1, CAST(floor(remaining_s / 60 + 0.5) AS BIGINT)) AS m FROM shelf), p AS (SELECT book_id, m // 60 AS h, m % 60 AS r FROM m) SELECT book_id, CASE WHEN h = 0 THEN '' ELSE h || CASE WHEN h = 1 THEN ' hr' ELSE ' hrs' END END || CASE WHEN h > 0 AND r > 0 THEN ' ' ELSE '' END || CASE WHEN r > 0 OR h = 0 THEN r || CASE WHEN r = 1 THEN ' min' ELSE ' mins' END ELSE '' END || ' left' AS \"left\" FROM p",
        "b6_clock": CLOCK,
        "b7_rate_label": "SELECT doc_id, regexp_replace(printf('%.2f', (doc_id % 300) / 100.0), '\\.?0+$', '') AS rate FROM documents",
        "b8_books": f"WITH {BOOKS} SELECT book_id, row_number() OVER (ORDER BY added_at DESC, book_id) AS place FROM books",
        "b10_percent": f"{DOC_CHUNKS} SELECT doc_id, idx, CASE WHEN p > 0 THEN p END AS percent FROM (SELECT doc_id, idx, CAST(floor(idx * 100 / count(*) OVER (PARTITION BY doc_id)) AS INTEGER) AS p FROM chunks)",
        "v1_tiers": f"WITH {TIER} SELECT id, tier, rank, base FROM tiers",
        "v3_usable": f"WITH {TIER} SELECT id FROM usable",
        "v4_best": f"WITH {TIER} SELECT id, score FROM best ORDER BY score DESC, name, pos LIMIT 4",
        "v5_search": f"WITH {VOICES} SELECT id FROM voices WHERE contains(lower(name), 'en-') OR contains(lower(lang), 'en-')",
        "v6_ordered": f"WITH {VOICES} {ordered_voices('voices')}",
        "v7_shortlist": f"WITH {VOICES} SELECT id, list_position({listed(STARRED)}, id) - 1 AS place FROM voices WHERE list_contains({listed(STARRED)}, id)",
        "v8_toggle": "SELECT c_custkey, voice, array_to_string(CASE WHEN list_contains(f, voice) THEN list_filter(f, lambda x: x <> voice) WHEN len(f) >= 6 THEN f ELSE f || [voice] END, ',') AS after FROM (SELECT c_custkey, 'v' || (c_custkey + c_custkey % 9) AS voice, list_transform(range(c_custkey, c_custkey + c_custkey % 7), lambda k: 'v' || k) AS f FROM customer)",
        "v9_resolve": f"WITH {VOICES}, asks AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 3 > 0 THEN 'v' || (c_custkey % 150) END AS b, CASE WHEN c_custkey % 4 > 0 THEN 'v' || (c_custkey * 7 % 150) END AS d FROM customer), auto AS (SELECT id AS a FROM voices ORDER BY CASE WHEN lower(lang) LIKE 'en%' AND is_default THEN 0 WHEN lower(lang) LIKE 'en%' THEN 1 ELSE 2 END, pos LIMIT 1) SELECT n, CASE WHEN b IN (SELECT id FROM voices) THEN b WHEN d IN (SELECT id FROM voices) THEN d ELSE a END AS voice_id, CASE WHEN b IN (SELECT id FROM voices) THEN 'book' WHEN d IN (SELECT id FROM voices) THEN 'default' ELSE 'auto' END AS source FROM asks, auto",
        "v10_preferred": f"WITH {VOICES} SELECT id AS voice_id FROM voices ORDER BY CASE WHEN lower(lang) LIKE 'en%' AND is_default THEN 0 WHEN lower(lang) LIKE 'en%' THEN 1 ELSE 2 END, pos LIMIT 1",
        "v11_picker": f"WITH {TIER} {ordered_voices('(SELECT * FROM best ORDER BY score DESC, name, pos LIMIT 10)')}",
        "k2_cascade": f"""WITH {EV}, {LATEST}, left_books AS (SELECT doc_id FROM documents WHERE doc_id % 10 <> 3)
SELECT 'books' AS kind, CAST(doc_id AS VARCHAR) AS key FROM left_books UNION ALL SELECT 'files', CAST(doc_id AS VARCHAR) FROM left_books
UNION ALL SELECT 'progress', CAST(book_id AS VARCHAR) FROM latest WHERE book_id % 10 <> 3 UNION ALL SELECT 'bookmarks', CAST(event_id AS VARCHAR) FROM ev WHERE event_type = 'click' AND book_id % 10 <> 3
UNION ALL SELECT 'audio', doc_id || ':0:0:default' || s FROM left_books, (VALUES (''), ('-2')) AS t(s) UNION ALL SELECT 'voices', 'voice:' || doc_id FROM documents""",
        "k7_synthesis": f"{PAGE_CHUNKS}, {UNIT_PAUSES}, {SPOKEN} SELECT cache_key || ':default' AS key, CASE WHEN unit % 2 = 0 THEN 'cached' WHEN length(speech) % 7 = 3 THEN 'failed' ELSE 'made' END AS first, CASE WHEN unit % 2 = 1 AND length(speech) % 7 = 3 THEN 'ValueError: refused' END AS error, CASE WHEN unit % 2 = 1 AND length(speech) % 7 = 3 THEN 'made' ELSE 'cached' END AS second, CAST(strlen(CASE WHEN unit % 2 = 0 THEN 'old:' ELSE 'default:' END || speech) AS INTEGER) AS bytes FROM utterances",
        "k3_progress": PROGRESS,
        "k4_delete_bookmark": f"WITH {EV} SELECT event_id AS id, book_id FROM ev WHERE event_type = 'click' AND event_id % 4 <> 0",
        "k5_settings": "WITH base AS (SELECT c_custkey, c_custkey % 3 AS kind, CAST(c_custkey % 5 / 2.0 AS VARCHAR) AS rate, c_mktsegment FROM customer) SELECT c_custkey, 'rate' AS key, CASE WHEN kind < 2 THEN rate ELSE '1' END AS value FROM base UNION ALL SELECT c_custkey, 'provider', 'system' FROM base UNION ALL SELECT c_custkey, 'theme', c_mktsegment FROM base WHERE kind = 1",
        "k6_book_voices": "SELECT CAST(c_custkey AS VARCHAR) AS book_id, 'v' || c_custkey AS voice_id, c_custkey AS updated_at FROM customer WHERE c_custkey % 5 = 4",
        "k8_evict": "SELECT doc_id || ':0:0:default' AS key FROM documents WHERE doc_id <> 1",
        "k9_audio_bytes": "SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents",
        "k11_lookup": f"WITH {BOOKS} SELECT book_id, title, author FROM books WHERE book_id = 7",
        "x1_progress_stream": PROGRESS,
        "x2_beats": f"{PAGE_CHUNKS}, {UNIT_PAUSES} SELECT doc_id, chunk_idx, unit, pause_ms FROM unit_pauses",
        "x2_player_stream": f"WITH {PLAYER}",
        "x4_drop_stale": "SELECT book_id, seq, session FROM (SELECT *, max(session) OVER (PARTITION BY book_id ORDER BY seq) AS m FROM (SELECT user_id % 20 AS book_id, event_id AS seq, CAST(floor(value) AS INTEGER) AS session FROM events)) WHERE session = m",
    }
    return found | {
        "t8_text_offsets": f"WITH {TOKENS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM tokens WHERE kind = 'text'",
        "s5_outline": OUTLINE,
        "n15_rates": "SELECT doc_id, round(least(greatest(s, 0.5), 4), 6)::DOUBLE AS web, round(CASE WHEN s <= 1 THEN greatest(s, 0.5) / 2 ELSE 0.5 + (least(s, 3) - 1) / 4 END, 6)::DOUBLE AS system FROM (SELECT doc_id, (doc_id % 500) / 100.0 AS s FROM documents)",
        "q9_details": f"SELECT s.doc_id, c.n AS chunks, p.n AS pages, margin_lines, footnote_lines, column_pages FROM ({found['l13_stats']}) s JOIN (SELECT doc_id, count(*) AS n FROM ({found['c4_chunks']}) GROUP BY ALL) c USING (doc_id) JOIN (SELECT doc_id, count(DISTINCT page) AS n FROM ({found['l7_reading_order']}) GROUP BY ALL) p USING (doc_id)",
        "k1_save_books": f"WITH {BOOKS} SELECT book_id, CASE WHEN book_id % 3 = 0 THEN title || ' (2)' ELSE title END AS title, author, added_at FROM books",
    }
