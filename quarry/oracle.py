"""DuckDB SQL for every registered query (the correctness oracle).

The corpus views and dictionaries are the same definitions as in
``quarry.sources.corpus`` and ``quarry.catalog``, written as SQL over the
pre-registered tables.  Overlapping counts use the replace form for
keywords without a border and a per-position scan for bordered ones; word
borders use RE2 groups in place of look-arounds; the fold is
``replace(lower(x), 'ß', 'ss')``, equal to ``casefold`` on the test tables.
"""

from __future__ import annotations

from quarry.catalog import DICT, PROPS_DICT
from quarry.functions.text import is_word_char
from quarry.sources import files as S
from quarry.sources.dictionary import KeywordDictionary

GIB = 1024 ** 3


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def bordered(w: str) -> bool:
    return any(w[:i] == w[-i:] for i in range(1, len(w)))


FOLD = "replace(lower({x}), 'ß', 'ss')"

# ---------------------------------------------------------------- views
DOCS = """docs AS (
  SELECT doc_id, p AS source_path, '' AS internal_path, p AS display_path, lower(ext) AS file_type,
         CAST(strlen(text) AS BIGINT) AS size,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS mtime, text
  FROM (SELECT *, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || ext AS p
        FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' WHEN 2 THEN '.MD'
                                         WHEN 3 THEN '' ELSE '.bin' END AS ext FROM documents)))"""

PAGES = """pg AS (
  SELECT page_id, 'pages/' || CAST(page_id AS VARCHAR) || '.html' AS source_path, '' AS internal_path,
         'pages/' || CAST(page_id AS VARCHAR) || '.html' AS display_path, '.html' AS file_type,
         CAST(strlen(html) AS BIGINT) AS size, html AS text
  FROM pages)"""

CONVS = """convs AS (
  SELECT conv_id, 'conversations/' || CAST(conv_id AS VARCHAR) AS source_path,
         'turn_' || CAST(turn AS VARCHAR) AS internal_path,
         'conversations/' || CAST(conv_id AS VARCHAR) || '::turn_' || CAST(turn AS VARCHAR) AS display_path,
         '' AS file_type, CAST(strlen(text) AS BIGINT) AS size, turn AS unit_idx, text
  FROM conversations)"""

PROPS = """props AS (
  SELECT 'events/' || CAST(event_id AS VARCHAR) || '.json' AS source_path, '' AS internal_path,
         'events/' || CAST(event_id AS VARCHAR) || '.json' AS display_path, '.json' AS file_type,
         CAST(strlen(props) AS BIGINT) AS size, props AS text
  FROM events)"""


def _norm_values(d: KeywordDictionary, case_sensitive: bool = False) -> str:
    rows = []
    for e in d.normalised(case_sensitive):
        for g in e.groups:
            rows.append(f"({lit(e.norm)}, {lit(e.display)}, {lit(g)}, {str(bordered(e.norm)).upper()})")
    return "dn AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(norm, keyword, keyword_group, bordered))"


def _boundary_pattern(low: str) -> str:
    w = r"[\p{L}\p{N}_]"
    nw = r"(^|[^\p{L}\p{N}_])"
    nw_r = r"($|[^\p{L}\p{N}_])"
    left = nw if is_word_char(low[0]) else w
    right = nw_r if is_word_char(low[-1]) else w
    return left + r"\Q" + low + r"\E" + right


def _boundary_values(d: KeywordDictionary) -> str:
    rows = [f"({lit(g)}, {lit(kw)}, {lit(low)}, {lit(_boundary_pattern(low))})" for g, kw, low in d.boundary_entries()]
    return "bd AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(keyword_group, keyword, low, pat))"


def dict_facts(view: str, keys: str, d: KeywordDictionary = DICT, case_sensitive: bool = False,
               name: str = "f") -> str:
    """CTE ``name`` of dictionary-mode facts (keys..., keyword_group, keyword, count) over ``view``."""
    ft = "text" if case_sensitive else FOLD.format(x="text")
    cnt = ("CASE WHEN dn.bordered THEN len(list_filter(range(1, length(u.ft) + 1), "
           "lambda i: substr(u.ft, i, length(dn.norm)) = dn.norm)) "
           "ELSE (length(u.ft) - length(replace(u.ft, dn.norm, ''))) // length(dn.norm) END")
    key_sel = ", ".join(f"u.{k.strip()}" for k in keys.split(","))
    return (f"{name} AS (SELECT {key_sel}, dn.keyword_group, dn.keyword, CAST({cnt} AS BIGINT) AS count "
            f"FROM (SELECT *, {ft} AS ft FROM {view}) u JOIN dn ON contains(u.ft, dn.norm))")


def boundary_facts(view: str, keys: str, name: str = "f") -> str:
    """One branch per keyword so that each RE2 pattern is a constant (compiled once)."""
    key_sel = ", ".join(f"u.{k.strip()}" for k in keys.split(","))
    parts = [f"SELECT {key_sel}, {lit(g)} AS keyword_group, {lit(kw)} AS keyword, CAST(1 AS BIGINT) AS count "
             f"FROM (SELECT *, lower(text) AS lt FROM {view}) u "
             f"WHERE contains(u.lt, {lit(low)}) AND regexp_matches(u.lt, {lit(_boundary_pattern(low))})"
             for g, kw, low in DICT.boundary_entries()]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


META = "source_path, internal_path, display_path, file_type, size"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


DOCS_DICT = with_(DOCS, _norm_values(DICT), dict_facts("docs", META))
DOCS_BND = with_(DOCS, _boundary_values(DICT), boundary_facts("docs", META))


def _suffix(col: str) -> str:
    return f"lower(regexp_extract({col}, '[^/](\\.[^./]+)$', 1))"


def _textual(text: str) -> str:
    """Sniff over the first 4096 UTF-8 bytes, as hex byte pairs."""
    hx = f"regexp_extract_all(left(hex(encode({text})), 8192), '..')"
    return (f"(len({hx}) > 0 AND NOT list_contains({hx}, '00') AND "
            f"len(list_filter({hx}, lambda x: x < '09' OR (x >= '0E' AND x < '20'))) < len({hx}) * 0.05)")


def _format_class(ft: str, path: str) -> str:
    arch = f"({ft} IN {_in_list(S.ARCHIVE_EXTENSIONS)} OR " + " OR ".join(
        f"ends_with(lower({path}), {lit(e)})" for e in S.ARCHIVE_NAME_ENDINGS) + ")"
    return (f"CASE WHEN {arch} THEN 'archive' WHEN {ft} IN {_in_list(S.TEXT_EXTENSIONS)} THEN 'text' "
            f"WHEN {ft} IN {_in_list(S.OOXML_EXTENSIONS)} THEN 'ooxml' WHEN {ft} = '.pdf' THEN 'pdf' "
            f"WHEN {ft} = '.xls' THEN 'xls' WHEN {ft} IN {_in_list(S.ODF_EXTENSIONS)} THEN 'odf' "
            f"WHEN {ft} = '.eml' THEN 'eml' WHEN {ft} = '.msg' THEN 'msg' ELSE 'sniff' END")


def _strip_html(x: str) -> str:
    s = (f"regexp_replace(regexp_replace({x}, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>', ' ', 'g'), "
         f"'(?s)<[^>]+>', ' ', 'g')")
    # entity decoding for the entities that occur in the test pages; &amp; last
    for ent, ch in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"),
                    ("&#39;", "'"), ("&amp;", "&")):
        s = f"replace({s}, {lit(ent)}, {lit(ch)})"
    return s


def _sanitize_path(p: str) -> str:
    part = ("left(coalesce(nullif(trim(regexp_replace(x, '[^A-Za-z0-9._@+=,()\\[\\]{} -]+', '_', 'g'), ' .'), ''), "
            "'unnamed'), 180)")
    return (f"array_to_string(list_transform(list_filter(string_split(replace({p}, '\\', '/'), '/'), "
            f"lambda x: x <> ''), lambda x: {part}), '/')")


BENCH_DICT = """bw AS (
  SELECT 'bench' || CAST(item_id % 3 AS VARCHAR) AS keyword_group, keyword,
         item_id, CAST(i AS BIGINT) AS i, item_id * CAST(1000000000 AS BIGINT) + i AS pos, replace(lower(keyword), 'ß', 'ss') AS norm
  FROM (SELECT item_id, unnest(arr) AS keyword, generate_subscripts(arr, 1) - 1 AS i
        FROM (SELECT item_id, regexp_extract_all(text, '\\p{L}{6,}') AS arr FROM benchmark))),
bdict AS (SELECT keyword_group, keyword, item_id, i, pos, norm, arg_min(keyword, pos) OVER (PARTITION BY norm) AS display FROM bw)"""

SNAPS = """ev AS (SELECT user_id, ts FROM events),
mid AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS m FROM ev),
old AS (SELECT 'users/' || CAST(user_id AS VARCHAR) || '.log' AS path, epoch_us(max(ts)) AS mtime_us,
               CAST(count(*) AS BIGINT) AS size
        FROM ev WHERE epoch_us(ts) < (SELECT m FROM mid) GROUP BY user_id),
new AS (SELECT 'users/' || CAST(user_id AS VARCHAR) || '.log' AS path,
               CASE WHEN user_id % 7 = 0 THEN epoch_us(min(ts)) ELSE epoch_us(max(ts)) END AS mtime_us,
               CAST(CASE WHEN user_id % 35 = 0 THEN count(*) FILTER (WHERE epoch_us(ts) < (SELECT m FROM mid))
                         ELSE count(*) END AS BIGINT) AS size
        FROM ev WHERE user_id % 11 <> 0 GROUP BY user_id),
changed AS (SELECT * FROM new ANTI JOIN old USING (path, mtime_us, size))"""


def _file_maps(facts: str, key: str) -> str:
    return f"""pg2 AS (SELECT {key}, keyword_group, list_sort(list(keyword)) AS kws FROM {facts} GROUP BY ALL),
gm AS (SELECT {key}, array_to_string(list_transform(list_sort(list({{'g': keyword_group, 'k': kws}})),
              lambda x: x.g || ':' || array_to_string(x.k, ',')), ';') AS groups FROM pg2 GROUP BY ALL),
km AS (SELECT {key}, array_to_string(list_transform(list_sort(list(DISTINCT {{'k': keyword, 'v': count}})),
              lambda x: x.k || '=' || CAST(x.v AS VARCHAR)), ';') AS keyword_counts,
              CAST(sum(c) AS BIGINT) AS hits
       FROM (SELECT {key}, keyword, count, CASE WHEN row_number() OVER (PARTITION BY {key}, keyword) = 1
                                            THEN count ELSE 0 END AS c FROM {facts}) GROUP BY ALL)"""


def _sql() -> dict[str, str]:
    q: dict[str, str] = {}
    # ---------------------------------------------------------- sources
    q["file_inventory"] = with_(DOCS) + "SELECT source_path AS path, size, CAST(epoch(mtime) AS BIGINT) AS mtime_s FROM docs"
    q["exclude_subtree"] = with_(DOCS) + ("SELECT source_path FROM docs "
                                          "WHERE NOT (starts_with(source_path, 'src1/') OR source_path = 'src1')")
    q["file_type_of"] = with_(DOCS) + f"SELECT source_path, {_suffix('source_path')} AS file_type FROM docs"
    q["ext_filter"] = with_(DOCS) + (f"SELECT source_path FROM docs WHERE {_suffix('source_path')} = '' "
                                     f"OR {_suffix('source_path')} IN {_in_list(S.V1_EXTENSIONS)}")
    q["format_class_counts"] = with_(DOCS, PAGES, PROPS) + (
        f"SELECT {_format_class('file_type', 'source_path')} AS format_class, count(*) AS files FROM "
        "(SELECT source_path, file_type FROM docs UNION ALL SELECT source_path, file_type FROM pg "
        "UNION ALL SELECT source_path, file_type FROM props) GROUP BY 1")
    q["textual_sniff"] = with_(DOCS) + f"SELECT source_path, {_textual('text')} AS textual FROM docs"
    q["utf8_text_units"] = with_(DOCS) + (
        f"SELECT source_path, CAST(CASE WHEN {_format_class('file_type', 'source_path')} = 'text' THEN strlen(text) "
        f"WHEN {_format_class('file_type', 'source_path')} = 'sniff' AND {_textual('text')} THEN strlen(text) "
        "ELSE 0 END AS INTEGER) AS bytes FROM docs")
    q["dictionary_table"] = with_(BENCH_DICT) + "SELECT keyword_group, keyword, item_id, i AS pos, norm, display FROM bdict"
    q["dictionary_norm"] = with_(BENCH_DICT) + (
        "SELECT norm, array_to_string(list_sort(list_distinct(list(keyword_group))), ';') AS groups, "
        "arg_min(keyword, pos) AS display FROM bdict GROUP BY norm")
    q["html_strip"] = f"SELECT page_id, {_strip_html('html')} AS text FROM pages"
    q["html_strip_simple"] = "SELECT page_id, regexp_replace(html, '<[^<]+?>', '', 'g') AS text FROM pages"
    q["unsafe_member_filter"] = (
        "SELECT member, (NOT starts_with(replace(member, '\\', '/'), '/') AND "
        "NOT list_contains(string_split(replace(member, '\\', '/'), '/'), '..')) AS safe FROM "
        "(SELECT unnest([source || '/' || CAST(doc_id AS VARCHAR) || '.txt', '/etc/' || CAST(doc_id AS VARCHAR), "
        "source || '/../' || CAST(doc_id AS VARCHAR), source || '\\..\\' || CAST(doc_id AS VARCHAR)]) AS member "
        "FROM documents)")
    q["archive_dedup"] = with_(DOCS, CONVS) + (
        "SELECT DISTINCT source_path, internal_path FROM (SELECT source_path, internal_path FROM docs "
        "UNION ALL SELECT source_path, internal_path FROM convs UNION ALL SELECT source_path, internal_path FROM convs)")
    q["scan_props_text"] = with_(PROPS, _norm_values(PROPS_DICT), dict_facts("props", "display_path")) + \
        "SELECT display_path, keyword_group, keyword, count FROM f"
    # ---------------------------------------------------------- matching
    q["match_boundary"] = DOCS_BND + "SELECT display_path, keyword_group, keyword, count FROM f"
    q["match_dictionary"] = DOCS_DICT + "SELECT display_path, keyword_group, keyword, count FROM f"
    q["match_case_sensitive"] = with_(DOCS, _norm_values(DICT, True), dict_facts("docs", META, case_sensitive=True)) + \
        "SELECT display_path, keyword_group, keyword, count FROM f"
    q["match_pages"] = with_(PAGES, _norm_values(DICT), dict_facts("pg", META)) + \
        "SELECT display_path, keyword_group, keyword, count FROM f"
    q["match_unit_scope"] = with_(CONVS, _norm_values(DICT), dict_facts("convs", "source_path, unit_idx")) + \
        "SELECT source_path, keyword_group, keyword, CAST(sum(count) AS BIGINT) AS count FROM f GROUP BY ALL"
    q["match_file_scope"] = with_(
        CONVS, "whole AS (SELECT source_path, string_agg(text, '' ORDER BY unit_idx) AS text FROM convs GROUP BY 1)",
        _norm_values(DICT), dict_facts("whole", "source_path")) + \
        "SELECT source_path, keyword_group, keyword, count FROM f"
    q["match_file_scope_boundary"] = with_(
        CONVS, "whole AS (SELECT source_path, string_agg(text, '' ORDER BY unit_idx) AS text FROM convs GROUP BY 1)",
        boundary_facts("whole", "source_path")) + \
        "SELECT source_path, keyword_group, keyword, count FROM f"
    q["file_match_maps"] = with_(DOCS, _norm_values(DICT), dict_facts("docs", META),
                                 _file_maps("f", "display_path")) + \
        "SELECT display_path, hits, groups, keyword_counts FROM gm JOIN km USING (display_path)"
    q["files_with_flag"] = DOCS_DICT + (
        "SELECT d.display_path, d.file_type, d.size, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits, "
        "coalesce(h.hits, 0) > 0 AS matched FROM docs d LEFT JOIN "
        "(SELECT display_path, sum(count) AS hits FROM f GROUP BY 1) h USING (display_path)")
    q["files_unmatched"] = DOCS_DICT + (
        "SELECT display_path, file_type, size FROM docs WHERE display_path NOT IN (SELECT display_path FROM f)")
    q["bytes_read"] = with_(CONVS) + \
        "SELECT source_path, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes_read FROM convs GROUP BY 1"
    q["container_rollup"] = with_(CONVS, _norm_values(DICT), dict_facts("convs", "source_path, internal_path")) + (
        "SELECT source_path, internal_path, keyword_group, keyword, count, CAST(1 AS BIGINT) AS members_hit, "
        "false AS is_rollup FROM f UNION ALL "
        "SELECT source_path, '' AS internal_path, keyword_group, keyword, CAST(sum(count) AS BIGINT) AS count, "
        "CAST(count(DISTINCT internal_path) AS BIGINT) AS members_hit, true AS is_rollup FROM f GROUP BY 1, 3, 4")
    # ---------------------------------------------------------- containers
    arch = """members AS (
  SELECT CASE WHEN bucket % 2 = 0 THEN 'archives/' || CAST(bucket AS VARCHAR) || '.zip'
              ELSE 'archives/' || CAST(bucket AS VARCHAR) || '.tar.gz' END AS source_path,
         CASE WHEN bucket % 2 = 0 AND pos >= n // 2 THEN 'inner/nested.zip/' ELSE '' END
           || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS internal_path, text
  FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS pos,
               count(*) OVER (PARTITION BY bucket) AS n
        FROM (SELECT *, CAST(floor(doc_id / 8) AS BIGINT) AS bucket FROM documents))),
mu AS (SELECT source_path, internal_path, source_path || '::' || internal_path AS display_path, text FROM members)"""
    q["archive_facts"] = with_(arch, _norm_values(DICT), dict_facts("mu", "display_path")) + \
        "SELECT display_path, keyword_group, keyword, count FROM f"
    q["archive_members"] = with_(arch) + (
        "SELECT source_path, internal_path, CAST(CASE WHEN internal_path LIKE 'inner/%' THEN 2 ELSE 1 END AS INTEGER) AS depth, "
        "CAST(strlen(text) AS BIGINT) AS size FROM members UNION ALL "
        "SELECT DISTINCT source_path, 'inner/nested.zip', 1, NULL FROM members WHERE source_path LIKE '%.zip'")
    q["archive_files"] = with_(arch, _norm_values(DICT), dict_facts("mu", "display_path")) + (
        "SELECT display_path, '.txt' AS file_type, CAST(strlen(text) AS BIGINT) AS size, CAST(strlen(text) AS BIGINT) AS bytes_read, "
        "display_path IN (SELECT display_path FROM f) AS matched, '' AS error FROM mu UNION ALL "
        "SELECT DISTINCT 'archives/' || CAST(floor(doc_id / 8) AS BIGINT) || '.zip::../escape.txt', '.txt', NULL, 0, false, "
        "'unsafe member path' FROM documents WHERE CAST(floor(doc_id / 8) AS BIGINT) % 4 = 0")
    bad = """grp AS (SELECT DISTINCT CAST(floor(doc_id / 8) AS BIGINT) AS bucket FROM documents),
errs AS (
  SELECT 'archives/' || CAST(bucket AS VARCHAR) || '.zip' AS source_path, '' AS internal_path,
         'ValueError: unsupported archive format: .zip' AS error
  FROM grp WHERE bucket % 2 = 0 AND bucket % 9 = 5
  UNION ALL
  SELECT 'archives/' || CAST(bucket AS VARCHAR) || '.zip', '../escape.txt', 'unsafe member path'
  FROM grp WHERE bucket % 2 = 0 AND bucket % 4 = 0 AND bucket % 9 <> 5)"""
    q["scan_errors"] = with_(bad) + "SELECT source_path, internal_path, error FROM errs"
    invalid = "'[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{FFFE}\\x{FFFF}]'"
    py_space = "'[^\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]'"
    q["odf_units"] = (
        "WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, "
        "generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents "
        f"WHERE NOT regexp_matches(text, {invalid})) "
        "SELECT 'office/' || source || '/' || CAST(doc_id AS VARCHAR) || '.odt' AS source_path, '' AS internal_path, "
        "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS unit_idx, "
        "'paragraph' AS unit_kind, 'content.xml' AS part_name, CAST(length(line) + 1 AS INTEGER) AS chars "
        "FROM l WHERE line <> ''")
    q["ooxml_units"] = (
        "WITH d AS (SELECT doc_id, source, text FROM documents "
        f"WHERE NOT regexp_matches(text, {invalid})), "
        "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d), "
        f"dx AS (SELECT doc_id, sum(length(line) + 1) AS chars FROM l WHERE regexp_matches(line, {py_space}) GROUP BY 1), "
        "u AS (SELECT doc_id, 'word/document.xml' AS part_name, chars, 0 AS ord FROM dx UNION ALL "
        "SELECT doc_id, 'word/_rels/document.xml.rels', length('https://example.org/' || CAST(doc_id AS VARCHAR)) + 1, 1 "
        "FROM d) "
        "SELECT 'office/' || source || '/' || CAST(doc_id AS VARCHAR) || '.docx' AS source_path, '' AS internal_path, "
        "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS unit_idx, "
        "'ooxml_part' AS unit_kind, part_name, CAST(chars AS INTEGER) AS chars FROM u JOIN d USING (doc_id) "
        "UNION ALL SELECT 'office/' || source || '/' || CAST(doc_id AS VARCHAR) || '.docx', 'word/embeddings/note.txt', "
        "0, 'text', '', CAST(length(text) AS INTEGER) FROM documents WHERE text <> ''")
    q["xml_units"] = (
        "WITH d AS (SELECT doc_id, source, text FROM documents "
        f"WHERE NOT regexp_matches(text, {invalid})), "
        "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) "
        "SELECT 'xml/' || source || '/' || CAST(doc_id AS VARCHAR) || '.xml' AS source_path, "
        "CAST(length(source) + 1 + coalesce((SELECT sum(length(line) + 1) FROM l "
        f"WHERE l.doc_id = d.doc_id AND regexp_matches(line, {py_space})), 0) AS INTEGER) AS chars FROM d")
    q["eml_units"] = (
        "WITH d AS (SELECT doc_id, source, text, "
        "ltrim(substring(split_part(text, chr(10), 1), 1, 60), ' ' || chr(9)) AS subj FROM documents), "
        "u AS (SELECT doc_id, 'header' AS kind, 'from' AS part, length('from: ' || source || '@example.org') + 1 AS chars, "
        "0 AS ord FROM d UNION ALL SELECT doc_id, 'header', 'to', length('to: archive@example.org') + 1, 1 FROM d "
        "UNION ALL SELECT doc_id, 'header', 'subject', length('subject: ' || subj) + 1, 2 FROM d WHERE subj <> '' "
        "UNION ALL SELECT doc_id, 'plain', 'text/plain', length(text) + 1, 3 FROM d "
        "UNION ALL SELECT doc_id, 'html', 'text/html', length(text) + 7, 4 FROM d) "
        "SELECT 'mail/' || source || '/' || CAST(doc_id AS VARCHAR) || '.eml' AS source_path, '' AS internal_path, "
        "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS unit_idx, kind AS unit_kind, "
        "part AS part_name, CAST(chars AS INTEGER) AS chars FROM u JOIN d USING (doc_id) "
        "UNION ALL SELECT 'mail/' || source || '/' || CAST(doc_id AS VARCHAR) || '.eml', "
        "CAST(doc_id AS VARCHAR) || '.txt', 0, 'text', '', CAST(length(text) AS INTEGER) FROM documents WHERE text <> ''")
    cunits = f"""cd AS (SELECT doc_id, source, text, CAST(doc_id AS VARCHAR) AS i,
    NOT regexp_matches(text, {invalid}) AS xml_ok,
    ltrim(substring(split_part(text, chr(10), 1), 1, 60), ' ' || chr(9)) AS subj FROM documents),
cl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
       generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM cd WHERE xml_ok),
cu AS (
  SELECT 'office/' || source || '/' || i || '.docx' AS display_path,
         (SELECT string_agg(line || chr(10), '' ORDER BY pos) FROM cl
          WHERE cl.doc_id = cd.doc_id AND regexp_matches(line, {py_space})) AS text FROM cd WHERE xml_ok
  UNION ALL SELECT 'office/' || source || '/' || i || '.docx', 'https://example.org/' || i || chr(10) FROM cd WHERE xml_ok
  UNION ALL SELECT 'office/' || source || '/' || i || '.docx::word/embeddings/note.txt', text FROM cd
  UNION ALL SELECT 'office/' || cd.source || '/' || cd.i || '.odt', line || chr(10) FROM cl JOIN cd USING (doc_id)
  UNION ALL SELECT 'mail/' || source || '/' || i || '.eml', 'from: ' || source || '@example.org' || chr(10) FROM cd
  UNION ALL SELECT 'mail/' || source || '/' || i || '.eml', 'to: archive@example.org' || chr(10) FROM cd
  UNION ALL SELECT 'mail/' || source || '/' || i || '.eml', 'subject: ' || subj || chr(10) FROM cd WHERE subj <> ''
  UNION ALL SELECT 'mail/' || source || '/' || i || '.eml', text || chr(10) FROM cd
  UNION ALL SELECT 'mail/' || source || '/' || i || '.eml', '   ' || text || '   ' || chr(10) FROM cd
  UNION ALL SELECT 'mail/' || source || '/' || i || '.eml::' || i || '.txt', text FROM cd
  UNION ALL SELECT 'gz/' || source || '/' || i || '.txt.gz::' || i || '.txt', text FROM cd)"""
    q["container_facts"] = with_(cunits, _norm_values(DICT), dict_facts("cu", "display_path")) + (
        "SELECT display_path, keyword_group, keyword, CAST(sum(count) AS BIGINT) AS count FROM f GROUP BY ALL")
    q["archive_rollup"] = with_(arch, _norm_values(DICT), dict_facts("mu", "source_path, internal_path")) + (
        "SELECT source_path, internal_path, keyword_group, keyword, count, CAST(1 AS BIGINT) AS members_hit, "
        "false AS is_rollup FROM f UNION ALL "
        "SELECT source_path, '' AS internal_path, keyword_group, keyword, CAST(sum(count) AS BIGINT) AS count, "
        "CAST(count(DISTINCT internal_path) AS BIGINT) AS members_hit, true AS is_rollup FROM f GROUP BY 1, 3, 4")
    # ---------------------------------------------------------- reports
    q["files_per_group"] = DOCS_BND + "SELECT keyword_group, count(DISTINCT display_path) AS files FROM f GROUP BY 1"
    q["files_per_keyword"] = DOCS_BND + \
        "SELECT keyword_group, keyword, count(DISTINCT display_path) AS files FROM f GROUP BY 1, 2"
    q["keyword_totals"] = DOCS_DICT + ("SELECT keyword, CAST(sum(c) AS BIGINT) AS hits FROM "
                                       "(SELECT display_path, keyword, max(count) AS c FROM f GROUP BY 1, 2) GROUP BY 1")
    q["keyword_totals_by_group_row"] = DOCS_DICT + "SELECT keyword, CAST(sum(count) AS BIGINT) AS hits FROM f GROUP BY 1"
    q["filetype_counts"] = with_(DOCS) + "SELECT file_type, count(*) AS files FROM docs WHERE length(text) > 0 GROUP BY 1"
    q["files_multi_group"] = DOCS_BND + (
        "SELECT count(*) AS files_multi_group FROM "
        "(SELECT display_path FROM f GROUP BY 1 HAVING count(DISTINCT keyword_group) > 1)")
    q["keyword_file_index"] = DOCS_BND + "SELECT DISTINCT keyword, display_path AS path FROM f"
    q["matched_size_gb"] = DOCS_BND + (
        f"SELECT round(coalesce(sum(size), 0) / {GIB}, 4) AS matched_size_gb FROM "
        "(SELECT display_path, max(size) AS size FROM f GROUP BY 1)")
    gms = ("gms AS (SELECT keyword_group, count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, "
           f"round(coalesce(sum(size), 0) / {GIB}, 4) AS size_gb FROM "
           "(SELECT keyword_group, display_path, max(size) AS size FROM f GROUP BY 1, 2) GROUP BY 1)")
    q["group_matched_size"] = with_(DOCS, _boundary_values(DICT), boundary_facts("docs", META), gms) + \
        "SELECT keyword_group, files, bytes, size_gb FROM gms"
    q["group_report"] = with_(DOCS, _boundary_values(DICT), boundary_facts("docs", META), gms) + (
        "SELECT k.keyword_group, g.files AS group_files, g.size_gb AS group_size_gb, k.keyword, k.keyword_files, i.path "
        "FROM (SELECT keyword_group, keyword, count(DISTINCT display_path) AS keyword_files FROM f GROUP BY 1, 2) k "
        "JOIN gms g USING (keyword_group) "
        "JOIN (SELECT DISTINCT keyword, display_path AS path FROM f) i USING (keyword)")
    def obj(key, val, src, extra=""):
        return (f"(SELECT '{{' || string_agg('\"' || {key} || '\":' || {val}, ',' ORDER BY {key}) || '}}' "
                f"FROM {src}{extra})")
    q["global_statistics"] = DOCS_BND + (
        "SELECT " + obj("keyword_group", "CAST(n AS VARCHAR)",
                        "(SELECT keyword_group, count(DISTINCT display_path) AS n FROM f GROUP BY 1)") + " AS Keyword_Groups, "
        + obj("keyword_group", "m", "(SELECT keyword_group, " + obj("keyword", "CAST(n AS VARCHAR)",
              "(SELECT keyword, count(DISTINCT display_path) AS n FROM f f2 WHERE f2.keyword_group = g.keyword_group "
              "GROUP BY 1)") + " AS m FROM (SELECT DISTINCT keyword_group FROM f) g)") + " AS Keywords, "
        + obj("file_type", "CAST(n AS VARCHAR)",
              "(SELECT file_type, count(*) AS n FROM docs WHERE length(text) > 0 GROUP BY 1)") + " AS FileTypes, "
        "(SELECT count(*) FROM (SELECT display_path FROM f GROUP BY 1 HAVING count(DISTINCT keyword_group) > 1)) "
        "AS Files_With_Multiple_Keywords, "
        f"(SELECT round(coalesce(sum(size), 0) / {GIB}, 4) FROM (SELECT display_path, max(size) AS size FROM f GROUP BY 1)) "
        "AS Global_Matched_Files_Size_GB")
    q["run_totals"] = DOCS_DICT + (
        "SELECT count(*) AS scanned, CAST(count(*) FILTER (WHERE display_path IN (SELECT display_path FROM f)) AS BIGINT) "
        "AS matched, CAST(0 AS BIGINT) AS failed, CAST(sum(strlen(text)) AS BIGINT) AS bytes_read, "
        f"round(sum(strlen(text)) / {GIB}, 4) AS read_gb FROM docs")
    q["matched_files"] = DOCS_DICT + (
        "SELECT display_path, '' AS copied_to, array_to_string(list_sort(list(DISTINCT keyword_group)), ';') AS groups, "
        "array_to_string(list_sort(list(DISTINCT keyword)), ';') AS keywords FROM f GROUP BY 1")
    q["run_summary"] = DOCS_DICT + (
        "SELECT CAST(1 AS BIGINT) AS run_id, "
        "'{\"scanned\":' || CAST(count(*) AS VARCHAR) || ',\"matched\":' || "
        "CAST(count(*) FILTER (WHERE display_path IN (SELECT display_path FROM f)) AS VARCHAR) || "
        "',\"failed\":0,\"bytes_read\":' || CAST(sum(strlen(text)) AS VARCHAR) || "
        f"',\"read_gb\":' || CAST(round(sum(strlen(text)) / {GIB}, 4) AS VARCHAR) || '}}' AS files, "
        "(SELECT '{' || string_agg('\"' || keyword_group || '\":' || CAST(n AS VARCHAR), ',' ORDER BY keyword_group) "
        "|| '}' FROM (SELECT keyword_group, count(DISTINCT display_path) AS n FROM f GROUP BY 1)) AS groups, "
        "(SELECT '{' || string_agg('\"' || keyword || '\":' || CAST(n AS VARCHAR), ',' ORDER BY keyword) "
        "|| '}' FROM (SELECT keyword, sum(count) AS n FROM f GROUP BY 1)) AS keywords FROM docs")
    q["scan_metrics"] = DOCS_DICT + (
        "SELECT count(*) AS seen, count(*) AS scanned, "
        "count(*) FILTER (WHERE display_path IN (SELECT display_path FROM f)) AS matched, CAST(0 AS BIGINT) AS failed, "
        "CAST(sum(strlen(text)) AS BIGINT) AS bytes_read, "
        "(SELECT CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT display_path, keyword, max(count) AS c FROM f GROUP BY 1, 2)) "
        "AS matches FROM docs")
    q["run_filter"] = with_(PAGES, _norm_values(DICT), dict_facts("pg", META)) + (
        "SELECT CAST(2 AS BIGINT) AS run_id, display_path, CAST(strlen(text) AS BIGINT) AS bytes_read, "
        "display_path IN (SELECT display_path FROM f) AS matched FROM pg")
    # ---------------------------------------------------------- sinks
    q["manifest_jsonl"] = with_(DOCS, _norm_values(DICT), dict_facts("docs", META), _file_maps("f", "display_path")) + (
        "SELECT d.display_path, d.source_path, d.internal_path, d.file_type, d.size, '' AS copied_to, "
        "gm.groups, km.keyword_counts FROM docs d JOIN gm USING (display_path) JOIN km USING (display_path)")
    q["manifest_csv"] = DOCS_DICT + (
        "SELECT display_path, source_path, internal_path, file_type, size, "
        "array_to_string(list_sort(list(DISTINCT keyword_group)), ';') AS groups, "
        "array_to_string(list_sort(list(DISTINCT keyword)), ';') AS keywords, '' AS copied_to FROM f GROUP BY ALL")
    q["files_upsert"] = with_(DOCS, _boundary_values(DICT), boundary_facts("docs", META, name="fb"),
                              _norm_values(DICT), dict_facts("docs", META, name="fd")) + (
        "SELECT display_path, CASE WHEN file_type = '.txt' THEN display_path IN (SELECT display_path FROM fd) "
        "ELSE display_path IN (SELECT display_path FROM fb) END AS matched, "
        "CAST(strlen(text) AS BIGINT) AS bytes_read, CASE WHEN file_type = '.txt' THEN 2 ELSE 1 END AS seq FROM docs")
    q["file_keys"] = with_(DOCS) + \
        "SELECT display_path, sha256(concat_ws(chr(0), '1', source_path, internal_path)) AS file_key FROM docs"
    q["group_copy_plan"] = with_(CONVS, _boundary_values(DICT), boundary_facts("convs", "display_path, internal_path"),
                                 """h AS (SELECT *, ('0x' || substr(md5(display_path), 1, 6))::BIGINT AS h FROM f),
r AS (SELECT DISTINCT keyword_group, display_path AS path, CASE WHEN h % 3 = 0 THEN 't.txt'
      WHEN h % 3 = 1 THEN 't_' || (h % 5) || '.txt' ELSE internal_path END AS name FROM h),
top AS (SELECT keyword_group, regexp_extract(name, '^(.*)_\\d{1,9}(\\.[^./]+)?$', 1) AS stem,
               regexp_extract(name, '_\\d{1,9}(\\.[^./]+)?$', 1) AS ext,
               max(CAST(regexp_extract(name, '_(\\d{1,9})(\\.[^./]+)?$', 1) AS BIGINT)) AS top
        FROM r WHERE regexp_matches(name, '_\\d{1,9}(\\.[^./]+)?$') GROUP BY ALL),
b AS (SELECT *, ('0x' || substr(md5(path), 1, 6))::BIGINT % 16 AS b FROM r),
rk AS (SELECT *, row_number() OVER (PARTITION BY keyword_group, name, b ORDER BY path) - 1 AS rr FROM b),
cn AS (SELECT keyword_group, name, b, count(*) AS n FROM b GROUP BY ALL),
off AS (SELECT keyword_group, name, b, coalesce(sum(n) OVER (PARTITION BY keyword_group, name ORDER BY b
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM cn),
k AS (SELECT rk.*, off.o + rk.rr AS k, regexp_extract(rk.name, '[^/](\\.[^./]+)$', 1) AS ext
      FROM rk JOIN off USING (keyword_group, name, b))""") + (
        "SELECT k.keyword_group, path, k.keyword_group || '/' || CASE WHEN k = 0 THEN name "
        "ELSE left(name, length(name) - length(k.ext)) || '_' || CAST(k + coalesce(top.top, 0) AS VARCHAR) || k.ext END AS dest "
        "FROM k LEFT JOIN top ON top.keyword_group = k.keyword_group AND top.ext = k.ext "
        "AND top.stem = left(name, length(name) - length(k.ext))")
    q["evidence_plan"] = with_(DOCS, CONVS, _norm_values(DICT), dict_facts("docs", META, name="fd"),
                               dict_facts("convs", META, name="fc")) + (
        f"SELECT display_path, 'evidence/' || {_sanitize_path('source_path')} AS dest FROM docs "
        "WHERE display_path IN (SELECT display_path FROM fd) UNION ALL "
        f"SELECT display_path, 'evidence/' || {_sanitize_path('source_path')} || '/container_' || "
        f"left(sha256(display_path), 12) || {_suffix('internal_path')} AS dest FROM convs "
        "WHERE display_path IN (SELECT display_path FROM fc)")
    # ---------------------------------------------------------- streaming
    q["stream_scan"] = q["match_dictionary"]
    q["stream_group_totals"] = DOCS_DICT + \
        "SELECT keyword_group, count(DISTINCT display_path) AS files FROM f GROUP BY 1"
    # ---------------------------------------------------------- incremental
    q["changed_files"] = with_(SNAPS) + "SELECT path, mtime_us, size FROM changed"
    # all that changed was read, and nothing else is left: the state is the new listing
    q["next_scan_state"] = with_(SNAPS) + "SELECT path, mtime_us, size FROM new"
    user = "CAST(regexp_extract(path, '(\\d+)', 1) AS BIGINT)"
    steps = [f"""SELECT CAST({i} AS BIGINT) AS listing, path AS rel_path, CASE WHEN path IN (SELECT path FROM {a}) THEN 'changed' ELSE 'new' END AS change, size, mtime_us
                 FROM (SELECT * FROM {b} ANTI JOIN {a} USING (path, mtime_us, size))
                 UNION ALL SELECT CAST({i} AS BIGINT), path, 'gone', size, mtime_us FROM {a} ANTI JOIN {b} USING (path)"""
             for i, (a, b) in enumerate([("none", "old"), ("old", "new"), ("new", "third")], 1)]
    q["listing_changes"] = with_(SNAPS, f"""none AS (SELECT * FROM old LIMIT 0),
third AS (SELECT path, mtime_us, size + CASE WHEN {user} % 9 = 0 THEN 1 ELSE 0 END AS size
          FROM (SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (path) WHERE {user} % 2 = 0) WHERE {user} % 13 <> 0)""") + " UNION ALL ".join(steps)
    q["range_scan"] = DOCS_DICT + "SELECT keyword_group, keyword, CAST(sum(count) AS BIGINT) AS hits FROM f GROUP BY 1, 2"
    nested = """nest AS (SELECT coalesce(source, 'none') || '.zip' AS source_path, coalesce(lang, 'none') || '.zip' AS inside,
       coalesce(lang, 'none') || '.zip/box/' || CAST(doc_id % 10 AS VARCHAR) || '.zip' AS deep, doc_id, text FROM documents)"""
    q["nested_rollup"] = with_(nested, _norm_values(DICT), dict_facts("nest", "source_path, inside, deep, doc_id")) + " UNION ALL ".join(
        f"SELECT source_path, {path} AS internal_path, keyword_group, keyword, CAST(sum(count) AS BIGINT) AS count, "
        "count(DISTINCT doc_id) AS members_hit FROM f GROUP BY 1, 2, 3, 4" for path in ("''", "inside", "deep"))
    asked = ", ".join(lit(kw) for g, kw in DICT.entries if g == DICT.entries[0][0])
    q["index_lookup"] = DOCS_BND + f"SELECT DISTINCT keyword, display_path AS path FROM f WHERE keyword IN ({asked})"
    # a form that begins as it ends may overlap itself: its places are looked at one by one, in the texts that hold it
    q["match_keyword_table"] = with_(DOCS, BENCH_DICT, f"""kw AS (SELECT DISTINCT norm, keyword_group, display AS keyword FROM bdict WHERE length(keyword) >= 8),
forms AS (SELECT *, len(list_filter(range(1, length(norm)), lambda k: left(norm, k) = right(norm, k))) > 0 AS bordered
          FROM (SELECT DISTINCT norm FROM kw)),
hits AS (SELECT display_path, norm, CASE WHEN bordered THEN len(list_filter(range(1, length(ft) + 1), lambda i: substr(ft, i, length(norm)) = norm))
                                        ELSE (length(ft) - length(replace(ft, norm, ''))) // length(norm) END AS n
         FROM (SELECT display_path, {FOLD.format(x="text")} AS ft FROM docs) JOIN forms ON contains(ft, norm))""") + (
        "SELECT display_path, keyword_group, keyword, CAST(n AS BIGINT) AS count FROM hits JOIN kw USING (norm)")
    # the text that a document's last run saw
    seen = """seen AS (SELECT * REPLACE (CAST(strlen(text) AS BIGINT) AS size) FROM (SELECT * REPLACE (
  CASE WHEN doc_id % 7 = 0 THEN left(text, length(text) // 2) WHEN doc_id % 5 = 0 THEN text
       WHEN doc_id % 3 = 0 THEN left(text, length(text) // 2) ELSE text END AS text) FROM docs WHERE doc_id % 11 <> 0))"""
    each = "(SELECT DISTINCT {keys}, display_path, size FROM f)"
    figure = ("SELECT '{what}' AS what, {g} AS keyword_group, {k} AS keyword, {t} AS file_type, count(*) AS files, {bytes} AS bytes, "
              "{multi} AS multi FROM {rows} GROUP BY ALL")
    null, none = "CAST(NULL AS VARCHAR)", "CAST(NULL AS BIGINT)"
    q["merged_statistics"] = with_(DOCS, seen, _boundary_values(DICT), boundary_facts("seen", META)) + " UNION ALL ".join([
        figure.format(what="group", g="keyword_group", k=null, t=null, bytes="CAST(sum(size) AS BIGINT)", multi=none, rows=each.format(keys="keyword_group")),
        figure.format(what="group_keyword", g="keyword_group", k="keyword", t=null, bytes=none, multi=none, rows=each.format(keys="keyword_group, keyword")),
        figure.format(what="keyword", g=null, k="keyword", t=null, bytes=none, multi=none, rows=each.format(keys="keyword")),
        figure.format(what="run", g=null, k=null, t=null, bytes="CAST(sum(size) AS BIGINT)", multi="CAST(sum(m) AS BIGINT)",
                      rows="(SELECT display_path, any_value(size) AS size, CASE WHEN count(DISTINCT keyword_group) > 1 THEN 1 ELSE 0 END AS m FROM f GROUP BY 1)"),
        figure.format(what="file_type", g=null, k=null, t="file_type", bytes=none, multi=none, rows="(SELECT * FROM seen WHERE strlen(text) > 0)")])
    return q


ORACLE_SQL: dict[str, str] = _sql()
