"""All registered queries of the document operators, and the SQL that each is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioworks.functions import arrays, routing, strings, timecode
from folioworks.operators import alignment, captions, chunking, epub, languages, layout, layout_blocks, readable, repetition, scoring, sentences, transcripts
from folioworks.plans.sql import QUERIES, SQL, S, query, sql_normalized, sql_strip, sql_words, table

CHUNK_BUDGET = 2000
#: Pause after which an event opens a new paragraph or session, in seconds.
EVENT_GAP = 3600.0

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_rows(table(spark, sf_dir, "documents"), CHUNK_BUDGET).select("doc_id", "title", "chunk_no", "chunk_len")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Routing ---------------------------------------------------------------------------------------------------------


@query(r"""
SELECT page_id, regexp_matches(url, '^(?i:https?)://[^/?#]+') AS is_url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)', 1) AS path FROM pages""")
def url_parts(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", routing.is_url(F.col("url")).alias("is_url"), routing.url_parts(F.col("url")).alias("u")).select("page_id", "is_url", "u.*")


@query("""
SELECT page_id, CASE WHEN contains(lower(url), 'youtube.com') OR contains(lower(url), 'youtu.be') THEN 'youtube' WHEN contains(lower(url), 'bilibili.com') THEN 'bilibili'
  WHEN contains(lower(url), 'xiaohongshu.com') OR contains(lower(url), 'xhslink.com') THEN 'xiaohongshu' WHEN contains(lower(url), 'xiaoyuzhoufm.com') THEN 'xiaoyuzhoufm' ELSE 'unknown' END AS platform,
  'url' AS source_kind, 'transcript' AS task_type FROM pages""")
def route_platform(spark, d):
    r = routing.route(F.col("url"), F.lit(None).cast("string"), F.lit(False))
    return table(spark, d, "pages").select("page_id", routing.platform(F.col("url")).alias("platform"), r["source_kind"].alias("source_kind"), r["task_type"].alias("task_type"))


@query("""
SELECT page_id, 'file://' || replace(replace(replace(replace(url_encode('/data/' || url), '%2F', '/'), '+', '%20'), '%7E', '~'), '*', '%2A') AS uri FROM pages""")
def file_uris(spark, d):
    return table(spark, d, "pages").select("page_id", routing.file_uri(F.concat(F.lit("/data/"), F.col("url"))).alias("uri"))


@query(rf"""
WITH a AS (SELECT doc_id, regexp_replace({sql_strip("translate(text, '<>:\"/\\|?*', '_________')")}, '[{S}]+', '_', 'g') AS c FROM documents),
b AS (SELECT doc_id, regexp_replace(substr(regexp_replace(c, '^[._]+|[._]+$', '', 'g'), 1, 100), '[._]+$', '') AS c FROM a)
SELECT doc_id, coalesce(nullif(c, ''), 'output') || '_transcript.md' AS name FROM b""")
def file_names(spark, d):
    return table(spark, d, "documents").select("doc_id", strings.file_name(F.col("text"), "transcript", "md").alias("name"))


PATHS = ["a/b.PDF", "talk.mp3", "film.MKV", "scan.tiff", "notes.md", ".bashrc", "x.", "book.epub", "sheet.xlsx", "odd.xyz", "dir.v2/readme", "page.HTML"]


@query("""
WITH p(path, ext, kind, reader) AS (VALUES ('a/b.PDF', '.pdf', 'document_file', NULL), ('talk.mp3', '.mp3', 'audio_file', NULL), ('film.MKV', '.mkv', 'video_file', NULL), ('scan.tiff', '.tiff', 'image_file', NULL),
  ('notes.md', '.md', 'document_file', 'markdown'), ('.bashrc', '', NULL, NULL), ('x.', '', NULL, NULL), ('book.epub', '.epub', 'document_file', 'epub'), ('sheet.xlsx', '.xlsx', 'document_file', NULL),
  ('odd.xyz', '.xyz', NULL, NULL), ('dir.v2/readme', '', NULL, NULL), ('page.HTML', '.html', 'document_file', 'html'))
SELECT path, ext, kind, reader FROM p""")
def ext_reader_join(spark, d):
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string").withColumn("ext", routing.suffix(F.col("path")))
    return paths.join(F.broadcast(routing.extension_table(spark)), "ext", "left").select("path", "ext", "kind", "reader")


# Text ------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({sql_normalized('text')}) AS digest, CAST(length({sql_normalized('text')}) AS INTEGER) AS n FROM documents")
def normalize_text(spark, d):
    c = strings.normalized(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(c.cast("binary")).alias("digest"), F.length(c).alias("n"))


SQL_TITLE = rf"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split({sql_strip('text')}, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ls FROM documents),
f AS (SELECT doc_id, coalesce(
    nullif(list_filter(ls, lambda x: starts_with(x, '# '))[1][3:], ''),
    list_filter(list_transform(range(1, len(ls)), lambda i: CASE WHEN regexp_matches(ls[i + 1], '^(=+|-+)$') THEN ls[i] END), lambda x: x IS NOT NULL)[1],
    list_filter(ls[1:5], lambda x: NOT regexp_matches(x, '^([#!\[<{{]|:::|---|(?i:http))'))[1]) AS t FROM l),
c AS (SELECT doc_id, regexp_replace({sql_strip(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^#+[{S}]*', ''), '\*+([^*]+)\*+', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\{{[^}}]*\}}|\([^)]*\)|#\w+', '', 'g'), '^[\"'']+|[\"'']+$', '', 'g'), '[{S}]+', ' ', 'g')")}, '[。，、；：！？]+$', '') AS t FROM f)
SELECT doc_id, coalesce(nullif(t, ''), 'untitled') AS title FROM c"""


@query(SQL_TITLE)
def title_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", strings.title(F.col("text"), F.lit("untitled")).alias("title"))


@query(rf"""
WITH n AS (SELECT doc_id, {sql_normalized("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT doc_id, t, {sql_strip('t')} AS s FROM n),
c AS (SELECT doc_id, CASE WHEN t = '' THEN [] WHEN length(t) <= {CHUNK_BUDGET} THEN [t]
  ELSE list_filter(list_transform(range(0, CAST(floor((length(s) - 1) / {CHUNK_BUDGET}) AS BIGINT) + 1), lambda i: {sql_strip(f'substr(s, i * {CHUNK_BUDGET} + 1, {CHUNK_BUDGET})')}), lambda x: x <> '') END AS cs FROM p),
k AS (SELECT doc_id, unnest(cs) AS chunk, generate_subscripts(cs, 1) - 1 AS chunk_no FROM c)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(length(chunk) AS INTEGER) AS chunk_len, md5(chunk) AS digest FROM k""")
def chunk_text(spark, d):
    rows = chunking.chunk_rows(table(spark, d, "documents"), CHUNK_BUDGET)
    return rows.select("doc_id", "chunk_no", "chunk_len", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query(rf"""
WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([{sentences.ENDS}][{sentences.CLOSERS.replace("'", "''")}。！？!?….]*|\.[{sentences.CLOSERS.replace("'", "''")}][{sentences.CLOSERS.replace("'", "''")}。！？!?….]*)', '\1' || chr(1), 'g'), '\.([{S}])', '.' || chr(1) || '\1', 'g') AS t FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ss FROM m)
SELECT doc_id, CAST(len(ss) AS INTEGER) AS n_sentences, md5(array_to_string(ss, chr(10))) AS digest FROM s""")
def sentence_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", sentences.sentences(F.col("text")).alias("ss"))
    return rows.select("doc_id", F.size("ss").alias("n_sentences"), F.md5(F.array_join("ss", "\n").cast("binary")).alias("digest"))


@query(rf"""
WITH s AS (SELECT doc_id, substr({sql_strip('text')}, 1, 4000) AS t FROM documents),
c AS (SELECT doc_id, length(regexp_replace(t, '[^\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}]', '', 'g')) AS cjk, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS latin FROM s)
SELECT doc_id, CASE WHEN cjk >= 2 OR (cjk = 1 AND latin < 20) THEN 'zh' WHEN latin >= 3 THEN 'en' END AS script_lang FROM c""")
def lang_script(spark, d):
    return table(spark, d, "documents").select("doc_id", languages.script_language(F.col("text")).alias("script_lang"))


def sql_same(items: str, n: int) -> str:
    """A 1 for each visible item that is the same as the one n places on, else 0."""
    return f"array_to_string(list_transform(list_zip({items}, {items}[{n + 1}:]), lambda p: CASE WHEN p[1] = p[2] AND p[1] <> ' ' THEN '1' ELSE '0' END), '')"


@query(rf"""
WITH c AS (SELECT doc_id, regexp_replace({sql_strip("coalesce(text, '')")}, '[{S}]+', ' ', 'g') AS c FROM documents),
w AS (SELECT doc_id, string_split(c, '') AS cs, string_split(c, ' ') AS ws FROM c)
SELECT doc_id, contains({sql_same('cs', 1)}, repeat('1', 7)) OR {' OR '.join(f"contains({sql_same('cs', n)}, repeat('1', {3 * n}))" for n in range(2, 11))}
  OR (len(ws) >= 5 AND (contains({sql_same('ws', 1)}, repeat('1', 5)) OR {' OR '.join(f"contains({sql_same('ws', n)}, repeat('1', {3 * n}))" for n in range(2, 6))})) AS has_loop FROM w""")
def repetition_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", repetition.has_loop(F.col("text")).alias("has_loop"))


@query(rf"SELECT page_id, md5(regexp_replace(html, '<[^>]*(>|$)', ' ', 'g')) AS digest, CAST(len({sql_words(rf'''regexp_replace(lower(regexp_replace(html, '<[^>]*(>|$)', ' ', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')''')}) AS INTEGER) AS n_words FROM pages")
def html_words(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(strings.without_markup(F.col("html")).cast("binary")).alias("digest"), F.size(strings.scoring_words(F.col("html"))).alias("n_words"))


@query(rf"SELECT lang, count(*) AS n_tokens, count(DISTINCT w) AS n_distinct FROM (SELECT lang, unnest({sql_words(rf'''regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')''')}) AS w FROM documents) GROUP BY lang")
def token_counts(spark, d):
    rows = table(spark, d, "documents").select("lang", F.explode(strings.words(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))).alias("w"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("w").alias("n_distinct"))


@query("SELECT page_id, sha256(html) AS sha, base64(encode(url)) AS url64, CAST(octet_length(encode(html)) AS INTEGER) AS n_bytes FROM pages")
def page_digests(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha"), strings.base64(F.encode("url", "UTF-8")).alias("url64"), F.octet_length("html").alias("n_bytes"))


# Times and captions ----------------------------------------------------------------------------------------------

CUES = "SELECT conv_id, turn, role, trim(replace(text, chr(10), ' ')) AS text, turn * 3.0 AS s, turn * 3.0 + 2.5 AS e FROM conversations"


def sql_time(x: str, mark: str) -> str:
    ms = f"CAST(round({x} * 1000) AS BIGINT)"
    return f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def _cues(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", "role", F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"), (F.col("turn") * 3.0).alias("s"), (F.col("turn") * 3.0 + 2.5).alias("e"))


@query(f"""
SELECT conv_id, string_agg(n || chr(10) || {sql_time('s', ',')} || ' --> ' || {sql_time('e', ',')} || chr(10) || {sql_strip('text')} || chr(10), chr(10) ORDER BY s, e, text) AS srt
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s, e, text) AS n FROM ({CUES})) GROUP BY conv_id""")
def subtitle_srt(spark, d):
    return captions.rendered(_cues(spark, d), "conv_id", "s", "e", "text", "srt")


@query(f"""
SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({sql_time('s', '.')} || ' --> ' || {sql_time('e', '.')} || chr(10) || {sql_strip('text')} || chr(10), chr(10) ORDER BY s, e, text) AS vtt
FROM ({CUES}) GROUP BY conv_id""")
def subtitle_vtt(spark, d):
    return captions.rendered(_cues(spark, d), "conv_id", "s", "e", "text", "vtt")


@query(f"""SELECT conv_id, CAST(count(*) AS INTEGER) AS n_cues, min(s) AS first_start, max(e) AS last_end FROM ({CUES}) GROUP BY conv_id""")
def srt_round_trip(spark, d):
    back = captions.rendered(_cues(spark, d), "conv_id", "s", "e", "text", "srt").select("conv_id", captions.read_cues(F.col("srt")).alias("cues"))
    return back.select("conv_id", F.size("cues").alias("n_cues"), F.array_min(F.transform("cues", lambda c: c["start"])).alias("first_start"), F.array_max(F.transform("cues", lambda c: c["end"])).alias("last_end"))


#: Cues of which each but the first of a conversation opens with the last words of the one before.
ROLLING = f"""
SELECT conv_id, turn, list_concat(coalesce(lag(ws[greatest(len(ws) - 2, 1):]) OVER (PARTITION BY conv_id ORDER BY turn), []), ws) AS ws
FROM (SELECT conv_id, turn, {sql_words('text')} AS ws FROM ({CUES}))"""

SQL_LINES = rf"""
n AS (SELECT conv_id, tokens, list_transform(range(1, len(tokens) + 1), lambda i: {{'t': tokens[i], 'b': regexp_replace(tokens[i], '^(>>|<<)', ''), 'n': tokens[i + 1]}}) AS ps FROM tokens),
l AS (SELECT conv_id, array_to_string(list_transform(ps, lambda p: CASE WHEN regexp_matches(p.t, '^(>>|<<)') THEN chr(10) || '>> ' || p.b ELSE p.t END ||
  CASE WHEN regexp_matches(p.b, '[.!?。！？…]["''”’)\]]*$') AND NOT list_contains({list(captions.ABBREVIATIONS)}, lower(p.b)) AND NOT regexp_matches(p.b, '^\p{{L}}\.$')
    AND (p.n IS NULL OR regexp_matches(p.n, '^(>>|<<)') OR regexp_matches(p.n, '^["''“‘(\[]?[A-Z\x{{3400}}-\x{{9fff}}]')) THEN chr(10) ELSE ' ' END), '') AS t FROM n)
SELECT conv_id, {sql_strip(r"regexp_replace(regexp_replace(t, ' *\n+ *', chr(10), 'g'), '>> +\n', '>> ', 'g')")} AS transcript FROM l"""


@query(f"""
WITH RECURSIVE c AS (SELECT conv_id, list(ws ORDER BY turn) AS cues FROM ({ROLLING}) GROUP BY conv_id),
r AS (SELECT conv_id, cues, 0 AS i, CAST([] AS VARCHAR[]) AS tokens FROM c UNION ALL
  SELECT conv_id, cues, i + 1, list_concat(tokens, cues[i + 1][1 + coalesce(list_max(list_filter(range(1, least(len(tokens), len(cues[i + 1])) + 1), lambda k: tokens[len(tokens) - k + 1:] = cues[i + 1][1:k])), 0):])
  FROM r WHERE i < len(cues)),
tokens AS (SELECT conv_id, tokens FROM r WHERE i = len(cues)),
{SQL_LINES}""")
def rolling_merge(spark, d):
    """Captions that each repeat the last words of the one before, merged and set as one sentence per line."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    cues = _cues(spark, d).withColumn("ws", strings.words(F.col("text")))
    tail = F.slice("ws", F.greatest(F.size("ws") - 2, F.lit(1)), F.least(F.size("ws"), F.lit(3)))
    cues = cues.withColumn("text", F.array_join(F.concat(F.coalesce(F.lag(tail).over(order), F.array().cast("array<string>")), "ws"), " "))
    turns = cues.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    return turns.select("conv_id", captions.linear_transcript(captions.merged_rolling(F.transform("ts", lambda x: x["text"]))).alias("transcript"))


SQL_CUT = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, '' AS path, {sql_strip('text')} AS t, CAST(s AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e FROM ({CUES}) UNION ALL
  SELECT conv_id, turn, path || side, CASE side WHEN 'a' THEN l ELSE r END, CASE side WHEN 'a' THEN s ELSE m END, CASE side WHEN 'a' THEN m ELSE e END
  FROM (SELECT *, s + (e - s) * length(l) / (length(l) + length(r)) AS m FROM (SELECT *, {sql_strip('substr(t, 1, cut)')} AS l, {sql_strip('substr(t, cut + 1)')} AS r FROM ({{place}})) WHERE cut > 0 AND l <> '' AND r <> ''), (VALUES ('a'), ('b')) x(side)),
f AS (SELECT * FROM (SELECT *, {sql_strip('substr(t, 1, cut)')} AS l, {sql_strip('substr(t, cut + 1)')} AS r FROM ({{place}})) WHERE t <> '' AND NOT (cut > 0 AND l <> '' AND r <> ''))
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY path) - 1 AS INTEGER) AS cue_no, round(s, 6) AS start, round(greatest(e, s + {captions.LEAST_CUE}), 6) AS "end", t AS text FROM f"""
#: Where a cue is cut: after the break, else the blank, that is nearest its middle; in mostly wide texts else at the middle.
SQL_PLACE = rf"""
SELECT *, CASE WHEN n > CASE WHEN mostly THEN {captions.LINE_CHARS_CJK} ELSE {captions.LINE_CHARS} END OR e - s > {captions.LONGEST_CUE}
  THEN coalesce(list_sort(list_transform(list_filter(range(1, n - 1), lambda i: contains('{captions.BREAKS}', substr(t, i + 1, 1))), lambda i: {{'d': abs(i - n // 2), 'i': i}}))[1].i + 1,
    list_sort(list_transform(list_filter(range(1, n - 1), lambda i: substr(t, i + 1, 1) = ' '), lambda i: {{'d': abs(i - n // 2), 'i': i}}))[1].i + 1, CASE WHEN mostly THEN n // 2 ELSE 0 END) ELSE 0 END AS cut
FROM (SELECT *, length(t) AS n, 2 * length(regexp_replace(t, '[^{strings.CJK}]', '', 'g')) > length(regexp_replace(t, '[{S}]', '', 'g')) AS mostly FROM c)"""


@query(SQL_CUT.replace("{place}", SQL_PLACE))
def cue_split(spark, d):
    cues = _cues(spark, d).select("conv_id", "turn", F.posexplode(captions.split_cues("text", "s", "e")).alias("cue_no", "c"))
    return cues.select("conv_id", "turn", "cue_no", F.round("c.start", 6).alias("start"), F.round("c.end", 6).alias("end"), "c.text")


@query("SELECT event_id, printf('%02d:%02d:%02d', CAST(floor(abs(value)) AS BIGINT) // 3600, CAST(floor(abs(value)) AS BIGINT) // 60 % 60, CAST(floor(abs(value)) AS BIGINT) % 60) AS clock FROM events")
def clocks(spark, d):
    return table(spark, d, "events").select("event_id", timecode.clock(F.abs("value")).alias("clock"))


# Windows over ordered rows ---------------------------------------------------------------------------------------

EVENTS = "SELECT event_id, user_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 1.0 AS e, value FROM events"


def _events(spark, d):
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select("event_id", "user_id", s.alias("s"), (s + 1.0).alias("e"), "value", "ts")


@query(f"""
WITH f AS (SELECT *, CASE WHEN s - lag(e) OVER w >= {EVENT_GAP} THEN 1 ELSE 0 END AS new FROM ({EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY s, e)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(s) AS first_start, max(e) AS last_end FROM i GROUP BY user_id, island""")
def gap_paragraphs(spark, d):
    rows = sentences.gap_islands(_events(spark, d), "user_id", "s", "e", EVENT_GAP)
    return rows.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first_start"), F.max("e").alias("last_end"))


@query(f"""
WITH f AS (SELECT *, CASE WHEN s - lag(s) OVER w >= {EVENT_GAP} THEN 1 ELSE 0 END AS new FROM ({EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY s)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, min(s) AS first_start, count(*) AS n FROM i GROUP BY user_id, island""")
def session_gaps(spark, d):
    rows = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("ts", f"{int(EVENT_GAP)} seconds").alias("w")).agg(F.min("s").alias("first_start"), F.count(F.lit(1)).alias("n")).select("user_id", "first_start", "n")


@query("""
WITH n AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS u, sum(length(text)) OVER (PARTITION BY conv_id) AS t FROM conversations)
SELECT conv_id, turn, round(60.0 * (u - n) / t, 6) AS start, round(60.0 * u / t, 6) AS "end" FROM n""")
def running_share(spark, d):
    rows = sentences.spread_times(table(spark, d, "conversations"), "conv_id", "turn", "text", F.lit(0.0), F.lit(60.0))
    return rows.select("conv_id", "turn", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) AS INTEGER) AS \"window\" FROM conversations")
def page_windows(spark, d):
    return layout.page_windows(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", 3)


@query(f"""
WITH p AS (SELECT conv_id, turn, {sql_strip('text')} AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, string_agg(CASE WHEN n > 1 THEN '## Page ' || turn || chr(10) || chr(10) || t ELSE t END, chr(10) || chr(10) ORDER BY turn) AS markdown FROM p WHERE t <> '' GROUP BY conv_id""")
def page_markdown(spark, d):
    return layout.pages_markdown(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""
WITH r AS (SELECT user_id, event_id, value, floor((row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1) / 6) AS b FROM events)
SELECT event_id, CAST(b AS INTEGER) AS batch, max(value) OVER (PARTITION BY user_id, b) AS batch_ratio FROM r""")
def width_batches(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("image_id"), "event_id", "value")
    return layout.width_batches(rows, "event_id", "value").select("event_id", "batch", "batch_ratio")


@query("SELECT event_id, value AS score FROM events WHERE value >= 0.5")
def ocr_line_filter(spark, d):
    return layout.kept_lines(table(spark, d, "events").select("event_id", F.col("value").alias("score")))


# Scoring ---------------------------------------------------------------------------------------------------------

PAIRS = "SELECT conv_id, turn, role, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)), '[^a-z0-9]', '', 'g') AS b FROM conversations"


def _pairs(spark, d):
    t = table(spark, d, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    ascii_ = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return t.withColumn("b", ascii_(after)).select("conv_id", "turn", "role", ascii_(F.col("text")).alias("a"), "b", F.col("text").alias("whole")).where("b IS NOT NULL")


@query(f"SELECT conv_id, turn, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) END, 9) AS similarity FROM ({PAIRS}) WHERE b IS NOT NULL")
def doc_similarity(spark, d):
    return scoring.document_similarity(_pairs(spark, d), "a", "b").select("conv_id", "turn", F.round("similarity", 9).alias("similarity"))


@query(f"SELECT role, CAST(sum(levenshtein(a, b)) AS BIGINT) AS edits, CAST(sum(length(a)) AS BIGINT) AS units, round(sum(levenshtein(a, b)) / greatest(sum(length(a)), 1), 9) AS rate FROM ({PAIRS}) WHERE b IS NOT NULL GROUP BY role")
def cer_by_role(spark, d):
    return scoring.error_rates(_pairs(spark, d), "role", "a", "b", by_chars=True).withColumn("rate", F.round("rate", 9))


def sql_scoring_words(x: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower(regexp_replace({x}, '<[^>]*(>|$)', ' ', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), '[^{S}]+')"


def sql_coded(ws: str, other: str) -> str:
    """Words as one byte each, since the SQL's edit distance counts bytes: a sign for each word that both sides have, and one
    for all others of this side, which equal nothing."""
    return f"array_to_string(list_transform({ws}, lambda w: CASE WHEN list_contains(names, w) THEN chr(CAST(34 + list_position(names, w) AS INTEGER)) ELSE '{other}' END), '')"


@query(f"""
WITH p AS (SELECT role, {sql_scoring_words('text')} AS a, {sql_scoring_words('b')} AS b FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL),
d AS (SELECT role, a, b, list_intersect(a, b) AS names FROM p),
k AS (SELECT role, len(a) AS n, levenshtein({sql_coded('a', '!')}, {sql_coded('b', '"')}) AS e FROM d)
SELECT role, CAST(sum(e) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS units, round(sum(e) / greatest(sum(n), 1), 9) AS rate FROM k GROUP BY role""")
def wer_by_role(spark, d):
    t = table(spark, d, "conversations")
    pairs = t.withColumn("after", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("after IS NOT NULL")
    return scoring.error_rates(pairs, "role", "text", "after").withColumn("rate", F.round("rate", 9))


@query(rf"""
WITH w AS (SELECT conv_id, role, unnest({sql_words(rf"regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')")}) AS w FROM conversations),
a AS (SELECT conv_id, w, count(*) AS a FROM w WHERE role = 'user' GROUP BY ALL), b AS (SELECT conv_id, w, count(*) AS b FROM w WHERE role = 'assistant' GROUP BY ALL),
j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.w = b.w)
SELECT conv_id, CAST(sum(least(a, b)) AS BIGINT) AS common, CAST(sum(a) AS BIGINT) AS n_doc, CAST(sum(b) AS BIGINT) AS n_ref, round(sum(least(a, b)) * 2.0 / sum(a + b), 9) AS f1 FROM j GROUP BY conv_id""")
def bag_f1(spark, d):
    t = table(spark, d, "conversations").withColumn("ws", strings.words(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")))
    return scoring.bag_overlap(t.where("role = 'user'"), t.where("role = 'assistant'"), "conv_id", "ws").withColumn("f1", F.round("f1", 9))


@query("""
SELECT lang, source, count(*) AS n, round(avg(quality), 9) AS quality, round(avg(n_chars), 6) AS n_chars
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))""")
def score_rollup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return scoring.grouped_means(rows, ["lang", "source"], ["quality", "n_chars"]).select("lang", "source", "n", F.round("quality", 9).alias("quality"), F.round("n_chars", 6).alias("n_chars"))


# Arrays ----------------------------------------------------------------------------------------------------------


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


V = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


def _rounded(c, n=6):
    return F.transform(c, lambda x: F.round(x, n))


@query(f"SELECT vec_id, list_transform(list_sort(list_transform(range(1, len(v) + 1), lambda i: {{'k': -v[i], 'i': i - 1}}))[1:5], lambda s: CAST(s.i AS INTEGER)) AS places FROM ({V})")
def top_k_embed(spark, d):
    return _vectors(spark, d).select("vec_id", F.transform(arrays.top_k(F.col("v"), 5), lambda x: x["index"].cast("int")).alias("places"))


@query(f"""
WITH e AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS p FROM ({V}))
SELECT vec_id, round(list_max(p) / list_sum(p), 9) AS top, round(list_min(p) / list_sum(p), 9) AS low FROM e""")
def softmax_embed(spark, d):
    rows = _vectors(spark, d).select("vec_id", arrays.softmax(F.col("v")).alias("p"))
    return rows.select("vec_id", F.round(F.array_max("p"), 9).alias("top"), F.round(F.array_min("p"), 9).alias("low"))


@query(f"""
WITH m AS (SELECT vec_id, v, list_avg(v) AS m FROM ({V})), s AS (SELECT vec_id, v, m, sqrt(list_avg(list_transform(v, lambda x: (x - m) * (x - m))) + 1e-5) AS s FROM m)
SELECT vec_id, round((list_max(v) - m) / s, 6) AS top, round((v[1] - m) / s, 6) AS head FROM s""")
def layernorm_embed(spark, d):
    rows = _vectors(spark, d).select("vec_id", arrays.layer_norm(F.col("v")).alias("n"))
    return rows.select("vec_id", F.round(F.array_max("n"), 6).alias("top"), F.round(F.get("n", F.lit(0)), 6).alias("head"))


@query(f"""
SELECT vec_id, round(list_sum(v), 6) AS total, round(list_max(v), 9) AS most, round(list_min(v), 9) AS least, round(list_avg(v), 9) AS mean,
  round(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 6) AS logsumexp, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS argmax FROM ({V})""")
def reduce_embed(spark, d):
    v = F.col("v")
    return _vectors(spark, d).select("vec_id", F.round(arrays.total(v), 6).alias("total"), F.round(F.array_max(v), 9).alias("most"), F.round(F.array_min(v), 9).alias("least"), F.round(arrays.mean(v), 9).alias("mean"), F.round(arrays.logsumexp(v), 6).alias("logsumexp"), arrays.argmax(v).alias("argmax"))


@query(f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / (1 + exp(-x)))), 6) AS silu, round(list_sum(list_transform(v, lambda x: greatest(x, 0))), 6) AS relu, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS square FROM ({V})")
def unary_embed(spark, d):
    one = lambda n: F.round(arrays.total(arrays.map_unary(F.col("v"), n)), 6).alias(n)
    return _vectors(spark, d).select("vec_id", one("silu"), one("relu"), one("square"))


@query(f"""
WITH g AS (SELECT vec_id, g, v[g * 32 + 1 : g * 32 + 32] AS w FROM ({V}), range(0, 2) t(g)),
q AS (SELECT vec_id, g, list_min(w) AS b, (list_max(w) - list_min(w)) / 15 AS s, w FROM g)
SELECT vec_id, CAST(g AS INTEGER) AS group_no, CAST(list_sum(list_transform(w, lambda x: CAST(round((x - b) / s) AS INTEGER))) AS BIGINT) AS q_sum, round(s, 9) AS scale FROM q""")
def affine_quant(spark, d):
    rows = _vectors(spark, d).select("vec_id", F.posexplode(arrays.affine_quantized(F.col("v"), 4, 32)).alias("group_no", "g"))
    return rows.select("vec_id", "group_no", F.aggregate("g.q", F.lit(0).cast("long"), lambda a, x: a + x).alias("q_sum"), F.round("g.scale", 9).alias("scale"))


T = f"SELECT vec_id, list_transform(v, lambda x: CAST(floor(x * 8) AS INTEGER) % 3 + 2) AS t FROM ({V})"


def _tokens(spark, d):
    return _vectors(spark, d).select("vec_id", F.transform("v", lambda x: (F.floor(x * 8).cast("int") % 3 + 2).cast("int")).alias("t"))


@query(f"SELECT vec_id, list_filter(t, lambda x, i: x <> 2 AND (i = 1 OR x <> t[i - 1])) AS collapsed FROM ({T})")
def ctc_collapse(spark, d):
    return _tokens(spark, d).select("vec_id", repetition.ctc_collapsed(F.col("t"), 2).alias("collapsed"))


@query(f"""
SELECT vec_id, list_sort(list_distinct(list_transform(list_filter(range(1, 31), lambda i: r[i : i + 1] = t[63:64]), lambda i: r[i + 2]))) AS banned FROM (SELECT vec_id, t, t[33:64] AS r FROM ({T}))""")
def ngram_ban(spark, d):
    return _tokens(spark, d).select("vec_id", F.array_sort(repetition.banned_tokens(F.col("t"), 3, 32)).alias("banned"))


# Books, transcripts, layout on literals and tables ---------------------------------------------------------------

OPF = '<package><manifest><item id="c2" href="two%20b.xhtml"/><item href="one.xhtml" id="c1" media-type="x"/></manifest><spine><itemref idref="c1"/><itemref linear="no" idref="c2"/><itemref idref="gone"/></spine></package>'


@query("SELECT * FROM (VALUES (1, 0, 'one.xhtml'), (1, 1, 'two b.xhtml')) t(book_id, pos, href)")
def spine_join(spark, d):
    return epub.chapters(spark.createDataFrame([(1, OPF)], "book_id int, opf string"))


@query("SELECT page_id, 'Title: ' || page_id || chr(10) || 'Author: ' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || chr(10) || 'Tags: a, b' AS context FROM pages")
def metadata_context(spark, d):
    info = F.struct(F.col("page_id").cast("string").alias("title"), F.lit(" ").alias("channel"), routing.url_parts(F.col("url"))["netloc"].alias("uploader"), F.lit("").alias("description"), F.array(F.lit("a"), F.lit(" "), F.lit("b")).alias("tags"), F.array().cast("array<struct<title:string>>").alias("chapters"))
    return table(spark, d, "pages").select("page_id", transcripts.metadata_context(info).alias("context"))


@query("""SELECT page_id, '{"task_type":"transcript","platform":' || CASE WHEN contains(lower(url), 'youtube.com') THEN '"youtube"' ELSE 'null' END || ',"page":' || page_id || '}' AS payload FROM pages""")
def json_payload(spark, d):
    p = F.nullif(routing.platform(F.col("url")), F.lit("unknown"))
    return table(spark, d, "pages").select("page_id", transcripts.payload(F.struct(F.lit("transcript").alias("task_type"), p.alias("platform"), F.col("page_id").alias("page"))).alias("payload"))


@query("""SELECT event_id, '<!-- loc page=' || (user_id + 1) || ' bbox=0.000,0.250,0.500,1.000 kind=' || replace(event_type, '-', '_') || ' -->' AS anchor FROM events""")
def anchors(spark, d):
    box = F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)))
    return table(spark, d, "events").select("event_id", layout.anchor(F.col("user_id") + 1, box, F.col("event_type")).alias("anchor"))


@query("""SELECT * FROM (VALUES (1, ['en-orig', 'en', 'zh-Hans', 'fr']), (2, ['zh-Hans', 'en-orig', 'en', 'fr']), (3, ['en-orig', 'en', 'fr', 'zh-Hans'])) t(id, ranked)""")
def ranked_languages(spark, d):
    rows = spark.createDataFrame([(1, None), (2, "zh"), (3, "en")], "id int, asked string")
    return rows.select("id", languages.ranked_languages(F.array(*(F.lit(x) for x in ("fr", "zh-Hans", "en", "en-orig"))), F.coalesce("asked", F.lit(""))).alias("ranked"))


@query()
def readable_html(spark, d):
    rows = table(spark, d, "pages").select("page_id", readable.readable_html(F.col("html")).alias("r"))
    return rows.select("page_id", "r.title", "r.author", "r.markdown")


@query(rf"""
WITH j AS (SELECT conv_id, string_agg({sql_strip('text')}, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, {sql_strip(r"regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS markdown FROM j""")
def layout_markdown(spark, d):
    """Conversations as tagged pages: each turn a block that the next page's continues, rendered to Markdown."""
    tag = F.concat(F.lit("<PAGE><BLOCK>"), F.when(F.col("turn") == 0, "cross_text").otherwise("append_text"), F.lit("[0, 0, 999, 999]<FORK>"), F.col("text"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", tag.alias("t")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "").alias("raw"))
    return rows.select("conv_id", layout_blocks.markdown(F.col("raw")).alias("markdown"))


@query(rf"""
WITH u AS (SELECT conv_id, turn, regexp_extract_all(regexp_replace(replace(text, 'the', '中文the字'), '[^\p{{L}}\p{{N}}''\s]', '', 'g'), '[{alignment.IDEOGRAPHS}]|[^\s{alignment.IDEOGRAPHS}]+') AS units FROM conversations)
SELECT conv_id, turn, CAST(len(units) AS INTEGER) AS n_units, md5(array_to_string(units, '|')) AS digest FROM u""")
def alignment_units(spark, d):
    text = F.replace("text", F.lit("the"), F.lit("中文the字"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", alignment.units(text).alias("units"))
    return rows.select("conv_id", "turn", F.size("units").alias("n_units"), F.md5(F.array_join("units", "|").cast("binary")).alias("digest"))


@query(f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(list_transform(v, lambda x, i: floor(i - 1 + x * 8)), lambda c: c * {alignment.CLASS_MS}) AS v FROM ({V})),
b AS (SELECT vec_id, v, 0 AS i, CAST([] AS BIGINT[]) AS best, CAST([] AS BIGINT[]) AS before FROM v UNION ALL
  SELECT vec_id, v, i + 1, list_append(best, k + 1), list_append(before, CASE WHEN k = 0 THEN 0 ELSE list_filter(range(1, i + 1), lambda j: best[j] = k AND v[j] <= v[i + 1])[1] END)
  FROM (SELECT *, coalesce(list_max(list_transform(list_filter(range(1, i + 1), lambda j: v[j] <= v[i + 1]), lambda j: best[j])), 0) AS k FROM b WHERE i < len(v))),
t AS (SELECT vec_id, v, before, [list_position(best, list_max(best))] AS kept FROM b WHERE i = len(v) UNION ALL
  SELECT vec_id, v, before, list_prepend(before[kept[1]], kept) FROM t WHERE before[kept[1]] > 0),
k AS (SELECT vec_id, v, arg_max(kept, len(kept)) AS kept FROM t GROUP BY vec_id, v),
p AS (SELECT vec_id, v, kept, list_transform(range(1, len(v) + 1), lambda i: {{'i': i, 'a': list_max(list_filter(kept, lambda j: j < i)), 'b': list_min(list_filter(kept, lambda j: j > i))}}) AS ps FROM k)
SELECT vec_id, list_transform(ps, lambda p: CAST(trunc(CASE WHEN list_contains(kept, p.i) THEN v[p.i] WHEN p.a IS NULL THEN v[p.b] WHEN p.b IS NULL THEN v[p.a]
  WHEN p.b - p.a <= 3 THEN CASE WHEN p.i - p.a <= p.b - p.i THEN v[p.a] ELSE v[p.b] END ELSE v[p.a] + (v[p.b] - v[p.a]) * (p.i - p.a) / (p.b - p.a) END) AS BIGINT) / 1000.0) AS times FROM p""")
def timestamp_repair(spark, d):
    rows = _vectors(spark, d).select("vec_id", F.transform("v", lambda x, i: F.floor(i + x * 8)).alias("c"))
    return rows.select("vec_id", alignment.class_times(F.col("c")).alias("times"))


# Joins and aggregates over the relational tables -----------------------------------------------------------------


def _plain(name: str, sql: str) -> None:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    used = [t for t in names if re.search(rf"\b{t}\b", sql)]

    def run(spark, d):
        # Tables go in as parameters, so no view of the user's is touched.
        return spark.sql(re.sub(rf"\b({'|'.join(used)})\b", r"{\1}", sql), **{t: table(spark, d, t) for t in used})

    run.__name__ = name
    query(sql)(run)


_plain("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
_plain("revenue_by_nation", """SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
_plain("nation_region_lookup", """SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
_plain("event_type_rates", """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS most FROM events GROUP BY event_type""")

from folioworks.plans import branches  # noqa: E402,F401  registers its queries
