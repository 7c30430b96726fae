"""Queries over what tables of the data set are turned into on both sides (Markdown with headings, file paths, caption
payloads, boxes), so that branches are compared that the tables themselves never reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import arrays, prompts, routing, sizes, strings, timecode
from folioworks.operators import alignment, captions, chunking, epub, languages, layout, sentences
from folioworks.plans.sql import S, query, sql_strip, table

BUDGET = 500

# Markdown --------------------------------------------------------------------------------------------------------

#: Pages with headings of level 1 to 3, sections of several sizes, emphasis, links, braces and ideographs.
MARKDOWN = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'plain ' ELSE '' END || repeat('#', CAST(doc_id % 3 + 1 AS INTEGER)) || ' *Doc* [nr ' || doc_id || '](http://x/y) {#id}。' || chr(10) || chr(10)
  || substr(text, 1, 300) || chr(10) || '## Part one' || chr(10) || substr(text, 301, CAST(doc_id % 700 AS INTEGER)) || chr(10) || '### 中文 part' || chr(10) || chr(10) || substr(text, 301, 350)
  || chr(10) || '## Part two' || chr(10) || substr(text, 701, 450) AS text FROM documents WHERE text IS NOT NULL"""


def _markdown(spark, d):
    return spark.sql(MARKDOWN.replace("{#id}", "{{#id}}").replace("chr(10)", "'\\n'").replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents"))


def sql_packed(pieces: str, glue: int, alone: str = "FALSE") -> str:
    """doc_id, chunk_no and lengths of neighbouring pieces (doc_id, i, n, alone) joined while they fit the budget."""
    return f"""
k AS (SELECT doc_id, i, n, alone, 0 AS chunk_no, n AS size FROM ({pieces}) WHERE i = 1 UNION ALL
  SELECT p.doc_id, p.i, p.n, p.alone, CASE WHEN fits THEN chunk_no ELSE chunk_no + 1 END, CASE WHEN fits THEN size + {glue} + p.n ELSE p.n END
  FROM (SELECT p.*, k.chunk_no, k.size, NOT k.alone AND NOT p.alone AND k.size + {glue} + p.n <= {BUDGET} AS fits FROM k JOIN ({pieces}) p ON p.doc_id = k.doc_id AND p.i = k.i + 1) p)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(max(size) AS INTEGER) AS chunk_len FROM k GROUP BY doc_id, chunk_no"""


@query(rf"""
WITH RECURSIVE m AS (SELECT doc_id, {sql_strip('text')} AS t FROM ({MARKDOWN})),
s AS (SELECT doc_id, l, list_filter(list_transform(string_split(regexp_replace(t, '\n(#{{' || l || '}}[{S}]+[^\n])', chr(1) || '\1', 'g'), chr(1)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ps
  FROM m, range(1, 7) r(l) WHERE length(t) > {BUDGET}),
f AS (SELECT doc_id, min(l) AS l FROM s WHERE len(ps) > 1 AND list_max(list_transform(ps, lambda x: length(x))) <= {BUDGET} GROUP BY doc_id),
p AS MATERIALIZED (SELECT doc_id, unnest(list_transform(ps, lambda x: length(x))) AS n, unnest(range(1, len(ps) + 1)) AS i, FALSE AS alone FROM s JOIN f USING (doc_id, l)),
{sql_packed('SELECT * FROM p', len(chunking.SEPARATOR))}""")
def chunk_headings(spark, d):
    """Chunks of the documents that some heading level splits."""
    rows = _markdown(spark, d).select("doc_id", chunking.text_context(strings.strip(F.col("text")), F.lit("x"), BUDGET).alias("c")).where("c.split_header_level IS NOT NULL")
    return rows.select("doc_id", F.posexplode("c.chunk_list").alias("chunk_no", "chunk")).select("doc_id", "chunk_no", F.length("chunk").alias("chunk_len"))


#: Sentences as paragraphs: blank lines between them, some with blanks.
PARAGRAPHS = """SELECT doc_id, replace(replace(text, '. ', '.' || chr(10) || '  ' || chr(10)), ', ', ',' || chr(10)) AS text FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0"""


@query(rf"""
WITH RECURSIVE q AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n[{S}]*\n'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ps FROM ({PARAGRAPHS})),
u AS (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS g FROM q),
w AS (SELECT doc_id, g, length(x) > {BUDGET} AS alone, unnest(list_filter(list_transform(range(0, CAST(floor((length(x) - 1) / {BUDGET}) AS BIGINT) + 1), lambda j: {sql_strip(f'substr(x, CAST(j AS INTEGER) * {BUDGET} + 1, {BUDGET})')}), lambda y: y <> '')) AS y FROM u),
p AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, o) AS i, length(y) AS n, alone FROM (SELECT *, row_number() OVER () AS o FROM w)),
{sql_packed('SELECT * FROM p', 2)}""")
def chunk_paragraphs(spark, d):
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".\n  \n")), F.lit(", "), F.lit(",\n"))
    rows = table(spark, d, "documents").where("text IS NOT NULL AND doc_id % 2 = 0").select("doc_id", F.posexplode(chunking.paragraph_chunks(text, BUDGET)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.length("chunk").alias("chunk_len"))


@query(rf"""
WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}) AS ls FROM ({MARKDOWN}))
SELECT doc_id, coalesce(list_filter(list_transform(list_filter(ls, lambda x: starts_with(x, '# ')), lambda x: {sql_strip('substr(x, 3)')}), lambda x: x <> '')[1],
  list_filter(ls, lambda x: x <> '' AND NOT starts_with(x, '#') AND length(x) <= 100)[1], 'none') AS title FROM t""")
def short_titles(spark, d):
    return _markdown(spark, d).select("doc_id", strings.short_title(F.col("text"), F.lit("none")).alias("title"))


@query(rf"""
WITH t AS (SELECT doc_id, {sql_strip('text')} AS t FROM ({MARKDOWN})),
l AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ls FROM t),
f AS (SELECT doc_id, coalesce(nullif(list_filter(ls, lambda x: starts_with(x, '# '))[1][3:], ''), list_filter(ls[1:5], lambda x: NOT regexp_matches(x, '^([#!\[<{{]|:::|---|(?i:http))'))[1]) AS t FROM l),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^#+[{S}]*', ''), '\*+([^*]+)\*+', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\{{[^}}]*\}}|\([^)]*\)|#\w+', '', 'g') AS t FROM f)
SELECT doc_id, coalesce(nullif(regexp_replace({sql_strip(f"regexp_replace(regexp_replace(t, '^[{chr(34)}'']+|[{chr(34)}'']+$', '', 'g'), '[{S}]+', ' ', 'g')")}, '[。，、；：！？]+$', ''), ''), 'untitled') AS title FROM c""")
def markdown_titles(spark, d):
    return _markdown(spark, d).select("doc_id", strings.title(F.col("text"), F.lit("untitled")).alias("title"))


# Pages and books -------------------------------------------------------------------------------------------------

FORMULAS = "SELECT page_id, 'Sum $x_' || page_id || '$ and $$' || chr(10) || 'a b$$ <!-- note' || chr(10) || '--> 中文 \\(c\\) ' || html AS t FROM pages"


@query(rf"""
WITH f AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$\n]+?\$', ' ', 'g'), '(?s)<!--.*?-->|<[^>]+>', ' ', 'g') AS t FROM ({FORMULAS}))
SELECT page_id, md5(lower(regexp_replace(t, '[^0-9A-Za-z\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}]+', '', 'g'))) AS digest,
  CAST(len(regexp_extract_all(lower(t), '[0-9a-z]+|[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}]')) AS INTEGER) AS n_tokens FROM f""")
def page_scoring_texts(spark, d):
    t = F.concat(F.lit("Sum $x_"), F.col("page_id").cast("string"), F.lit("$ and $$\na b$$ <!-- note\n--> 中文 \\(c\\) "), F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(strings.page_text(t).cast("binary")).alias("digest"), F.size(strings.page_tokens(t)).alias("n_tokens"))


@query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Head' || chr(10) || '## One' || page_id || ': Two' || chr(10) || chr(10) || 'text'
  WHEN 1 THEN 'no [link](a.md)' ELSE 'x' || chr(10) || '## A tail' || chr(10) || chr(10) || 'mid' || chr(10) || '## B' || chr(10) END AS flat FROM pages""")
def flattened_contents(spark, d):
    page = F.col("page_id").cast("string")
    t = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Head\n[One"), page, F.lit("](a.html#x)\n\n\n[Two](b.XHTML)\ntext"))).when(F.col("page_id") % 3 == 1, "no [link](a.md)").otherwise("x [A](a.html) tail\nmid\n[B](c.html)")
    return table(spark, d, "pages").select("page_id", epub.flattened_contents(t).alias("flat"))


@query("""
WITH f AS (SELECT page_id, page_id % 5 AS book, CASE WHEN page_id % 10 = 0 THEN 'a/OEBPS/' WHEN page_id % 10 = 5 THEN 'z/' WHEN page_id % 2 = 0 THEN 'text/' ELSE 'OPS/' END || lpad(CAST(page_id AS VARCHAR), 6, '0') || CASE page_id % 3 WHEN 0 THEN '.xhtml' WHEN 1 THEN '.HTML' ELSE '.css' END AS path FROM pages),
r AS (SELECT book, min(nullif(regexp_extract(path, '^((?:.*?/)?(?:OEBPS|OPS)/)', 1), '')) AS root FROM f GROUP BY book)
SELECT book AS book_id, CAST(row_number() OVER (PARTITION BY book ORDER BY path) - 1 AS INTEGER) AS pos, path AS href FROM f JOIN r USING (book) WHERE regexp_matches(lower(path), '\\.x?html?$') AND (root IS NULL OR starts_with(path, root))""")
def folder_chapters(spark, d):
    n = F.col("page_id")
    path = F.concat(F.when(n % 10 == 0, "a/OEBPS/").when(n % 10 == 5, "z/").when(n % 2 == 0, "text/").otherwise("OPS/"), F.lpad(n.cast("string"), 6, "0"), F.when(n % 3 == 0, ".xhtml").when(n % 3 == 1, ".HTML").otherwise(".css"))
    return epub.folder_chapters(table(spark, d, "pages").select((n % 5).alias("book_id"), path.alias("path")))


# Routing ---------------------------------------------------------------------------------------------------------

EXTENSIONS = [".PDF", ".mp3", ".mkv", ".tiff", ".md", ".epub", ".xlsx", ".xyz", "", ".webm", ".docx", ".html", ".JPEG"]
PATHS = f"""SELECT page_id, 'dir.v2/file ' || page_id || {EXTENSIONS}[CAST(page_id % {len(EXTENSIONS)} AS INTEGER) + 1] AS path, [NULL, 'ocr', 'transcript', 'convert', ''][CAST(page_id // 13 % 5 AS INTEGER) + 1] AS task, page_id // 65 % 2 = 1 AS scanned FROM pages"""


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query(f"""
WITH p AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext, coalesce(task, '') AS ask FROM ({PATHS})),
k AS (SELECT *, CASE WHEN ext IN {_in(routing.IMAGE)} THEN 'image_file' WHEN ext IN {_in(routing.AUDIO)} THEN 'audio_file' WHEN ext IN {_in(routing.VIDEO)} THEN 'video_file'
  WHEN ext IN {_in((*routing.READERS, *routing.CONVERTED_TOO))} THEN 'document_file' ELSE 'unknown' END AS kind FROM p),
t AS (SELECT *, CASE kind WHEN 'image_file' THEN CASE WHEN ask IN ('', 'ocr') THEN 'ocr' END WHEN 'audio_file' THEN CASE WHEN ask IN ('', 'transcript') THEN 'transcript' END WHEN 'video_file' THEN CASE WHEN ask IN ('', 'transcript') THEN 'transcript' END
  WHEN 'document_file' THEN CASE WHEN ext = '.pdf' AND (ask = 'ocr' OR scanned AND ask = '') THEN 'ocr' WHEN ask IN ('', 'convert') THEN 'convert' END END AS task_type FROM k)
SELECT page_id, ext, kind AS source_kind, task_type, CASE WHEN task_type IS NULL THEN 'unsupported input: ' || kind END AS error, ext IN {_in((*routing.READERS, *routing.CONVERTED_TOO))} AS is_converted, ext IN {_in((*routing.AUDIO, *routing.VIDEO))} AS is_media,
  CASE ext {' '.join(f"WHEN '{e}' THEN '{m}'" for e, m in routing.MIME.items())} END AS mime, CASE WHEN task NOT IN ('transcript', 'convert', 'ocr') THEN 'Unsupported task. Supported tasks: transcript, convert, ocr.' END AS task_error,
  ext IN ('.html', '.htm') AND scanned AS readable FROM t""")
def route_files(spark, d):
    n = F.col("page_id")
    pick = lambda items, i: F.get(F.array(*(F.lit(x) for x in items)), i.cast("int"))
    path = F.concat(F.lit("dir.v2/file "), n.cast("string"), pick(EXTENSIONS, n % len(EXTENSIONS)))
    rows = table(spark, d, "pages").select("page_id", path.alias("path"), pick([None, "ocr", "transcript", "convert", ""], F.floor(n / 13) % 5).alias("task"), (F.floor(n / 65) % 2 == 1).alias("scanned"))
    r = routing.route(F.col("path"), F.col("task"), F.col("scanned"))
    return rows.select("page_id", routing.suffix(F.col("path")).alias("ext"), r["source_kind"].alias("source_kind"), r["task_type"].alias("task_type"), routing.route_error(r)["message"].alias("error"), routing.is_converted(F.col("path")).alias("is_converted"), routing.is_media(F.col("path")).alias("is_media"), routing.mime_type(F.col("path")).alias("mime"), routing.task_error(F.col("task")).alias("task_error"), routing.wants_readable(F.col("task"), F.col("scanned"), F.col("path")).alias("readable"))


FAMILIES = [("line", "maker/line", False), ("page", "maker/page", True), ("page-2", "maker/page-2", True)]
ALIASES = ["", "Page 2", "page_2-8BIT", "maker/page-6bit", "line", "line-4bit", "other", "PAGE"]
WANTED = [None, "8 bit", "4-bit", "BF16", "3bit", " "]


@query(f"""
WITH a AS (SELECT page_id, {ALIASES}[CAST(page_id % {len(ALIASES)} AS INTEGER) + 1] AS alias, {str(WANTED).replace('None', 'NULL')}[CAST(page_id % 7 % {len(WANTED)} AS INTEGER) + 1] AS wanted FROM pages),
n AS (SELECT *, regexp_replace(regexp_replace(lower(CASE WHEN alias = '' THEN 'page-2' ELSE alias END), '[ _]', '-', 'g'), '^[^/]*/', '') AS name, regexp_replace(lower(trim(wanted)), '[- ]', '', 'g') AS w FROM a),
p AS (SELECT *, nullif(regexp_extract(name, '-(4bit|6bit|8bit|bf16)$', 1), '') AS own, regexp_replace(name, '-(4bit|6bit|8bit|bf16)$', '') AS family, CASE WHEN w IN ('4bit', '6bit', '8bit', 'bf16') THEN w END AS p FROM n),
e AS (SELECT *, CASE WHEN w <> '' AND p IS NULL THEN 'unknown precision' WHEN own <> p THEN 'precision conflicts with the model''s own' WHEN family NOT IN ('line', 'page', 'page-2') OR family = 'line' AND own IS NOT NULL THEN 'unknown model' END AS error FROM p),
m AS (SELECT *, CASE WHEN error IS NULL THEN CASE family WHEN 'line' THEN 'maker/line' ELSE 'maker/' || family || '-' || coalesce(p, own, '4bit') END END AS model FROM e)
SELECT page_id, model, error, CASE WHEN contains(model, '-4bit') THEN replace(model, '-4bit', '-8bit') END AS fallback, CASE WHEN ends_with(model, '-bf16') THEN 'dense checkpoints are not supported: ' || model END AS dense FROM m""")
def model_aliases(spark, d):
    n = F.col("page_id")
    pick = lambda items, i: F.get(F.array(*(F.lit(x) for x in items)), i.cast("int"))
    rows = table(spark, d, "pages").select("page_id", pick(ALIASES, n % len(ALIASES)).alias("alias"), pick(WANTED, n % 7 % len(WANTED)).alias("wanted"))
    found = routing.model_by_alias(rows, spark.createDataFrame(FAMILIES, "family string, repo string, quantized boolean"), "page-2")
    return found.select("page_id", "model", "error", routing.eight_bit_fallback(F.col("model")).alias("fallback"), routing.dense_error(F.col("model")).alias("dense"))


@query("""
WITH r AS (SELECT page_id, CAST(page_id % 7 - 1 AS INTEGER) AS a, CAST(page_id % 11 AS INTEGER) AS b, 9 AS n, CASE WHEN page_id % 2 = 0 THEN 'out' END AS dir, CASE WHEN page_id % 3 = 0 THEN 'f.md' END AS req, [' Markdown', 'SRT ', 'vtt', 'json', 'pdf'][CAST(page_id % 5 AS INTEGER) + 1] AS fmt FROM pages)
SELECT page_id, CASE WHEN a < 0 THEN 'the first page is negative' WHEN b < a THEN 'the last page is before the first' WHEN a >= n THEN 'the first page is beyond the document' WHEN b >= n THEN 'the last page is beyond the document' END AS range_error,
  CASE WHEN dir IS NULL THEN req END AS output_file, dir IS NOT NULL AND req IS NOT NULL AS ignored, CASE lower(trim(fmt)) WHEN 'markdown' THEN 'md' WHEN 'pdf' THEN NULL ELSE lower(trim(fmt)) END AS extension,
  coalesce(nullif(concat_ws(chr(10) || chr(10), dir, nullif(trim(coalesce(req, ' ')), '')), ''), NULL) AS context, page_id % 2 = 0 OR page_id % 3 = 0 AS positions FROM r""")
def request_checks(spark, d):
    n = F.col("page_id")
    rows = table(spark, d, "pages").select("page_id", (n % 7 - 1).cast("int").alias("a"), (n % 11).cast("int").alias("b"), F.when(n % 2 == 0, "out").alias("dir"), F.when(n % 3 == 0, "f.md").alias("req"), F.get(F.array(*(F.lit(x) for x in (" Markdown", "SRT ", "vtt", "json", "pdf"))), (n % 5).cast("int")).alias("fmt"))
    w = routing.written_to(F.col("dir"), F.col("req"))
    return rows.select("page_id", routing.page_range_error(F.col("a"), F.col("b"), F.lit(9)).alias("range_error"), w["output_file"].alias("output_file"), w["ignored"].alias("ignored"), routing.output_format(F.col("fmt"))["extension"].alias("extension"), routing.merged_context(F.col("dir"), F.coalesce("req", F.lit(" "))).alias("context"), routing.wants_positions(n % 2 == 0, n % 3 == 0).alias("positions"))


@query(f"""
SELECT conv_id, turn, '{prompts.TURN}system' || chr(10) || CASE WHEN turn > 0 THEN role ELSE '' END || '{prompts.TURN_END}' || chr(10) || '{prompts.TURN}user' || chr(10) || '{prompts.SOUND}' || repeat('{prompts.SOUND_PAD}', CAST(turn AS INTEGER)) || '{prompts.SOUND_END}{prompts.TURN_END}' || chr(10)
  || '{prompts.TURN}assistant' || chr(10) || CASE WHEN turn % 2 = 0 THEN 'language English{prompts.SPEECH}' ELSE '' END AS speech, '{prompts.IMAGE}' || text AS image,
  '{prompts.SOUND}' || repeat('{prompts.SOUND_PAD}', 2) || '{prompts.SOUND_END}' || array_to_string(list_transform(string_split(role, 's'), lambda u: u || '{prompts.TIME * 2}'), '') AS aligned, list_concat([0, 7, 7, 7], [CAST(turn AS INTEGER)]) AS ids FROM conversations""")
def prompt_texts(spark, d):
    turn = F.col("turn").cast("int")
    return table(spark, d, "conversations").select("conv_id", "turn", prompts.speech_prompt(F.when(turn > 0, F.col("role")), F.when(turn % 2 == 0, "English"), turn).alias("speech"), prompts.image_prompt(F.col("text")).alias("image"), prompts.alignment_prompt(F.split("role", "s"), F.lit(2)).alias("aligned"), prompts.image_ids(0, 7, F.lit(3), F.array(turn)).alias("ids"))


# Captions --------------------------------------------------------------------------------------------------------

CUE_MS = "SELECT conv_id, turn, turn * 1500 AS a, CASE WHEN turn % 3 = 0 THEN 0 ELSE 900 END AS n, regexp_replace(text, '[\"\\\\<>&]', '', 'g') AS x FROM conversations"


def _payloads(spark, d, kind: str):
    t = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 1500).alias("a"), F.when(F.col("turn") % 3 == 0, 0).otherwise(900).alias("n"), F.regexp_replace("text", '["\\\\<>&]', "").alias("x"))
    if kind == "json3":
        one = F.to_json(F.struct(F.col("a").alias("tStartMs"), F.col("n").alias("dDurationMs"), F.array(F.struct(F.col("x").alias("utf8")), F.struct(F.lit("\n!").alias("utf8"))).alias("segs")))
        whole = lambda xs: F.concat(F.lit('{"wireMagic":"pb3","events":['), F.array_join(xs, ","), F.lit("]}"))
    else:
        one = F.concat(F.lit('<text start="'), (F.col("a") / 1000).cast("string"), F.lit('" dur="'), (F.col("n") / 1000).cast("string"), F.lit('">'), F.col("x"), F.lit(" &amp;amp; <b>so</b>\non</text>"))
        whole = lambda xs: F.concat(F.lit("<?xml version='1.0'?><transcript>"), F.array_join(xs, ""), F.lit("</transcript>"))
    return t.groupBy("conv_id").agg(whole(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("p")))), lambda x: x["p"])).alias("payload"))


def sql_ms(x: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"


def sql_srt(body: str) -> str:
    end = "a + CASE WHEN n > 0 THEN n ELSE 1000 END"
    return f"""SELECT conv_id, string_agg(i || chr(10) || {sql_ms('CAST(a AS BIGINT)')} || ' --> ' || {sql_ms(f'CAST({end} AS BIGINT)')} || chr(10) || x || chr(10), chr(10) ORDER BY turn) AS srt
FROM (SELECT conv_id, turn, a, n, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM (SELECT conv_id, turn, a, n, {body} AS x FROM ({CUE_MS}))) GROUP BY conv_id"""


@query(sql_srt(sql_strip("replace(x, chr(10), ' ') || ' !'")))
def json3_captions(spark, d):
    return _payloads(spark, d, "json3").select("conv_id", captions.milliseconds_srt(captions.json3_cues(F.col("payload"))).alias("srt"))


@query(sql_srt(sql_strip(f"regexp_replace(x || ' &amp; so on', '[{S}]+', ' ', 'g')")))
def xml_captions(spark, d):
    return _payloads(spark, d, "xml").select("conv_id", captions.milliseconds_srt(captions.xml_cues(F.col("payload"))).alias("srt"))


@query("SELECT conv_id, 'json3' AS a, 'xml' AS b FROM conversations GROUP BY conv_id")
def payload_kinds(spark, d):
    both = _payloads(spark, d, "json3").join(_payloads(spark, d, "xml").withColumnRenamed("payload", "other"), "conv_id")
    return both.select("conv_id", captions.payload_kind(F.col("payload")).alias("a"), captions.payload_kind(F.col("other")).alias("b"))


@query(f"""SELECT conv_id, turn, {sql_strip("regexp_replace(replace(replace(text, '<', ''), '>', ''), '[' || chr(10) || ']+', ' ', 'g')")} AS bare, turn * 61 + 0.25 AS seconds, NULL AS none FROM conversations""")
def caption_lines(spark, d):
    text = F.regexp_replace(F.replace(F.replace("text", F.lit("<"), F.lit("")), F.lit(">"), F.lit("")), "\n+", " ")
    marked = F.concat(F.lit("<00:00:01.500><c.yellow>"), text, F.lit("</c><br/>"))
    stamp = timecode.timecode((F.col("turn") * 61 + 0.25).cast("double"), ".")
    return table(spark, d, "conversations").select("conv_id", "turn", strings.strip(timecode.without_cue_markup(marked)).alias("bare"), timecode.parsed(stamp).alias("seconds"), timecode.parsed(F.lit("x:1")).alias("none"))


# Timed sentences -------------------------------------------------------------------------------------------------


@query(rf"""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws FROM conversations WHERE turn < 6),
h AS (SELECT conv_id, turn, ws, CAST(ceil(len(ws) / 2.0) AS INTEGER) AS h FROM w)
SELECT conv_id, turn, CASE WHEN h = 0 THEN 0.0 ELSE 1.0 END AS first_start, CAST(h AS DOUBLE) + CASE WHEN h = 0 THEN 0.0 ELSE 0.5 END AS first_end, CASE WHEN len(ws) > h THEN h + 1.0 WHEN h = 0 THEN 0.0 ELSE h + 0.5 END AS second_start, CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(ws) + 0.5 END AS second_end FROM h""")
def timed_sentences(spark, d):
    """Two sentences of words, each word a unit of half a second at its number."""
    ws = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
    rows = table(spark, d, "conversations").where("turn < 6").select("conv_id", "turn", ws.alias("ws")).withColumn("h", F.ceil(F.size("ws") / 2.0).cast("int"))
    parts = F.array(F.array_join(F.slice("ws", F.lit(1), F.col("h")), " "), F.array_join(F.slice("ws", F.col("h") + 1, F.size("ws")), ", "))
    units = F.transform("ws", lambda w, i: F.struct(w.alias("text"), (i + 1.0).alias("start"), (i + 1.5).alias("end")))
    got = rows.withColumn("t", alignment.timed_sentences(parts, units))
    return got.select("conv_id", "turn", F.get("t", F.lit(0))["start"].alias("first_start"), F.get("t", F.lit(0))["end"].alias("first_end"), F.get("t", F.lit(1))["start"].alias("second_start"), F.get("t", F.lit(1))["end"].alias("second_end"))


@query(rf"""
WITH RECURSIVE s AS (SELECT conv_id, list({{'t': {sql_strip('text')}, 's': turn * 3.0, 'e': turn * 3.0 + CASE WHEN turn % 4 = 0 THEN 0.5 ELSE 2.5 END}} ORDER BY turn) AS l FROM conversations WHERE {sql_strip('text')} <> '' GROUP BY conv_id),
p AS (SELECT conv_id, l, 1 AS i, 0 AS para, CAST(l[1].t AS VARCHAR) AS text FROM s UNION ALL
  SELECT conv_id, l, i + 1, CASE WHEN new THEN para + 1 ELSE para END, CASE WHEN new THEN l[i + 1].t ELSE text || ' ' || l[i + 1].t END FROM (SELECT *, l[i + 1].s - l[i].e >= 2.0 OR length(text) >= 300 AS new FROM p WHERE i < len(l)))
SELECT conv_id, CAST(para AS INTEGER) AS para, CAST(min(l[i].s) AS DOUBLE) AS start, CAST(max(l[i].e) AS DOUBLE) AS "end", CAST(max(length(text)) AS INTEGER) AS n FROM p GROUP BY conv_id, para""")
def timed_paragraphs(spark, d):
    """Paragraphs by pauses and by length, both rules."""
    t = table(spark, d, "conversations")
    one = F.struct("turn", F.struct(F.col("text"), (F.col("turn") * 3.0).alias("start"), (F.col("turn") * 3.0 + F.when(F.col("turn") % 4 == 0, 0.5).otherwise(2.5)).alias("end")).alias("s"))
    rows = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("s"))
    return rows.select("conv_id", F.posexplode(sentences.gap_paragraphs(F.col("s"))).alias("para", "p")).select("conv_id", "para", "p.start", "p.end", F.length("p.text").alias("n"))


# Layout ----------------------------------------------------------------------------------------------------------


@query("""
WITH b AS (SELECT event_id, CAST(event_id % 1300 - 100 AS DOUBLE) AS x0, CAST(event_id % 997 AS DOUBLE) AS y0, CAST(event_id % 613 AS DOUBLE) AS x1, 500.0::DOUBLE AS y1 FROM events),
c AS (SELECT event_id, x0, list_transform([x0, y0, x1, y1], lambda v: least(greatest(v / 999.0, 0.0), 1.0)) AS g, [x0, y0, x1, y1] AS b FROM b)
SELECT event_id, list_transform([least(g[1], g[3]), least(g[2], g[4]), greatest(g[1], g[3]), greatest(g[2], g[4])], lambda v: round(v, 9)) AS grid,
  [least(b[1], b[3]), least(b[2], b[4]), greatest(b[1], b[3]), greatest(b[2], b[4])] AS bounds, list_transform([b[1] / 800, b[2] / 600], lambda v: round(least(greatest(v, 0.0), 1.0), 9)) AS corner, round(x0 / 7, 3) AS start, round(x0 / 7, 4) AS score FROM c""")
def boxes(spark, d):
    n = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.array((n % 1300 - 100).cast("double"), (n % 997).cast("double"), (n % 613).cast("double"), F.lit(500.0)).alias("b"))
    at = lambda i: F.get("b", F.lit(i))
    quad = F.array(F.array(at(0), at(1)), F.array(at(2), at(3)))
    seg = layout.rounded_segment(F.struct(F.lit("t").alias("text"), F.lit("k").alias("kind"), F.lit(1).alias("page"), F.col("b").alias("bbox"), (at(0) / 7).alias("start"), F.lit(0.0).alias("end"), (at(0) / 7).alias("score")))
    return rows.select("event_id", F.transform(layout.grid_box(F.col("b")), lambda v: F.round(v, 9)).alias("grid"), layout.bounds(quad).alias("bounds"), F.transform(F.get(layout.pixel_quad(quad, F.lit(800.0), F.lit(600.0)), F.lit(0)), lambda v: F.round(v, 9)).alias("corner"), seg["start"].alias("start"), seg["score"].alias("score"))


@query(rf"""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '<!-- loc page=' || (turn + 1) || ' bbox=0.000,0.000,1.000,1.000 kind=page -->' ELSE '<!-- loc page=' || (turn + 1) || ' bbox=0.100,0.200,0.300,0.400 kind=' || role || ' -->' END || chr(10) || {sql_strip('text')} AS markdown,
  CASE WHEN turn % 2 = 0 THEN 1 ELSE 2 END AS n_segments FROM conversations WHERE {sql_strip('text')} <> ''""")
def located_pages(spark, d):
    """Pages with a block and a line, and pages without either."""
    seg = lambda x, k: F.struct(x.alias("text"), k.alias("kind"), F.lit(None).cast("int").alias("page"), F.array(*(F.lit(v) for v in (0.1, 0.2, 0.3, 0.4))).alias("bbox"))
    odd = F.col("turn") % 2 == 1
    blocks, rows = F.when(odd, F.array(seg(F.col("text"), F.col("role")))), F.when(odd, F.array(seg(F.lit("l"), F.lit("line"))))
    got = table(spark, d, "conversations").where(strings.strip(F.col("text")) != "").select("conv_id", "turn", layout.located_page(F.col("turn") + 1, F.col("text"), blocks, rows).alias("p"))
    return got.select("conv_id", "turn", "p.markdown", F.size("p.segments").alias("n_segments"))


@query(f"""
WITH s AS (SELECT event_id, CAST(20 + event_id % 3000 AS INTEGER) AS w, CAST(20 + event_id * 7 % 2500 AS INTEGER) AS h, CAST(event_id % 977 AS INTEGER) AS f FROM events)
SELECT event_id, CASE WHEN w + h < 64 THEN greatest(w, 32) ELSE w END AS padded, CAST(least(ceil(w * 1.0::DOUBLE / h * {sizes.LINE_HEIGHT}), floor({sizes.LINE_HEIGHT} * greatest(2.5, {sizes.LINE_WIDTH / sizes.LINE_HEIGHT}::DOUBLE))) AS INTEGER) AS resized, f // 3 + CASE WHEN f % 3 > 0 THEN 1 ELSE 0 END AS n_blocks,
  CAST((((f % 100 - 1) // 2 + 1 - 1) // 2 + 1 - 1) // 2 + 1 + f // 100 * 13 AS INTEGER) AS positions FROM s WHERE f % 100 > 0""")
def model_sizes(spark, d):
    n = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", (20 + n % 3000).cast("int").alias("w"), (20 + n * 7 % 2500).cast("int").alias("h"), (n % 977).cast("int").alias("f")).where("f % 100 > 0")
    return rows.select("event_id", sizes.padded_size(F.col("w"), F.col("h"))["width"].alias("padded"), sizes.line_width(F.col("w"), F.col("h"), F.lit(2.5))["resized"].alias("resized"), F.size(sizes.block_ranges(F.col("f"), 3)).alias("n_blocks"), sizes.sound_positions(F.col("f")).alias("positions"))


# Vectors ---------------------------------------------------------------------------------------------------------

V = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
SQL_UNARY = {"sigmoid": "1 / (1 + exp(-x))", "tanh": "(exp(2 * x) - 1) / (exp(2 * x) + 1)", "exp": "exp(x)", "sin": "sin(x)", "cos": "cos(x)", "neg": "-x", "abs": "abs(x)"}
SQL_POSITIVE = {"log": "ln(abs(x) + 1)", "sqrt": "sqrt(abs(x) + 1)", "rsqrt": "1 / sqrt(abs(x) + 1)"}
SQL_BINARY = {"add": "p[1] + p[2]", "sub": "p[1] - p[2]", "mul": "p[1] * p[2]", "max": "greatest(p[1], p[2])", "min": "least(p[1], p[2])"}


@query("SELECT vec_id, " + ", ".join([*(f"round(list_sum(list_transform(v, lambda x: {e})), 6) AS {n}" for n, e in (SQL_UNARY | SQL_POSITIVE).items()), *(f"round(list_sum(list_transform(list_zip(v, list_reverse(v)), lambda p: {e})), 6) AS b_{n}" for n, e in SQL_BINARY.items())]) + f" FROM ({V})")
def vector_functions(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    lifted = F.transform("v", lambda x: F.abs(x) + 1.0)
    cols = [F.round(arrays.total(arrays.map_unary(lifted if n in SQL_POSITIVE else F.col("v"), n)), 6).alias(n) for n in SQL_UNARY | SQL_POSITIVE]
    return rows.select("vec_id", *cols, *(F.round(arrays.total(arrays.map_binary(F.col("v"), F.reverse("v"), n)), 6).alias(f"b_{n}") for n in SQL_BINARY))


@query(f"""
SELECT vec_id, round(list_sum(list_transform(v, lambda x: least(greatest(x, -0.1), 0.1))), 9) AS clipped, round(list_sum(list_transform(list_zip(v, list_reverse(v)), lambda p: p[1] * p[2])), 6) AS dot, round(v[1] / sqrt(list_avg(list_transform(v, lambda x: x * x)) + 1e-6), 6) AS rms,
  [v[4], v[1]] AS taken, CAST(floor(len(v) / 16) AS INTEGER) AS n_rows, v[17] AS transposed, len(v) + 5 AS padded, list_transform(list_sort(list_transform(range(1, 9), lambda i: {{'x': v[i], 'i': i - 1}})), lambda s: CAST(s.i AS INTEGER)) AS argsort,
  [1, 2, 15, 0] AS low, CAST((len(v) + 2 - 3) // 2 + 1 AS INTEGER) AS conv FROM ({V})""")
def vector_shapes(spark, d):
    v = F.col("v")
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    grid = arrays.reshape(v, 16)
    return rows.select("vec_id", F.round(arrays.total(arrays.clip(v, -0.1, 0.1)), 9).alias("clipped"), F.round(arrays.dot(v, F.reverse(v)), 6).alias("dot"), F.round(F.get(arrays.rms_norm(v), F.lit(0)), 6).alias("rms"), arrays.take(v, F.array(F.lit(3), F.lit(0))).alias("taken"), F.size(grid).alias("n_rows"), F.get(F.get(arrays.transpose(grid), F.lit(0)), F.lit(1)).alias("transposed"), F.size(arrays.pad(v, 2, 3)).alias("padded"), arrays.argsort(F.slice(v, 1, 8)).alias("argsort"), F.slice(arrays.unpacked(F.array(F.lit(0x00000F21)), 4), 1, 4).alias("low"), arrays.conv_length(F.size(v)).alias("conv"))


# Languages -------------------------------------------------------------------------------------------------------

CODES = ["fr", "zh-Hans", "en", "en-orig", "zh_TW", "English", "ai-zh", "de-original"]


@query(f"""
WITH c AS (SELECT page_id, {CODES}[CAST(page_id % {len(CODES)} AS INTEGER) + 1] AS code FROM pages)
SELECT page_id, CASE WHEN regexp_matches(lower(replace(code, '_', '-')), '^(en|english)$|^(ai-)?en-') THEN 'en' WHEN regexp_matches(lower(replace(code, '_', '-')), '^(zh|chinese)$|^ai-zh|^(ai-)?zh-') THEN 'zh' END AS family, contains(lower(code), 'orig') AS original,
  list_filter({list(languages.FORMATS)}, lambda f: list_contains(CASE page_id % 3 WHEN 0 THEN ['srt', 'x', 'json3'] WHEN 1 THEN ['vtt', 'vtt', 'ttml'] ELSE [] END, f)) AS formats FROM c""")
def language_codes(spark, d):
    n = F.col("page_id")
    code = F.get(F.array(*(F.lit(c) for c in CODES)), (n % len(CODES)).cast("int"))
    listed = F.when(n % 3 == 0, F.array(*(F.lit(x) for x in ("srt", "x", "json3")))).when(n % 3 == 1, F.array(*(F.lit(x) for x in ("vtt", "vtt", "ttml")))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "pages").select("page_id", languages.family(code).alias("family"), languages.is_original(code).alias("original"), languages.ranked_formats(listed).alias("formats"))
