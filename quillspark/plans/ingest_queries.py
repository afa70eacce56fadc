"""Registered queries of sources, sinks, text functions and chunk files, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import html
from quillspark.functions import text as T
from quillspark.operators import ann, chunk, search, tags, validate
from quillspark.plans.queries import _HEADERS, _LINE_SQL, _LINES, _WS, _ends, _headers, _line_table, _ranges, _rounded, _squeezed, _vector_index, _vector_queries, _words, query, table
from quillspark.session import scratch_path, stored
from quillspark.sources import readers, sinks

_NL = "chr(10)"


# ---- files ----------------------------------------------------------------------------------


@query("SELECT url FROM pages")
def url_lines(spark, sf_dir):
    """A file of URLs with comments and blank lines, read back."""
    path = scratch_path(spark, "urls")
    rows = table(spark, sf_dir, "pages").select(F.explode(F.array(F.concat(F.lit("# page "), "page_id"), F.lit(""), F.concat(F.lit("  "), "url", F.lit(" ")))).alias("value"))
    rows.write.text(path)
    return readers.url_list(spark, path)


@query("SELECT url, CASE WHEN page_id % 10 <> 0 THEN '<p>' || url || '</p>' END AS html, CASE WHEN page_id % 10 = 0 THEN 'ValueError: no such page' END AS error FROM pages")
def fetched_pages(spark, sf_dir):
    """Pages had from a stand-in for the web, some of which fail."""
    rows = table(spark, sf_dir, "pages").select(F.concat(F.col("url"), F.when(F.col("page_id") % 10 == 0, "\n").otherwise("")).alias("url"))

    def get(url: str) -> str:
        if url.endswith("\n"):
            raise ValueError("no such page")
        return f"<p>{url}</p>"

    return readers.fetched(rows, get).withColumn("url", F.rtrim(F.replace("url", F.lit("\n"), F.lit(""))))


@query("SELECT n_name AS title, '<title>' || n_name || '</title><p>' || n_nationkey || '</p>' || chr(10) AS html FROM nation")
def local_html(spark, sf_dir):
    """Local pages, one file each."""
    path = scratch_path(spark, "html")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("<title>"), "n_name", F.lit("</title><p>"), F.col("n_nationkey").cast("string"), F.lit("</p>")).alias("value"), "n_nationkey")
    rows.write.partitionBy("n_nationkey").text(path)
    return readers.html_files(spark, path).select(html.title_of("html").alias("title"), "html")


_FOLDERS = ("poem", "analysis", "bio", "ana")


@query(f"SELECT CASE item_id % 4 WHEN 0 THEN 'poem' WHEN 2 THEN 'bio' ELSE 'analysis' END AS type, string_agg(replace(replace(coalesce(text, ''), chr(13), ' '), {_NL}, ' ') || {_NL}, '' ORDER BY item_id) AS text FROM benchmark GROUP BY item_id % 4, type")
def text_tree(spark, sf_dir):
    """Folders of texts below one root; a folder of no known type counts as analysis."""
    path = scratch_path(spark, "tree")
    items = table(spark, sf_dir, "benchmark")
    for k, folder in enumerate(_FOLDERS):
        one = items.where(F.col("item_id") % 4 == k).coalesce(1).sortWithinPartitions("item_id")
        one.select(F.translate(F.coalesce("text", F.lit("")), "\r\n", "  ").alias("value")).write.text(f"{path}/{folder}")
    return readers.text_files(spark, path).select("type", "text")


_TYPES = ("poem", "analysis", "summary", "bio")


@query(f"""SELECT type || '::d' || doc_id || '::' || (idx - 1) AS id, type, 'd' || doc_id AS source, text FROM (SELECT doc_id, type, unnest(p) AS text, unnest(range(1, len(p) + 1)) AS idx FROM (
    SELECT doc_id, ['poem', 'analysis', 'summary', 'bio'][doc_id % 4 + 1] AS type, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n{_WS}*\\n'), lambda x: {_squeezed('x')}), lambda x: len(string_split(x, ' ')) >= 18) AS p FROM documents WHERE doc_id % 4 < 2))""")
def folder_corpus(spark, sf_dir):
    """Paragraphs of the files of two included types."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (i % 4 + 1).cast("int"))
    files = d.select(F.concat(kind, F.lit("/d"), i, F.when(i % 3 == 0, ".md").otherwise(".txt")).alias("path"), kind.alias("type"), F.concat(F.lit("d"), i).alias("stem"), "text")
    return readers.corpus(files, ("poem", "analysis")).select("id", "type", "source", "text")


def _chunk_files(spark, sf_dir) -> DataFrame:
    """Documents as chunk files: a header line and the body."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("c"), i)).alias("id"), "source", F.concat(F.lit("s"), i).alias("source_id"), F.when(i % 2 == 0, "poem").otherwise("bio").alias("type"),
        (i % 9).cast("int").alias("line_start"), F.array("lang", "source", "lang").alias("tags"), F.coalesce("text", F.lit("")).alias("text"),
    )
    texts = sinks.chunk_text(rows, ["id", "source", "source_id", "type", "line_start", "tags"])
    return texts.select(F.regexp_extract("value", '"source_id":"(s-?[0-9]+)"', 1).alias("stem"), F.when(F.col("value").contains('"line_start":7'), F.replace("value", F.lit("###META### {"), F.lit("###META### broken {"))).otherwise(F.col("value")).alias("text"))


def _chunk_sql(least: int) -> str:
    t = _ends("coalesce(text, '')")
    return f"""SELECT CASE WHEN doc_id % 5 = 0 OR doc_id % 9 = 7 THEN 's' || doc_id ELSE 'c' || doc_id END AS id, {t} AS text, doc_id % 9 <> 7 AS parsed, CASE WHEN doc_id % 9 <> 7 THEN CASE WHEN doc_id % 2 = 0 THEN 'poem' ELSE 'bio' END END AS type,
        CASE WHEN doc_id % 9 <> 7 THEN (doc_id % 9)::INTEGER END AS line_start, CASE WHEN doc_id % 9 <> 7 THEN lang || ',' || source END AS tags FROM documents WHERE {t} <> '' AND {_words('text')} >= {least}"""


def _parsed(files: DataFrame, **options) -> DataFrame:
    return readers.parse_chunks(files, **options).select("id", "text", "parsed", "meta.type", "meta.line_start", F.array_join("meta.tags", ",").alias("tags"))


@query(_chunk_sql(5))
def chunk_files(spark, sf_dir):
    """Chunk files read strictly: some headers are broken, short bodies are dropped."""
    return _parsed(_chunk_files(spark, sf_dir))


@query(_chunk_sql(0))
def chunk_files_loose(spark, sf_dir):
    return _parsed(_chunk_files(spark, sf_dir), min_words=0)


def _raw_lines(spark, sf_dir) -> DataFrame:
    raw = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.explode(F.split("text", "\n")).alias("line"), F.col("text"))
    return raw.select((F.col("pos") * 1000 + F.row_number().over(Window.partitionBy("pos").orderBy(F.expr("instr(text, line)"), "line"))).alias("pos"), "line")


@query(f"WITH {_LINE_SQL} SELECT pos, line FROM clean WHERE regexp_matches(line, '[A-Za-zÀ-ỹ]')")
def poem_fallback(spark, sf_dir):
    """A work without lines of its own falls back on its chunks' lines."""
    raw = _raw_lines(spark, sf_dir)
    return readers.poem_lines(raw.where("line is null"), raw)


@query("SELECT n_nationkey::BIGINT AS place, lower(n_name) || ',' || n_name AS patterns, n_name AS answer FROM nation")
def facts_json(spark, sf_dir):
    """A JSON array of facts in one file."""
    path = scratch_path(spark, "facts")
    fact = F.struct(F.col("n_nationkey").cast("bigint").alias("place"), F.array(F.lower("n_name"), F.col("n_name")).alias("patterns"), F.col("n_name").alias("answer"))
    table(spark, sf_dir, "nation").agg(F.to_json(F.sort_array(F.collect_list(fact))).alias("value")).coalesce(1).write.text(path)
    rows = readers.json_array(spark, path, "place bigint, patterns array<string>, answer string")
    return rows.select("place", F.array_join("patterns", ",").alias("patterns"), "answer")


@query(f"""SELECT doc_id, 0 AS place, source AS title, 'body: ' || {_squeezed('text')} AS body FROM documents WHERE {_squeezed('text')} <> '' UNION ALL SELECT doc_id, 1, lang, '' FROM documents WHERE {_squeezed('text')} <> ''""")
def outline_sections(spark, sf_dir):
    """Second-level sections of Markdown with a preamble."""
    rows = table(spark, sf_dir, "documents").where(T.squeeze("text") != "")
    md = F.concat(F.lit("# top\n\n## "), "source", F.lit("\nbody: "), T.squeeze("text"), F.lit("\n\n##  "), "lang", F.lit("\n"))
    return readers.sections(rows.select("doc_id", md.alias("text")))


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines(spark, sf_dir):
    """Records written as JSON lines and read in seeded order."""
    path = scratch_path(spark, "lines")
    sinks.json_lines(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path)
    return readers.json_lines(spark, path, "conv_id bigint, turn bigint, role string, text string", seed=42, key="text")


_CRLF = "replace(coalesce(text, ''), chr(10), chr(13) || chr(10))"


def _norm_crlf(x: str) -> str:
    return _ends(f"regexp_replace(regexp_replace(regexp_replace(replace(nfc_normalize({x}), chr(160), ' '), '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _with_crlf(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\r\n")))


@query(f"SELECT unnest(string_split({_norm_crlf(_CRLF)}, {_NL})) AS line FROM documents")
def text_sink(spark, sf_dir):
    """Normalised texts as text files, read back by line."""
    path = scratch_path(spark, "texts")
    sinks.text(_with_crlf(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# ---- text functions -------------------------------------------------------------------------


@query(f"""SELECT doc_id, {_ends("regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '') || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'end'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g')")} AS markdown FROM documents""")
def clean_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("md", F.concat(F.coalesce("text", F.lit("")), F.lit("  \n\n\n\nend")))
    return rows.select("doc_id", T.clean_markdown("md").alias("markdown"))


@query(f"SELECT doc_id, {_norm_crlf(_CRLF)} AS normal FROM documents")
def norm_text_crlf(spark, sf_dir):
    return _with_crlf(spark, sf_dir).select("doc_id", T.normalise_prose("text", line_ends=True).alias("normal"))


@query(f"""SELECT doc_id, {_ends(f"regexp_replace(regexp_replace(replace(nfc_normalize({_CRLF}), chr(160), ' '), '\\r\\n?', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g')")} AS normal FROM documents""")
def norm_poem(spark, sf_dir):
    return _with_crlf(spark, sf_dir).select("doc_id", T.normalise_poem("text").alias("normal"))


@query(f"""SELECT doc_id, coalesce(nullif(substr(lower(regexp_replace({_ends("regexp_replace(strip_accents(coalesce(text, '')), '[^a-zA-Z0-9\\-_.\\s]', '', 'g')")}, '\\s+', '-', 'g')), 1, 120), ''), 'source') AS slug FROM documents""")
def slug_names(spark, sf_dir):
    """File names from texts."""
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.coalesce("text", F.lit(""))).alias("slug"))


_SANE = f"regexp_replace(array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(replace(nfc_normalize(coalesce(text, '')), chr(160), ' '), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {_ends('x')}), lambda x: NOT regexp_full_match(x, '\\p{{Nd}}+')), lambda x: " + _ends(f"regexp_replace(regexp_replace(regexp_replace(x, '^\\p{{Nd}}+[.\\-:)]*{_WS}*', ''), '\\p{{Nd}}+', '', 'g'), '{_WS}{{2,}}', ' ', 'g')") + "), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, {_ends(_SANE)} || chr(10) AS text, 'v1' AS version FROM documents")
def sanitised_version(spark, sf_dir):
    """Texts without numbers, written as a version beside others and read back."""
    root = scratch_path(spark, "versions")
    sinks.new_version(chunk.sanitise_numbers(table(spark, sf_dir, "documents").select("doc_id", "text")), root, "v1")
    return spark.read.parquet(root).select("doc_id", "text", "version")


@query(f"""WITH {_LINES}, b AS (SELECT doc_id, lines, unnest(range(0, len(lines), 3)) AS i FROM l WHERE len(lines) > 0)
    SELECT doc_id, i // 3 AS block, printf('%d_L%04d-%04d_', doc_id, i + 1, least(i + 4, len(lines))) || substr(sha1(array_to_string(lines[i + 1:i + 4], chr(10))), 1, 6) AS id FROM b""")
def poem_chunk_ids(spark, sf_dir):
    rows = chunk.line_windows(table(spark, sf_dir, "documents"), "doc_id").withColumn("source_id", F.col("doc_id").cast("string"))
    return rows.select("doc_id", F.col("block").cast("bigint").alias("block"), chunk.chunk_id("source_id", "text", poem=True).alias("id"))


@query(f"""WITH {_LINE_SQL}, c AS (SELECT min(n) AS a, max(n) AS b, string_agg(text, chr(10) ORDER BY n) AS text FROM lines GROUP BY (n - 1) // 2) SELECT printf('poem::%04d-%04d', a, b) AS doc_id, text, 'poem' AS type, a AS line_start, b AS line_end FROM c""")
def couplet_docs(spark, sf_dir):
    pairs = chunk.couplets(chunk.motifs_of(_line_table(spark, sf_dir), _ranges(spark, sf_dir)))
    return chunk.couplet_documents(pairs).select("doc_id", "text", "metadata.type", F.col("metadata.line_start").cast("bigint").alias("line_start"), F.col("metadata.line_end").cast("bigint").alias("line_end"))


#: A phrase for each kind of pattern of the literary dictionary, and the tags it gets.
_PHRASES = [
    ("Thúy  Kiều và Kim Trọng", "char:kim_trong,char:thuy_kieu"), ("thúy vân", "char:thuy_van"), ("Từ Hải, Hoạn Thư", "char:hoan_thu,char:tu_hai"), ("mã giám sinh và sở khanh", "char:ma_giam_sinh,char:so_khanh"), ("tú bà", "char:tu_ba"),
    ("sư Giác Duyên", "char:giac_duyen,theme:tinh_yeu"), ("đạm tiên", "char:dam_tien"), ("vuong quan", "char:vuong_quan"), ("bút pháp tượng trưng", "device:uoc_le"), ("hoa cười, liễu hờn", "device:uoc_le"), ("chỉ có hoa", ""),
    ("điển tích hay", "device:dien_co"), ("phép ẩn dụ", "device:an_du"), ("nhân hóa", "device:nhan_hoa"), ("tả cảnh ngụ tình", "device:ta_canh_ngu_tinh"), ("phúng dụ", "device:phung_du"), ("tài mệnh tương đố", "theme:tai_menh"), ("chữ tâm", "theme:chu_tam"),
    ("nhân đạo", "theme:nhan_dao"), ("tình yêu", "theme:tinh_yeu"), ("bạc mệnh", "theme:so_phan"), ("gia biến", "theme:gia_bien"), ("Trao duyên", "section:trao_duyen,theme:tinh_yeu"), ("chí khí anh hùng", "section:chi_khi_anh_hung"),
    ("thúy kiều báo ân", "char:thuy_kieu,section:bao_an_bao_oan"), ("gặp Kim Trọng", "char:kim_trong,section:gap_kim_trong"), ("không có gì", ""),
]


@query("SELECT o_orderkey AS query_id, array_to_string(list_sort(list_filter(string_split([" + ", ".join(f"'{t}'" for _, t in _PHRASES) + f"][(o_orderkey % {len(_PHRASES)})::INT + 1] || ',type:' || lower(o_orderstatus), ','), lambda x: x <> '')), ',') AS tags FROM orders")
def tag_literary(spark, sf_dir):
    """The literary dictionary over phrases written from orders."""
    at = (F.col("o_orderkey") % len(_PHRASES) + 1).cast("int")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.element_at(F.array(*[F.lit(p) for p, _ in _PHRASES]), at).alias("text"), F.lower("o_orderstatus").alias("type"))
    return tags.with_tags(rows).select("query_id", F.array_join("tags", ",").alias("tags"))


_REASON = """CASE verdict WHEN 'basic' THEN CASE doc_id % 11 WHEN 1 THEN 'no id' WHEN 3 THEN 'no source' WHEN 4 THEN 'unknown type' ELSE 'tags is not a list' END
    WHEN 'poem' THEN CASE doc_id % 11 WHEN 6 THEN 'line_start is not an integer' WHEN 7 THEN 'line_start < 1' WHEN 8 THEN 'line_end < line_start' ELSE 'id is not of the poem pattern' END
    ELSE CASE WHEN cs < 0 THEN 'char_start < 0' ELSE 'char_end <= char_start' END END"""


@query(f"WITH {_HEADERS.replace('h AS (SELECT ', 'h AS (SELECT doc_id, ', 1)} SELECT id, verdict, {_REASON} AS reason FROM v WHERE verdict <> 'ok' ORDER BY id, reason LIMIT 40")
def validation_errors(spark, sf_dir):
    """The first errors of a report."""
    return validate.shown_errors(_headers(table(spark, sf_dir, "documents")))


@query()
def ann_topk(spark, sf_dir):
    """Nearest vectors from the stored index, beside each query's recall against all rows and the share
    of rows whose originals were scored at most."""
    docs, asked = _vector_index(spark, sf_dir), _vector_queries(spark, sf_dir)
    index = ann.build(docs, scratch_path(spark, "vectorindex"))
    found = stored(ann.topk(asked, index, 10), "found")
    exact = search.vector_topk(asked, docs, 10).select("query_id", "doc_id")
    recall = exact.join(found.select("query_id", "doc_id").withColumn("_hit", F.lit(1)), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
    share = F.lit(min(1.0, max(10, min(int(index.rows * ann.SCORED), ann.TIMES * 10)) / max(index.rows, 1)))
    return _rounded(found).join(recall, "query_id").withColumn("scored_share", F.round(share, 6))
