"""Registered queries of routing, line look-ups, quotations, prompts, answers and training records,
each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunk, embed, evaluate, fuse, lines, prompt, route, textindex, verify
from quillspark.plans import answers, retrieval
from quillspark.plans.queries import _BM25, _LABEL, _LINE_SQL, _SIDES, _canon, _ends, _items, _labelled, _line_table, _ranges, _sentences, _squeezed, _text_index, _vector_index, query, table
from quillspark.session import scratch_path, stored
from quillspark.streaming.cache import stream_hits

_NL = "chr(10)"


def _hits(spark, sf_dir, k: int) -> DataFrame:
    return textindex.topk(_items(spark, sf_dir), _text_index(spark, sf_dir), k)


# ---- search and fusion ----------------------------------------------------------------------


@query(f"""WITH {_SIDES}, b AS (SELECT query_id, doc_id, rank AS was, rrf + CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 0 END AS score FROM fr WHERE rank <= 10)
    SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was, doc_id) AS rank FROM b""")
def hybrid_boosted(spark, sf_dir):
    """Both sides always fused, then one type's scores raised."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    docs = table(spark, sf_dir, "documents").join(vectors, "doc_id", "full")
    asked = _items(spark, sf_dir).join(vectors.withColumnRenamed("doc_id", "query_id"), "query_id", "left")
    hits = retrieval.hybrid_search(asked, docs, 10, always=True, index=_text_index(spark, sf_dir)).withColumn("type", F.when(F.col("doc_id") % 4 == 0, "poem").otherwise("bio"))
    return fuse.type_boost(hits, rerank=True).select("query_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _variants_of(asked: str, name: str, aliases: tuple[str, ...]) -> list[str]:
    """All forms of a question that names one entity."""
    every = [asked, T.plain(asked)] + [x for a in (name, *aliases) for x in (a, T.plain(a))] + [q.format(name=name, first=name.split()[0]) for q in fuse.ENTITY_QUESTIONS]
    out: dict[str, str] = {}
    for x in every:
        out.setdefault(x.lower(), x)
    return list(out.values())


_NAMED = ["Từ Hải là ai", "tài sắc của Kim Trọng"]
_FORMS = [_variants_of(_NAMED[0], "từ hải", fuse.ENTITIES["từ hải"]), _variants_of(_NAMED[1], "kim trọng", fuse.ENTITIES["kim trọng"])]


@query(f"""SELECT item_id AS query_id, variant - 1 AS variant, v[variant] AS text FROM (SELECT item_id, v, unnest(range(1, len(v) + 1)) AS variant FROM (
        SELECT item_id, CASE WHEN {_squeezed('text')} = '' THEN [] WHEN lower(strip_accents({_squeezed('text')})) <> lower({_squeezed('text')}) THEN [{_squeezed('text')}, strip_accents({_squeezed('text')})] ELSE [{_squeezed('text')}] END AS v FROM benchmark
        UNION ALL SELECT -n_nationkey - 1, CASE WHEN n_nationkey % 2 = 0 THEN [{', '.join(f"'{x}'" for x in _FORMS[0])}] ELSE [{', '.join(f"'{x}'" for x in _FORMS[1])}] END FROM nation))""")
def query_variants(spark, sf_dir):
    """Variants of all items, and of questions that name an entity."""
    n = F.col("n_nationkey").cast("bigint")
    named = table(spark, sf_dir, "nation").select((-n - 1).alias("query_id"), F.when(n % 2 == 0, f"  {_NAMED[0]} ").otherwise(_NAMED[1]).alias("query"))
    out = fuse.variants(_items(spark, sf_dir).unionByName(named))
    return out.select("query_id", F.col("variant").cast("bigint").alias("variant"), "text")


@query(f"WITH {_BM25} SELECT query_id, doc_id, rank FROM br WHERE rank <= 3")
def evidence(spark, sf_dir):
    return fuse.evidence(_hits(spark, sf_dir, 10), 3).select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_BM25} SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS ids FROM br WHERE rank <= 5 GROUP BY query_id")
def gold_ids(spark, sf_dir):
    """Ids of the first hits of each question, for labelling by hand."""
    got = _hits(spark, sf_dir, 5).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d")))).alias("h"))
    return got.select("query_id", F.array_join(F.transform("h", lambda x: x.d), ",").alias("ids"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, substr(regexp_replace(coalesce(text, ''), '[\\s\\x0b]+', ' ', 'g'), 1, 320) AS snippet FROM br JOIN documents USING (doc_id) WHERE rank <= 5")
def snippets(spark, sf_dir):
    return evaluate.snippets(_hits(spark, sf_dir, 5), table(spark, sf_dir, "documents")).select("query_id", "doc_id", "snippet")


# ---- routing --------------------------------------------------------------------------------

#: A request for each branch of the routes, and its intent.
_REQUESTS = [
    ("  ", "chitchat"), ("Chào bạn", "chitchat"), ("Trích 10 câu đầu", "poem"), ("so sánh câu 1 với câu 5", "poem"), ("câu 3-9", "poem"), ("từ câu 2 đến câu 8 nhé", "poem"), ("Câu số 7 là gì", "poem"), ("Liệt kê 5 ý chính", "facts"),
    ("tóm tắt: truyện", "facts"), ("Có hay không?", "chitchat"), ("có phải bài này được viết vào đầu thế kỷ không?", "domain"), ("2 + 3 = ?", "generic"), ("12*4=", "generic"), ("Ai là tác giả của truyện?", "domain"),
]


def _written(spark, sf_dir, texts: list[str]) -> DataFrame:
    """(query_id, q): one of the texts for each order."""
    at = (F.col("o_orderkey") % len(texts) + 1).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.element_at(F.array(*map(F.lit, texts)), at).alias("q"))


@query("SELECT o_orderkey AS query_id, [" + ", ".join(f"'{x}'" for _, x in _REQUESTS) + f"][(o_orderkey % {len(_REQUESTS)})::INT + 1] AS intent FROM orders")
def route_requests(spark, sf_dir):
    """Requests written from orders: every intent by each of its branches."""
    return _written(spark, sf_dir, [q for q, _ in _REQUESTS]).select("query_id", route.intent("q").alias("intent"))


#: Requests with and without triggers: verse only, close reading.
_TRIGGERS = [("Trích nguyên văn đoạn này", True, False), ("Phân tích phép ẨN DỤ", False, True), ("nhịp điệu của câu thơ", True, True), ("thời tiết hôm nay", False, False), ("Lầu Ngưng Bích", True, False), ("a close reading please", False, True)]


@query(f"SELECT o_orderkey AS query_id, [{', '.join(str(a).lower() for _, a, _ in _TRIGGERS)}][(o_orderkey % {len(_TRIGGERS)})::INT + 1] AS poem_only, [{', '.join(str(b).lower() for _, _, b in _TRIGGERS)}][(o_orderkey % {len(_TRIGGERS)})::INT + 1] AS close_reading FROM orders")
def trigger_requests(spark, sf_dir):
    rows = _written(spark, sf_dir, [q for q, _, _ in _TRIGGERS])
    return rows.select("query_id", route.has_any("q", route.POEM_ONLY).alias("poem_only"), route.has_any("q", route.CLOSE_READING).alias("close_reading"))


@query("SELECT s_nationkey::BIGINT AS session_id, 'Name: ' || arg_max(CASE s_suppkey % 3 WHEN 0 THEN 'Mai' ELSE 'Lan Anh' END, s_suppkey) AS profile FROM supplier WHERE s_suppkey % 3 < 2 GROUP BY s_nationkey")
def session_profiles(spark, sf_dir):
    """The last name that each session's messages give."""
    k = F.col("s_suppkey") % 3
    said = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("session_id"), F.col("s_suppkey").alias("turn"), F.when(k == 0, "xin chào, tên mình là mai").when(k == 1, "Em là LAN anh").otherwise("trời đẹp quá").alias("text"))
    return route.profiles(said).select("session_id", route.rendered_profile("name").alias("profile"))


# ---- lines ----------------------------------------------------------------------------------


@query(f"WITH {_LINE_SQL} SELECT count(*) >= 100 AS ready FROM lines")
def lines_ready(spark, sf_dir):
    return spark.createDataFrame([(lines.ready(_line_table(spark, sf_dir)),)], "ready boolean")


@query(f"WITH {_LINE_SQL} SELECT n, text FROM lines WHERE n = 7")
def line_single(spark, sf_dir):
    return lines.single(_line_table(spark, sf_dir), 7).select(F.col("n").cast("bigint").alias("n"), "text")


@query(f"WITH {_LINE_SQL} SELECT n, text FROM lines WHERE n IN (SELECT n_nationkey * 3 FROM nation)")
def lines_chosen(spark, sf_dir):
    numbers = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3).alias("n"))
    return lines.chosen(_line_table(spark, sf_dir), numbers.union(numbers)).select(F.col("n").cast("bigint").alias("n"), "text")


@query(f"WITH {_LINE_SQL} SELECT min(n) AS start, max(n) AS \"end\", string_agg(text, chr(10) ORDER BY n) AS text FROM lines WHERE n IN (9, 10) HAVING count(*) > 0")
def couplet_containing(spark, sf_dir):
    pairs = chunk.couplets(chunk.motifs_of(_line_table(spark, sf_dir), _ranges(spark, sf_dir)))
    return lines.couplet_of(pairs, 9).select(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "text")


@query(f"""WITH {_LINE_SQL}, r AS (SELECT n_nationkey AS k, n_nationkey % 7 + 1 AS a, n_nationkey % 11 + 2 AS b FROM nation),
    want AS (SELECT k, unnest(CASE k % 4 WHEN 0 THEN range(1, a + 1) WHEN 1 THEN range(least(a, b), greatest(a, b) + 1) WHEN 2 THEN [a] ELSE [a, b] END) AS n FROM r)
    SELECT k::BIGINT AS query_id, string_agg(printf('%4d: %s', n, text), chr(10) ORDER BY n) AS answer FROM (SELECT DISTINCT k, n FROM want) JOIN lines USING (n) GROUP BY k""")
def verse_answers(spark, sf_dir):
    """Requests of all four kinds as they are written, answered from the line table."""
    k = F.col("n_nationkey")
    a, b = (k % 7 + 1).cast("string"), (k % 11 + 2).cast("string")
    asked = F.when(k % 4 == 0, F.concat(F.lit("trích "), a, F.lit(" câu đầu"))).when(k % 4 == 1, F.concat(F.lit("câu "), a, F.lit("-"), b)).when(k % 4 == 2, F.concat(F.lit("câu số "), a, F.lit(" là gì"))).otherwise(F.concat(F.lit("so sánh câu "), a, F.lit(" với câu "), b))
    r = table(spark, sf_dir, "nation").select(k.cast("bigint").alias("query_id"), route.verse_request(asked).alias("r")).select("query_id", "r.*")
    return lines.displayed(lines.answers(r, _line_table(spark, sf_dir)))


@query("SELECT (n_nationkey * 4 + 1) || '–' || (n_nationkey * 4 + 6) AS range, n_name AS motif FROM nation")
def motif_labels(spark, sf_dir):
    return lines.motif_overview(_ranges(spark, sf_dir))


# ---- quotations -----------------------------------------------------------------------------


def _quoted(spark, sf_dir, score) -> DataFrame:
    """Benchmark sentences quoted in other word order, in part or with a letter changed, against every
    sentence of the documents."""
    known = verify.canonical(_sentences(table(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("quote", "text"), "doc_id")
    words, kind = F.split(T.squeeze("quote"), " "), (F.col("item_id") + F.col("place")) % 3
    said = F.when(kind == 0, F.array_join(F.reverse(words), " ")).when(kind == 1, F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.ceil(F.size(words) * 0.6).cast("int"))), " ")).otherwise(F.translate("quote", "x", "y"))
    asked = _sentences(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", F.col("place").cast("bigint").alias("place"), said.alias("quote"))
    return verify.best_matches(asked, known, score).select("item_id", "place", F.round("score", 6).alias("score"), F.col("n").cast("bigint").alias("n"), "exact")


@query()
def quote_verify_tokens(spark, sf_dir):
    return _quoted(spark, sf_dir, verify.token_set_score)


@query()
def quote_verify_sequence(spark, sf_dir):
    return _quoted(spark, sf_dir, verify.sequence_score)


@query(f"""WITH {_LINE_SQL}, k AS (SELECT {_canon('text')} AS c, min(n) AS n FROM lines GROUP BY c HAVING c <> ''), q AS (SELECT n AS place, {_canon("regexp_replace(text, '[aeiou]', '', 'g')")} AS c FROM lines),
    s AS (SELECT q.place, k.n, 100.0 * (1 - levenshtein(q.c, k.c) / greatest(length(q.c), length(k.c))::DOUBLE) AS score FROM q, k WHERE q.c <> '')
    SELECT place, coalesce(round(score, 6), 0) AS score, n FROM q LEFT JOIN (SELECT place, max(score) AS score, arg_max(n, (round(score, 9), -n)) AS n FROM s GROUP BY place) USING (place)""")
def quote_nearest_line(spark, sf_dir):
    """Lines without their vowels: the nearest line and its likeness, below the threshold too."""
    known = stored(_line_table(spark, sf_dir), "lines")
    asked = known.select(F.col("n").cast("bigint").alias("place"), F.regexp_replace("text", "[aeiou]", "").alias("quote"))
    choices = verify.choices(known)
    out = verify.with_nearest(verify.best_matches(asked, choices), choices)
    return out.select("place", F.round("score", 6).alias("score"), F.col("n").cast("bigint").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 4 >= 2 THEN text || chr(10) || chr(10) || 'Some quotations could not be matched with the source; please check them.' ELSE text END AS text FROM conversations")
def warned_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumns({"bad": F.col("turn") % 4, "poem_only": F.col("role") == "user"})
    return verify.with_warning(rows, "bad", "poem_only").select("conv_id", "turn", "text")


# ---- prompts and answers --------------------------------------------------------------------

_WITHOUT = ("chitchat", "generic_short", "generic_medium", "generic_deep", "disambiguation", "compare")
_WITH = ("review", "claims", "counter", "quote_check", "outline", "argument", "summary", "biography", "device")


def _task_sql(task: str) -> str:
    asked = f"'{prompt.TASKS[task]}' || CASE WHEN text <> '' THEN {_NL} || {_NL} || '## Question' || {_NL} || text ELSE '' END"
    if task in _WITHOUT:
        return f"SELECT '{task}' AS task, item_id AS query_id, md5({asked}) AS prompt_md5 FROM benchmark"
    return f"""SELECT '{task}' AS task, item_id AS query_id, md5({asked} || CASE WHEN e IS NOT NULL THEN {_NL} || {_NL} || '## Excerpts' || {_NL} || e ELSE '' END) AS prompt_md5 FROM benchmark
        LEFT JOIN (SELECT query_id, string_agg(b, {_NL} || {_NL} ORDER BY rank) AS e FROM x WHERE rank <= {prompt.excerpts_allowed(task)} GROUP BY query_id) ON query_id = item_id"""


@query(f"WITH {_BM25}, x AS (SELECT query_id, rank, '(' || rank || ') [' || {_LABEL} || ']' || {_NL} || {_ends('text')} AS b FROM br JOIN documents USING (doc_id) WHERE rank <= 12 AND {_ends('text')} <> '') " + " UNION ALL ".join(_task_sql(t) for t in _WITHOUT + _WITH))
def task_prompts(spark, sf_dir):
    """Prompts of every task for all items, those of academic tasks with their excerpts."""
    docs = table(spark, sf_dir, "documents")
    hits = stored(_hits(spark, sf_dir, 12).join(_labelled(docs).select("doc_id", "label", "text"), "doc_id"), "hits")
    out = None
    for task in _WITHOUT + _WITH:
        made = prompt.task_prompts(_items(spark, sf_dir), task, hits if task in _WITH else None).select(F.lit(task).alias("task"), "query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))
        out = made if out is None else out.unionByName(made)
    return out


@query(f"""WITH {_BM25}, s AS (SELECT query_id, label, min(rank) AS r FROM (SELECT query_id, rank, {_LABEL} AS label FROM br JOIN documents USING (doc_id) WHERE rank <= 5) GROUP BY ALL), l AS (SELECT query_id, string_agg('- ' || label, {_NL} ORDER BY r, label) AS listed FROM s GROUP BY query_id)
    SELECT item_id AS query_id, text || CASE WHEN listed IS NULL THEN '' ELSE {_NL} || {_NL} || 'Sources' || {_NL} || listed END AS answer FROM benchmark LEFT JOIN l ON query_id = item_id""")
def answers_with_sources(spark, sf_dir):
    """Items as answers with the labels of their hits below."""
    docs = table(spark, sf_dir, "documents")
    found = fuse.sources(_hits(spark, sf_dir, 5).join(_labelled(docs).select("doc_id", "label"), "doc_id"))
    return prompt.with_sources(_items(spark, sf_dir).withColumnRenamed("query", "answer"), found)


def _finished(x: str) -> str:
    return _ends(f"regexp_replace(array_to_string(list_filter(string_split({x}, {_NL}), lambda l: NOT regexp_matches(l, '(?i)^' || '\\s*(source|sources|nguồn)\\s*:')), {_NL}), '\\n{{3,}}', {_NL} || {_NL}, 'g')")


@query(f"""WITH {_BM25}, n AS (SELECT query_id, string_agg({_finished('substr(text, 1, 60)')}, {_NL} || {_NL} ORDER BY rank) AS notes FROM br JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id)
    SELECT query_id, {_finished('substr(notes, 1, 60)')} AS answer FROM n""")
def map_reduce_notes(spark, sf_dir):
    """A note on each context and an answer from a question's notes, by a model that keeps 60 characters."""
    hits = _hits(spark, sf_dir, 5).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return prompt.map_reduce(hits, lambda: lambda texts: [t[:60] for t in texts]).select("query_id", "answer")


@query()
def answer_all_paths(spark, sf_dir):
    """Questions of all kinds, written from nations, answered by their paths."""
    k = F.col("n_nationkey")
    asked = [F.lit("Chào"), F.lit("2 + 3 = ?"), F.lit("câu số 7 là gì"), F.lit("so sánh câu 1 với câu 5"), F.lit("câu số 999999"), F.concat(F.lit("Ai viết về "), "n_name"), F.lit("Liệt kê 5 ý chính"), F.lit("Ai là tác giả"), F.concat(F.lit("Trích nguyên văn "), "n_name")]
    q = table(spark, sf_dir, "nation").select(k.cast("bigint").alias("query_id"), F.element_at(F.array(*asked), (k % len(asked) + 1).cast("int")).alias("question"), (k % 2 == 0).alias("long_answer"))
    facts = spark.createDataFrame([(1, ["ai viết"], "An answer by hand.", ["faq"])], "place int, patterns array<string>, answer string, sources array<string>")
    cache = spark.createDataFrame([("ai là tác giả|la=1|intent=domain", "A cached answer.")], "key string, answer string")
    docs = stored(embed.with_vectors(table(spark, sf_dir, "documents").select("doc_id", "text")), "passages")
    return answers.answer_all(q, facts, cache, _line_table(spark, sf_dir), docs, index=_text_index(spark, sf_dir))


@query("""
    WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
    r(user_id, n, until, hit) AS (SELECT user_id, n, t + 7200000000, false FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.n, CASE WHEN e.t < r.until THEN r.until ELSE e.t + 7200000000 END, e.t < r.until FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, count(*) AS looked_up, count(*) FILTER (hit) AS hits FROM r GROUP BY user_id""")
def cache_hits(spark, sf_dir):
    """Look-ups of an answer cache with expiry, folded over a stream of events."""
    path, out, at = (scratch_path(spark, x) for x in ("log", "hits", "progress"))
    table(spark, sf_dir, "events").where("user_id is not null and ts is not null").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(path)
    log = spark.readStream.schema("key bigint, ts timestamp").parquet(path)
    stream_hits(log).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("key bigint, ts timestamp, hit boolean").parquet(out)
    return found.groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("looked_up"), F.count_if("hit").alias("hits"))


# ---- training records -----------------------------------------------------------------------


@query(f"SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'be kind' || {_NL} || {_NL} ELSE '' END || coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN {_NL} || {_NL} || role ELSE '' END AS prompt, {_ends("'  ' || coalesce(text, '') || ' '")} AS response FROM conversations")
def sft_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "system", "be kind").otherwise("").alias("system"), F.coalesce("text", F.lit("")).alias("instruction"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("").alias("context"),
        F.concat(F.lit("  "), F.coalesce("text", F.lit("")), F.lit(" ")).alias("output"),
    )
    return prompt.sft_text(rows).select("conv_id", "turn", "prompt", "response")


_SFT_TAGS = sorted({t for _, tags, _ in evaluate.TEMPLATES for t in tags})
_SFT_LIST = "[" + ", ".join(f"'{t}'" for t in _SFT_TAGS) + "]"
_TEMPLATE_ROWS = ", ".join("({}, '{}', [{}])".format(i, text.replace("'", "''"), ", ".join(f"'{t}'" for t in tags)) for i, (text, tags, _) in enumerate(evaluate.TEMPLATES))


@query(f"""WITH r(request_id, instruction, req) AS (VALUES {_TEMPLATE_ROWS}), c AS (SELECT doc_id AS place, list_distinct([{_SFT_LIST}[(doc_id % {len(_SFT_TAGS)})::INT + 1], {_SFT_LIST}[(doc_id * 7 % {len(_SFT_TAGS)})::INT + 1]]) AS tags, text FROM documents),
    s AS (SELECT request_id, place, text, len(list_intersect(tags, req)) AS score FROM r, c WHERE len(list_intersect(tags, req)) > 0), t AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, place) AS nth FROM s),
    j AS (SELECT request_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY nth) AS x FROM t WHERE nth <= 2 GROUP BY request_id)
    SELECT 'be exact' AS system, instruction, CASE WHEN length(x) > 900 THEN substr(x, 1, 900) || '…' ELSE coalesce(x, '') END AS context, '' AS output, array_to_string(req, ',') AS tags FROM r LEFT JOIN j USING (request_id)""")
def sft_records(spark, sf_dir):
    """Training records of all templates with contexts that share their tags."""
    tag = lambda k: F.element_at(F.array(*map(F.lit, _SFT_TAGS)), (k % len(_SFT_TAGS) + 1).cast("int"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), F.array(tag(F.col("doc_id")), tag(F.col("doc_id") * 7)).alias("tags"), "text")
    templates = evaluate.template_table(spark)
    out = evaluate.sft_records(templates, evaluate.pick_contexts(templates, chunks), "be exact")
    return out.select("system", "instruction", "context", "output", F.array_join("tags", ",").alias("tags"))
