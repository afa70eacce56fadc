"""Registered queries of the operators, one for each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bagminhash, centroids, chat, collisions, decontam, licenses, mixing, phrases, quality, sharding, simhash, token_store, toxicity
from quillspark.llm.common import read_table

TOKENIZER = "byte_bpe_50k.json"
SMALL_SHARD = 256 << 10
#: A conversation that holds its template's control strings, beside those of the table.
TRAP = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "depth", "shard", "shard_bytes")


def shards_of_256k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharding with a limit at which tables of any size split."""
    return sharding.shard(read_table(spark, sf_dir, "documents").select("doc_id", "text"), limit=SMALL_SHARD).select("doc_id", "n_bytes", "depth", "shard", "shard_bytes")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_edits(read_table(spark, sf_dir, "documents"))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    return token_store.round_trip(read_table(spark, sf_dir, "documents"), tokenizer)


def op5_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.account(read_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(rows.union(spark.createDataFrame(TRAP, "conv_id bigint, turn bigint, role string, text string")))


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(read_table(spark, sf_dir, "documents"))


def op11_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


def op12_pivot_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op13_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.search(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_extendible_sharding, op2_simhash, op3_quality_fm, op4_token_store, op5_entropy_mix, op6_chat_format, op7_bagminhash, op8_decontaminate, op9_toxicity, op10_license_scan,
            op11_weighted_lloyd, op12_pivot_phrases, op13_collision_search, shards_of_256k,
        )
    }


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def _escaped(column: str) -> str:
    out = f"coalesce({column}, '')"
    for plain, code in chat.ESCAPES:
        out = f"replace({out}, '{plain}', '{code}')"
    return out


def _sharding_sql(limit: int) -> str:
    return f"""
            WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS bits FROM documents),
            level AS (SELECT depth, bits >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM d, (SELECT unnest(range(0, 25))::INTEGER AS depth) GROUP BY ALL),
            fit AS (SELECT doc_id, n_bytes, level.*, row_number() OVER (PARTITION BY doc_id ORDER BY level.depth) AS nth
                    FROM d JOIN level ON bits >> (60 - depth) = prefix WHERE shard_bytes <= {limit})
            SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '*' ELSE lpad(bin(prefix), depth, '0') END AS shard, shard_bytes FROM fit WHERE nth = 1"""


def _lloyd_sql() -> str:
    nearest = lambda a, q, c: f"{a} AS MATERIALIZED (SELECT r, any_value(v) AS v, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM (SELECT r, q.v, c, list_sum(list_transform(list_zip(q.v, {c}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM {q} q, {c}) GROUP BY r)"
    steps = []
    for k in range(centroids.ROUNDS):
        steps.append(nearest(f"a{k}", "q", f"c{k}"))
        steps.append(f"""m{k} AS MATERIALIZED (SELECT c, list((s - (s % n + n) % n) // n ORDER BY j) AS v FROM (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{k}) GROUP BY ALL) GROUP BY c),
            c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (c))""")
    last = centroids.ROUNDS
    return f"""
            WITH q AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
                       WHERE len(embedding) = {centroids.WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.WIDTH}),
            c0 AS MATERIALIZED (SELECT c::INTEGER AS c, v FROM (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id), v) - 1 AS c, v FROM q) WHERE c < {centroids.CLUSTERS}),
            {', '.join(steps)}, {nearest('a', 'q', f'c{last}')},
            total AS (SELECT c, sum(d) AS i FROM a GROUP BY c)
            SELECT q.vec_id, a.c AS cluster, a.d AS distance, total.i::BIGINT AS cluster_inertia, (SELECT sum(i) FROM total)::BIGINT AS inertia, sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256
            FROM a JOIN q USING (r) JOIN c{last} USING (c) JOIN total USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_extendible_sharding": _sharding_sql(sharding.SHARD_BYTES),
        "shards_of_256k": _sharding_sql(SMALL_SHARD),
        "op6_chat_format": f"""
            WITH rows AS (SELECT conv_id, turn, role, text FROM conversations
                          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
            t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows)
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
                   length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_chars,
                   sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
                   sum({len(chat.OPEN) + len(chat.CLOSE) + len(chat.END)} + length({_escaped('role')}) + length({_escaped('text')}))::BIGINT AS formatted_chars
            FROM t GROUP BY conv_id""",
        "op11_weighted_lloyd": _lloyd_sql(),
        "op12_pivot_phrases": rf"""
            WITH piece AS (SELECT lang, row_number() OVER () AS p, piece FROM (SELECT coalesce(lang, 'und') AS lang,
                               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
            w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM piece),
            total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
            gram AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {phrases.LONGEST + 1})) AS k) WHERE len(words) >= k)),
            f AS MATERIALIZED (SELECT lang, phrase, any_value(k) AS k, count(*)::BIGINT AS f FROM gram GROUP BY lang, phrase HAVING count(*) >= {phrases.LEAST}),
            cand AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1),
            cut AS (SELECT lang, phrase, a, c, array_to_string(words[:c], ' ') AS one, array_to_string(words[c + 1:], ' ') AS two FROM (SELECT *, unnest(range(1, len(words))) AS c FROM cand)),
            score AS (SELECT cut.lang, cut.phrase, a, c, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = one JOIN f y ON y.lang = cut.lang AND y.phrase = two),
            low AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
            inner_of AS (SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, max(a) AS most
                         FROM (SELECT lang, a, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM cand, (SELECT unnest(range(2, {phrases.LONGEST})) AS k) WHERE len(words) > k) GROUP BY ALL),
            kept AS (SELECT low.* FROM low LEFT JOIN inner_of USING (lang, phrase) WHERE most IS NULL OR 100 * most < {phrases.SHARE} * a),
            best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
            SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM best JOIN total USING (lang) WHERE rank <= {phrases.TOP}""",
        "op7_bagminhash": f"""
            WITH RECURSIVE w AS (SELECT doc_id, text, {_WORDS} AS words FROM documents),
            s AS (SELECT doc_id, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w WHERE len(words) > 0),
            bag AS (SELECT doc_id, shingle, count(*) AS n FROM s GROUP BY ALL),
            total AS (SELECT doc_id, sum(n) AS n FROM bag GROUP BY ALL),
            class_of AS (SELECT doc_id, md5(string_agg(shingle || '/' || n, '|' ORDER BY shingle)) AS k FROM bag GROUP BY doc_id
                         UNION ALL SELECT doc_id, 'bytes ' || translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM w WHERE len(words) = 0),
            member AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS copy_of FROM class_of),
            rep AS (SELECT bag.* FROM bag JOIN member USING (doc_id) WHERE doc_id = copy_of),
            both_of AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS n FROM rep a JOIN rep b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
            link AS (SELECT x, y FROM both_of JOIN total p ON p.doc_id = x JOIN total q ON q.doc_id = y WHERE both_of.n / (p.n + q.n - both_of.n) >= 0.8),
            reach(x, y) AS (SELECT DISTINCT copy_of, copy_of FROM member UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
            SELECT member.doc_id, least_of.c AS class_id, copy_of FROM member JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) least_of ON copy_of = least_of.x""",
        "op8_decontaminate": f"""
            WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
            b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS words FROM benchmark),
            item_window AS (SELECT DISTINCT item, least(13, len(words)) AS k, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS w
                            FROM (SELECT item, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
            sizes AS (SELECT DISTINCT k FROM item_window),
            doc_window AS (SELECT doc_id, k, i, array_to_string(words[i:i + k - 1], ' ') AS w FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, sizes WHERE len(words) >= k)),
            hit AS (SELECT doc_id, k, i, item FROM doc_window JOIN item_window USING (k, w)),
            word_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hit)) GROUP BY doc_id),
            items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
            SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(word_hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.list, '')) AS items_sha256,
                   coalesce(word_hit.n, 0) > 0 AND 20 * coalesce(word_hit.n, 0) >= len(words) AS contaminated
            FROM d LEFT JOIN word_hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    }
