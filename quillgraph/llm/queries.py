"""The registered queries of the operators and their SQL for the driver's comparison.

SQL has no tokenizer, no MinHash, no random forest, no random field, no fused language model and no draws of a splitting tree: those
queries are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit, chat, fingerprint, langid, line_crf, mixing, packing, quality, ranked, secrets, shard, url_filter
from .common import read
from .near_dedup import near_duplicates

URL_RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]
#: A conversation whose texts look like control strings.
TRICKY = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign_shards(read(spark, sf_dir, "documents"), 16)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.examples(convs.unionByName(more)))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents")).drop("ids")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(read(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 50)


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interaction_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_near_dedup, op3_quality_rules, op4_sharding, op5_secret_scan, op6_chat_format, op7_packing, op8_mixing, op9_language_id, op10_fingerprint,
        op11_ranked_search, op12_line_quality, op13_filter_audit,
    )
}

_WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_EMPTY = "''"
_TERMS = f"regexp_extract_all({_LOWER.format('coalesce(text, ' + _EMPTY + ')')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_url_filter": f"""
        WITH rules(rh, rp, rule, verdict) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
                                                     ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
        parts AS (SELECT page_id,
                         CASE WHEN contains(url, '://') THEN {_LOWER.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")} ELSE '' END AS host,
                         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path,
                         row_number() OVER () AS k FROM pages)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM (
            SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY k ORDER BY length(r.rule) DESC NULLS LAST, length(r.rh) DESC) AS best
            FROM parts p LEFT JOIN rules r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp))
        WHERE best = 1
    """,
    "op2_near_dedup": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM docs),
        sizes AS (SELECT doc_id, len(s) AS n FROM sets),
        flat AS (SELECT doc_id, unnest(s) AS x FROM sets),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
        SELECT doc_id, n AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id,
               doc_id = (SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id) AS kept FROM sizes s
    """,
    "op3_quality_rules": f"""
        WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_WORDS.format('text')} AS w FROM documents),
        lines AS (SELECT k, line, i, {_WORDS.format('line')} AS w FROM (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)),
        judged AS (SELECT *, len(w) AS n, row_number() OVER (PARTITION BY k, line ORDER BY i) > 1 AS again,
            len(list_filter(w, lambda x: regexp_full_match(x, '{quality.ALONE}'))) >= 0.2 * len(w)
            OR len(list_filter(w, lambda x: x[-1] = x[-2:-2] AND NOT regexp_matches(x, '{quality.PLAIN}'))) >= 0.2 * len(w)
            OR (len(w) <= 20 AND regexp_matches(line, '{quality.BOILERPLATE}', 'i'))
            OR (len(w) >= 8 AND (list_max(map_values(list_histogram(w))) >= 0.4 * len(w)
                OR (len(list_filter(w, lambda x: regexp_matches(x, '{quality.LETTER}'))) > 0 AND
                    len(list_filter(w, lambda x: regexp_matches(x, '{quality.TWO_CAPITALS}') AND NOT regexp_matches(x, '{quality.SMALL_LETTER}'))) >= 0.8 * len(list_filter(w, lambda x: regexp_matches(x, '{quality.LETTER}')))))) AS failed
            FROM lines WHERE len(w) > 0),
        by_doc AS (SELECT k, count(*) FILTER (WHERE again) AS dup, count(*) FILTER (WHERE failed) AS n_failed, coalesce(sum(length(array_to_string(w, ''))) FILTER (WHERE failed), 0) AS lost FROM judged GROUP BY k),
        windows AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) > 3)),
        twice AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, x) AS c FROM windows) WHERE c > 1),
        repeats AS (SELECT k, count(DISTINCT i + d) AS r FROM twice, (VALUES (0), (1), (2)) AS t(d) GROUP BY k),
        figures AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                           coalesce(dup, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, coalesce(n_failed, 0) AS n_failed_lines, coalesce(lost, 0) AS lost
                    FROM docs LEFT JOIN by_doc USING (k) LEFT JOIN repeats USING (k))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars - lost >= 0.5 * word_chars AS kept, n_failed_lines, CAST(lost AS BIGINT) AS lost_chars FROM figures
    """,
    "op4_sharding": """
        WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
        base AS (SELECT k, doc_id, length(h) // 2 + 1 AS size, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS key, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS tie,
            xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS crc FROM docs, tab),
        lined AS (SELECT *, row_number() OVER w AS r, sum(size) OVER w - size AS lo, sum(size) OVER () AS total FROM base WINDOW w AS (ORDER BY key, tie, doc_id NULLS FIRST, k ROWS UNBOUNDED PRECEDING)),
        dealt AS (SELECT *, CAST(least(15, (2 * lo + size) * 16 // (2 * total)) AS INTEGER) AS shard FROM lined)
        SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, r - min(r) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt
    """,
    "op6_chat_format": """
        WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                      UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        marked AS (SELECT *, length(role || text) - length(replace(role || text, chr(92), ''))
            + list_sum(list_transform(['<|', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'], lambda m: (length(text) - length(replace(text, m, '')) + length(role) - length(replace(role, m, ''))) // length(m))) AS escapes FROM rows),
        sized AS (SELECT *, sum(length(role) + length(text) + escapes + 23) OVER w AS upto, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
                  FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(upto) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op11_ranked_search": f"""
        WITH docs AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS t FROM documents),
        whole AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS l FROM docs),
        asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
        held AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY k, term),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), whole),
        impacts AS (SELECT k, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(t) * n_docs) // l)) AS impact FROM held JOIN docs USING (k), whole),
        scores AS (SELECT item_id, k, any_value(doc_id) AS doc_id, CAST(sum(w * impact) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, k),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
    "op13_filter_audit": f"""
        WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format('text')} AS w FROM documents),
        said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        failed AS (SELECT part, doc_id, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
            || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
            || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f FROM docs),
        counted AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM failed LEFT JOIN said USING (doc_id) GROUP BY part, f),
        letters(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        orders AS (SELECT a.c || b.c || d.c || e.c || g.c AS o FROM letters a JOIN letters b ON a.c <> b.c JOIN letters d ON d.c NOT IN (a.c, b.c) JOIN letters e ON e.c NOT IN (a.c, b.c, d.c) JOIN letters g ON g.c NOT IN (a.c, b.c, d.c, e.c)),
        cases AS (SELECT part, o, s, n, g, x, f, o[s] AS c, contains(f, o[s]) AS own, regexp_matches(f, '[' || o[:s - 1] || '0]') AS before FROM counted, orders, range(1, 6) r(s)),
        sums AS (SELECT part, o, s, c, sum(n) FILTER (NOT own AND NOT before) AS kept, sum(n) FILTER (own AND NOT before) AS removed, sum(n) FILTER (own AND before) AS redundant,
            sum(n) FILTER (f = c) AS unique_fails, sum(g) FILTER (own AND NOT before) AS good_lost, sum(x) FILTER (own AND NOT before) AS toxic_lost FROM cases GROUP BY part, o, s, c)
        SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
            CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
            CAST(coalesce(sum(removed) OVER (PARTITION BY part, c), 0) AS BIGINT) AS shapley FROM sums
    """,
}
