"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fertility, hmm, jaccard_join, langid, lexical, licenses, line_dedup, mixing, multi_index, packing, pii, repair, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_power_of_two(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "batch_id")


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op4_rare_token_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op7_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search_every(table(spark, sf_dir, "embeddings"))


def op3_warc_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = fertility.judge(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.HiddenMarkov(table(spark, sf_dir, "documents")).score()


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_equal", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.components(table(spark, sf_dir, "documents"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.report(conversations, repair.damaged(conversations))


def op13_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_power_of_two_packing": op1_power_of_two_packing,
    "op2_skip_chain_pii": op2_skip_chain_pii,
    "op3_warc_seekable": op3_warc_seekable,
    "op4_rare_token_licences": op4_rare_token_licences,
    "op7_inverted_multi_index": op7_inverted_multi_index,
    "op5_hidden_markov_lm": op5_hidden_markov_lm,
    "op6_tokeniser_fertility": op6_tokeniser_fertility,
    "op8_mixing": op8_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_jaccard_metric_join": op10_jaccard_metric_join,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_compression_language": op13_compression_language,
}

ORACLE_SQL: dict[str, str] = {
    "op10_jaccard_metric_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (
            SELECT DISTINCT doc_id, shingle FROM (
                SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id""",
    "op3_warc_seekable": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, row_number() OVER () AS r FROM pages),
        d AS (SELECT page_id, r, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
        m AS (SELECT *, first_value(r) OVER w AS chief, first_value(page_id) OVER w AS chief_page FROM d
              WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST, r DESC))
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND r <> chief THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND r <> chief THEN chief_page END AS refers_to
        FROM m""",
    # lines within one edit share the front or the back half, measured on the shorter one; of such
    # pairs the first difference is found and what follows it compared
    "op9_line_dedup": r"""
        WITH l AS MATERIALIZED (SELECT doc_id, i - 1 AS line_no, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
        f AS MATERIALIZED (SELECT line, length(line) AS n, min((doc_id, line_no)) AS first FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
        h AS MATERIALIZED (SELECT line, n, first, s, s // 2 AS half FROM (SELECT *, unnest([n, n - 1]) AS s FROM f WHERE n >= 8)),
        k AS MATERIALIZED (SELECT line, n, first, s, 'front' AS side, left(line, half) AS share FROM h UNION ALL SELECT line, n, first, s, 'back', right(line, s - half) FROM h),
        c AS (SELECT DISTINCT a.line AS a, b.line AS b, a.n, b.n AS m FROM k a JOIN k b USING (s, side, share) WHERE a.first < b.first AND least(a.n, b.n) = s AND a.line <> b.line),
        v AS (SELECT *, regexp_extract_all(a, '(?s).') AS x, regexp_extract_all(b, '(?s).') AS y FROM c),
        p AS (SELECT *, coalesce(list_position(list_transform(range(1, least(n, m) + 1), lambda i: x[i] <> y[i]), true), least(n, m) + 1) AS pos FROM v),
        near AS MATERIALIZED (SELECT DISTINCT b AS line FROM p WHERE substr(a, pos + CASE WHEN n >= m THEN 1 ELSE 0 END) = substr(b, pos + CASE WHEN m >= n THEN 1 ELSE 0 END)),
        g AS (SELECT l.*, f.line IS NOT NULL AS full_, near.line IS NOT NULL AS is_near, f.line IS NOT NULL AND near.line IS NULL AND (doc_id, line_no) <> f.first AS is_equal
            FROM l LEFT JOIN f USING (line) LEFT JOIN near USING (line)),
        d AS (SELECT doc_id, count(*) FILTER (full_) AS n_lines, count(*) FILTER (is_equal) AS n_equal, count(*) FILTER (is_near) AS n_near,
            array_to_string(list(line ORDER BY line_no) FILTER (NOT is_near AND NOT is_equal), chr(10)) AS text FROM g GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_equal, 0) AS n_equal, coalesce(n_near, 0) AS n_near, sha256(coalesce(d.text, '')) AS text_sha256
        FROM documents LEFT JOIN d USING (doc_id)""",
    "op11_ranked_lexical_search": r"""
        WITH t AS MATERIALIZED (SELECT doc_id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS r FROM documents)),
        n AS (SELECT doc_id, r, count(*) AS n FROM t GROUP BY ALL), g AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM n),
        m AS (SELECT doc_id, r, 100 - 25 + ((25 * n * nd) // l) AS m FROM n, g),
        p AS (SELECT doc_id, r, term, count(*) AS tf FROM t GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY ALL), g),
        q AS (SELECT item_id, i, term, count(*) AS c FROM (SELECT item_id, i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS i FROM benchmark)) GROUP BY ALL),
        s AS (SELECT item_id, i, doc_id, r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id, r) GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
    # the least (cost, audit) of each state after each turn, with up to two insertions behind it
    "op12_conversation_repair": r"""
        WITH RECURSIVE tb AS (SELECT list(v ORDER BY i) AS tb FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
        h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tb[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM conversations, tb),
        d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(2) x(k) WHERE h <> 0 AND (k = 0 OR h = 3)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM d),
        f AS MATERIALIZED (SELECT *, coalesce(conv_id, -9223372036854775807) AS k, left(role, 1) AS ini, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(said, '[.!?]\z') THEN 'truncated' END AS fault,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
        mv(a, c, b) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
        ins(a, b, n) AS (SELECT a, a, 0 FROM (VALUES ('0'), ('s'), ('u'), ('a')) x(a) UNION ALL SELECT a, b, 1 FROM mv WHERE c <> 's' UNION ALL SELECT x.a, y.b, 2 FROM mv x JOIN mv y ON x.b = y.a WHERE x.c <> 's' AND y.c <> 's'),
        dp AS (SELECT k, CAST(0 AS BIGINT) AS i, b AS st, {'cost': CAST(5 * n AS BIGINT), 'audit': repeat('I', n)} AS v FROM (SELECT DISTINCT k FROM f), ins WHERE a = '0'
            UNION ALL SELECT k, i, st, min(v) FROM (
                SELECT k, i, ins.b AS st, {'cost': cost + 5 * n, 'audit': audit || repeat('I', n)} AS v FROM (
                    SELECT dp.k, f.i, st, v.cost + 2 AS cost, v.audit || 'D' AS audit FROM dp JOIN f ON f.k = dp.k AND f.i = dp.i + 1
                    UNION ALL SELECT dp.k, f.i, mv.b, v.cost + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, v.audit || 'K' FROM dp JOIN f ON f.k = dp.k AND f.i = dp.i + 1 JOIN mv ON mv.a = st AND mv.c = ini WHERE fault IS NULL OR fault = 'truncated'
                    UNION ALL SELECT dp.k, f.i, mv.b, v.cost + 1 + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, v.audit || 'R' FROM dp JOIN f ON f.k = dp.k AND f.i = dp.i + 1 JOIN mv ON mv.a = st AND mv.c <> 's' WHERE fault IS NULL OR fault = 'truncated') JOIN ins ON ins.a = st) GROUP BY ALL),
        z AS (SELECT k, count(*) AS n FROM f GROUP BY ALL), e AS (SELECT dp.k, min(v) AS v FROM dp JOIN z ON z.k = dp.k AND n = dp.i WHERE st IN ('0', 'a') GROUP BY ALL),
        op AS (SELECT k, unnest(string_split(v.audit, '')) AS op, generate_subscripts(string_split(v.audit, ''), 1) AS p FROM e WHERE v.audit <> ''),
        od AS (SELECT *, CAST(count(*) FILTER (op <> 'I') OVER (PARTITION BY k ORDER BY p) AS BIGINT) AS i FROM op),
        st AS (SELECT od.k, p, op, role, text, row_number() OVER (PARTITION BY od.k ORDER BY p) AS q, first_value(CASE WHEN op = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY od.k ORDER BY p) AS s FROM od LEFT JOIN f ON f.k = od.k AND f.i = od.i AND op <> 'I' WHERE op <> 'D'),
        l AS (SELECT k, string_agg(CASE WHEN op = 'K' THEN role WHEN (q - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS said FROM st GROUP BY ALL),
        c AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY ALL)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.cost, 0) AS cost, coalesce(v.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN c ON c.k = coalesce(conv_id, -9223372036854775807) LEFT JOIN e ON e.k = c.k LEFT JOIN l ON l.k = c.k""",
}
