"""The queries op1 to op13, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan_copies

    planned = plan_copies(documents(spark, sf_dir), keep=["doc_id", "source"])
    return planned.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import STATS, judge

    return judge(documents(spark, sf_dir)).select("doc_id", *STATS, "base_failed", "kept", "posterior")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest

    return digest(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(documents(spark, sf_dir))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar

    return similar(documents(spark, sf_dir))


def op8_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm_scoring import score

    return score(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damaged, repair

    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumnRenamed("conv", "conv_id")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    records = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op8_hmm_scoring": op8_hmm_scoring,
    "op4_ngram_join": op4_ngram_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op5_packing": op5_packing,
    "op1_secret_scan": op1_secret_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op3_url_filter": op3_url_filter,
    "op10_quality_rules": op10_quality_rules,
    "op2_mixing": op2_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_warc": op12_warc,
    "op13_hard_negatives": op13_hard_negatives,
}

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "op11_conversation_repair": r"""
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
        keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
                   [4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS b FROM conversations),
        kinds AS (SELECT * EXCLUDE (b), xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc),
        damaged AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt,
                   unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE kind <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(txt)) AS i FROM damaged),
        judged AS (
            SELECT *, NOT regexp_matches(txt, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 AS seen,
                   NOT regexp_matches(txt, '[.!?][\x20\x09-\x0D]*\z') AS cut, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS px FROM placed),
        rows_ AS (SELECT conv_id, turn, role, txt, i, x, px, blank, seen AND NOT blank AS again, (cut AND NOT seen AND NOT blank) AS cut, blank OR seen AS forced FROM judged),
        facts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
                   count(*) FILTER (cut) AS truncated, count(*) FILTER (px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
        back(conv_id, i, c) AS (
            SELECT conv_id, n, [0, 4, 2, 0]::BIGINT[] FROM facts
            UNION ALL
            SELECT conv_id, i - 1, [least(h[1], 2 + h[3], 4 + h[4]), least(h[2], 2 + h[3], 4 + h[4]), least(h[3], 2 + h[4]), least(h[4], 2 + h[3])]
            FROM (SELECT b.conv_id, b.i, [
                    least(3 + c[1], CASE WHEN forced THEN 999999999 ELSE cut::INT + least(2 + c[3], CASE x WHEN 's' THEN c[2] WHEN 'u' THEN c[3] ELSE 999999999 END) END),
                    least(3 + c[2], CASE WHEN forced THEN 999999999 ELSE cut::INT + least(2 + c[3], CASE x WHEN 'u' THEN c[3] ELSE 999999999 END) END),
                    least(3 + c[3], CASE WHEN forced THEN 999999999 ELSE cut::INT + least(2 + c[4], CASE x WHEN 'a' THEN c[4] ELSE 999999999 END) END),
                    least(3 + c[4], CASE WHEN forced THEN 999999999 ELSE cut::INT + least(2 + c[3], CASE x WHEN 'u' THEN c[3] ELSE 999999999 END) END)] AS h
                  FROM back b JOIN rows_ r ON r.conv_id = b.conv_id AND r.i = b.i)),
        steps AS (SELECT b.conv_id, b.i, b.c, d.c AS d, role, txt, x, forced, cut::INT AS cut FROM back b LEFT JOIN rows_ r ON r.conv_id = b.conv_id AND r.i = b.i + 1 LEFT JOIN back d ON d.conv_id = b.conv_id AND d.i = b.i + 1),
        trace(conv_id, i, q, audit, kept) AS (
            SELECT conv_id, 0::BIGINT, 1, '', []::VARCHAR[] FROM facts
            UNION ALL
            SELECT conv_id, CASE edit WHEN 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN k ELSE m END, audit || edit,
                   CASE edit WHEN 'D' THEN kept WHEN 'K' THEN list_append(kept, role || ':' || txt) WHEN 'I' THEN list_append(kept, made || ':') ELSE list_append(kept, made || ':' || txt) END
            FROM (SELECT *, CASE WHEN d[q] + 3 = c[q] THEN 'D' WHEN c[m] + 2 = c[q] THEN 'I' WHEN NOT forced AND k > 0 AND d[k] + cut = c[q] THEN 'K' WHEN NOT forced AND d[m] + 2 + cut = c[q] THEN 'R' END AS edit
                  FROM (SELECT t.*, s.* EXCLUDE (conv_id, i), CASE q WHEN 3 THEN 4 ELSE 3 END AS m, CASE q WHEN 3 THEN 'assistant' ELSE 'user' END AS made,
                               CASE WHEN q = 1 AND x = 's' THEN 2 WHEN q <> 3 AND x = 'u' THEN 3 WHEN q = 3 AND x = 'a' THEN 4 ELSE 0 END AS k
                        FROM trace t JOIN steps s ON s.conv_id = t.conv_id AND s.i = t.i))
            WHERE edit IS NOT NULL),
        ended AS (SELECT conv_id, audit, kept FROM trace QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(audit) DESC) = 1),
        costs AS (SELECT conv_id, c[1] AS cost FROM back WHERE i = 0)
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN facts USING (conv_id) LEFT JOIN costs USING (conv_id) LEFT JOIN ended USING (conv_id)
    """,
    "op12_warc": """
        SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha256(payload) AS payload_digest,
               CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS payload, CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS first_id FROM pages)
    """,
    "op13_hard_negatives": """
        WITH clean AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, list_dot_product(a.v, b.v)::BIGINT AS score FROM clean a JOIN clean b ON a.id <> b.id WHERE a.id % 100 = 0),
        positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        negatives AS (
            SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INT AS rank
            FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
    """,
    "op2_mixing": f"""
        WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, substr(md5(concat_ws('|', 7, doc_id, lang, n_chars, source, text)), 1, 16) AS h FROM documents),
        w AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::DOUBLE AS cap, sum(sum(size)) OVER () * 1.5::DOUBLE AS total,
                     ([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1])::DOUBLE AS weight FROM d GROUP BY source),
        l AS (SELECT *, (total - coalesce(sum(cap) OVER (fullest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (fullest ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW fullest AS (ORDER BY cap / weight, source NULLS LAST)),
        t AS (SELECT source, source_size, CASE WHEN cap <= weight * level OR top IS NULL THEN cap ELSE least(cap, weight * top) END AS target,
                     (('0x' || substr(md5('7|offset|' || coalesce('a' || source, 'b')), 1, 3))::INT + 0.5::DOUBLE) / 4096 AS shift
              FROM (SELECT *, max(level) FILTER (cap > weight * level) OVER () AS top FROM l)),
        p AS (SELECT doc_id, d.source, size, source_size, target, shift, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                     row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN size > 0 THEN floor(log2(size) * 4) + 1 ELSE 0 END, ('0x' || substr(h, 1, 8))::BIGINT % 256, h) AS n
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT *, greatest(0, least(2, floor(n * rate + shift) - floor((n - 1) * rate + shift)))::BIGINT AS copies FROM p)
        SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM c
    """,
    "op4_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        u AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
        g AS (SELECT doc_id, n, i, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS t FROM u),
        s AS (SELECT DISTINCT doc_id, t FROM g WHERE i <= greatest(n - 4, 1)),
        sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c)),
        reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
        classes AS (SELECT x AS doc_id, min(y) AS class_id, count(*) AS class_size FROM reach GROUP BY x)
        SELECT doc_id, class_id, class_size, coalesce(n_links, 0) AS n_links FROM classes LEFT JOIN (SELECT x, count(*) AS n_links FROM links GROUP BY x) ON x = doc_id
    """,
    "op7_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
        g AS (SELECT doc_id, i, x, CASE WHEN lead(i, 34) OVER (PARTITION BY doc_id ORDER BY i) IS NOT NULL
                     THEN md5(string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS t FROM u),
        c AS (SELECT doc_id, i, x, t IS NOT NULL AND count(*) OVER (PARTITION BY t) > 1 AS repeated FROM g),
        m AS (SELECT doc_id, i, x, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
        k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
    """,
    "op3_url_filter": """
        WITH urls AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
            FROM pages),
        rules(rule_host, rule_path, action) AS (VALUES
            ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        judged AS (
            SELECT page_id, host, path,
                   (SELECT struct_pack(l := length(rule_host || rule_path), r := rule_host || rule_path, a := action) FROM rules
                    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
                    ORDER BY 1 DESC LIMIT 1) AS best
            FROM urls)
        SELECT page_id, host, path, best.r AS rule, coalesce(best.a, 'allow') AS verdict FROM judged
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
