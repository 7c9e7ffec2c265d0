"""Registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.llm.packing import best_fit_pack
    return best_fit_pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.llm.line_chunks import dedup_lines
    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), windows=True)
    return out.select("doc_id", "dedup.n_lines", "dedup.n_removed", "text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.llm.common import crc_remainder
    from shoal.llm.toxicity import score
    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id")) == 0)


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.llm.arc_to_warc import pages_through_warc
    return pages_through_warc(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.llm.embedding_neardup import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.llm.chat_snapshots import collapse
    return collapse(_table(spark, sf_dir, "conversations"))


def op7_cotrain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels whose id's remainder is not 0, so that the others measure it."""
    from shoal.llm.common import crc_remainder
    from shoal.llm.cotrain_quality import score
    labels = _table(spark, sf_dir, "labels").filter(crc_remainder(F.col("doc_id")) != 0)
    out = score(_table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", "quality.score", "quality.text_score", "quality.meta_score", "quality.keep")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.llm.jaccard_join import groups
    return groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.llm.decontaminate import decontaminate
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.llm.common import crc_remainder
    from shoal.llm.katz_lm import score_documents
    return score_documents(_table(spark, sf_dir, "documents"), crc_remainder(F.col("doc_id")) == 1)


def op11_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.llm.pii_bootstrap import report
    return report(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.llm.conversation_repair import repair_damaged
    return repair_damaged(_table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoal.llm.source_divergence import audit
    return audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_line_dedup, op3_toxicity, op4_arc_to_warc, op5_embedding_neardup, op6_chat_snapshots, op7_cotrain_quality, op8_jaccard_join, op9_decontamination, op10_katz_lm,
                                   op11_pii_bootstrap, op12_conversation_repair, op13_source_divergence)}

ORACLE = {
    # chunks between marks (md5 decides the bounds in both engines), and maximal repeated runs of lines of 50 words or more,
    # found as diagonals of equal lines with words (u: a line, and the lines without words after it); ids are unique in the given tables
    "op2_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, ls, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
        h AS (SELECT *, md5(line) AS h, length(line) >= 99 AND length(line) - length(replace(line, ' ', '')) >= 49 AS w FROM l),
        q AS (SELECT *, coalesce(md5('s' || h || lead(h) OVER o) < '8', false) AS st, coalesce(md5('e' || lag(h) OVER o || h) < '8', false) AS en
              FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        b AS (SELECT *, min(CASE WHEN en THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 16 FOLLOWING) AS e FROM q),
        c AS (SELECT doc_id, ls, i AS s, e FROM b WHERE st AND e IS NOT NULL UNION ALL SELECT doc_id, ls, i, i FROM b WHERE w),
        k AS (SELECT *, array_to_string(ls[s + 1:e + 1], chr(10)) AS bytes FROM c),
        f AS (SELECT bytes, min(struct_pack(d := doc_id, n := s)) AS f, arg_min(ls, struct_pack(d := doc_id, n := s)) AS ls0,
                     arg_min(e, struct_pack(d := doc_id, n := s)) AS e0 FROM k GROUP BY bytes HAVING count(*) > 1),
        r AS (SELECT k.doc_id,
                     s - len([x FOR x IN range(1, 9) IF s >= x AND f.n >= x AND ls[s - x + 1:s] = ls0[f.n - x + 1:f.n]]) AS s,
                     e + len([x FOR x IN range(1, 9) IF e + x < len(ls) AND e0 + x < len(ls0) AND ls[e + 2:e + 1 + x] = ls0[e0 + 2:e0 + 1 + x]]) AS e
              FROM k JOIN f USING (bytes) WHERE struct_pack(d := k.doc_id, n := k.s) <> f),
        v AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
        u AS (SELECT doc_id, line, i, n, row_number() OVER o AS j, coalesce(lead(i) OVER o, len(ls)) AS till, array_to_string(ls[i + 2:coalesce(lead(i) OVER o, len(ls))], chr(10)) || '|' || till - i AS after
              FROM v WHERE n > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        eq AS (SELECT a.doc_id AS a, b.doc_id AS b, a.j AS aj, b.j AS bj, b.n, a.after = b.after AS same
               FROM u a JOIN u b ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.j < b.j)),
        br AS (SELECT *, CASE WHEN lag(bj) OVER o = bj - 1 AND lag(same) OVER o THEN 0 ELSE 1 END AS new FROM eq WINDOW o AS (PARTITION BY a, b, aj - bj ORDER BY bj)),
        ru AS (SELECT *, sum(new) OVER (PARTITION BY a, b, aj - bj ORDER BY bj) AS run FROM br),
        lo AS (SELECT DISTINCT b AS doc_id, bj AS j FROM (SELECT *, sum(n) OVER (PARTITION BY a, b, aj - bj, run) AS words FROM ru) WHERE words >= 50),
        g AS (SELECT doc_id, unnest(range(s, e + 1)) AS i FROM r UNION SELECT u.doc_id, unnest(range(u.i, u.till)) FROM u JOIN lo USING (doc_id, j)),
        z AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
                     coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
              FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
        SELECT d.doc_id, coalesce(z.n_lines, 0) AS n_lines, coalesce(z.n_removed, 0) AS n_removed, z.text
        FROM documents d LEFT JOIN z USING (doc_id)""",
    "op6_chat_snapshots": """
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT *, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS piece,
                     struct_pack(t := turn, r := role, x := text) AS key FROM t),
        r AS (SELECT conv_id, turn, count(*) OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total,
                     string_agg(key::VARCHAR, chr(1) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) OVER w AS p
              FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        inner_ AS (SELECT DISTINCT md5(p) AS p, n FROM r WHERE n < total),
        whole AS (SELECT p, total, min(conv_id) AS conv_id, count(DISTINCT conv_id) AS n_same
                  FROM (SELECT conv_id, md5(p) AS p, total FROM r WHERE n = total) GROUP BY p, total),
        kept AS (SELECT w.* FROM whole w ANTI JOIN inner_ i ON w.p = i.p AND w.total = i.n)
        SELECT k.conv_id, kept.total AS n_turns, n_same,
               CAST(floor(coalesce(turn, 0) / 4096) AS BIGINT) AS segment,
               string_agg(piece, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
        FROM k JOIN kept USING (conv_id) GROUP BY ALL""",
    "op4_arc_to_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CAST(CASE WHEN first <> d.page_id THEN first END AS DOUBLE) AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)""",
    # the four states' lightest (cost, audit) carried from the last row to the first; crc32 bit by bit
    "op12_conversation_repair": """
        WITH RECURSIVE c AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)),
                   lambda s, b: list_reduce(list_concat([xor(s, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 20 AS kind
          FROM conversations),
        d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                     CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
              FROM c WHERE kind <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS total,
                     NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM d),
        f AS (SELECT *, role[1:1] AS x, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS two,
                     NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup FROM n),
        g AS (SELECT *, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM f),
        w AS (SELECT *, CASE WHEN blank OR dup THEN 1000000000 WHEN cut THEN 5 ELSE 0 END::BIGINT AS e FROM g),
        r AS (
          SELECT conv_id, total + 1 AS i, {'c': 0::BIGINT, 'a': ''} AS s, {'c': 10::BIGINT, 'a': 'II'} AS b, {'c': 5::BIGINT, 'a': 'I'} AS a, {'c': 0::BIGINT, 'a': ''} AS u
          FROM (SELECT DISTINCT conv_id, total FROM n)
          UNION ALL
          SELECT conv_id, i,
            list_min([ys, {'c': ya.c + 5, 'a': 'I' || ya.a}, {'c': yu.c + 10, 'a': 'II' || yu.a}]), list_min([yb, {'c': ya.c + 5, 'a': 'I' || ya.a}, {'c': yu.c + 10, 'a': 'II' || yu.a}]),
            list_min([ya, {'c': yu.c + 5, 'a': 'I' || yu.a}]), list_min([yu, {'c': ya.c + 5, 'a': 'I' || ya.a}])
          FROM (SELECT w.conv_id, w.i,
                  list_min([{'c': s.c + 2, 'a': 'D' || s.a}, {'c': b.c + CASE WHEN x = 's' THEN e ELSE 1000000000 END, 'a': 'K' || b.a}, {'c': a.c + e + lu, 'a': ku || a.a}]) AS ys,
                  list_min([{'c': b.c + 2, 'a': 'D' || b.a}, {'c': a.c + e + lu, 'a': ku || a.a}]) AS yb,
                  list_min([{'c': a.c + 2, 'a': 'D' || a.a}, {'c': u.c + e + la, 'a': ka || u.a}]) AS ya,
                  list_min([{'c': u.c + 2, 'a': 'D' || u.a}, {'c': a.c + e + lu, 'a': ku || a.a}]) AS yu
                FROM r JOIN (SELECT conv_id, i, x, e, CASE WHEN x = 'u' THEN 0 ELSE 1 END AS lu, CASE WHEN x = 'u' THEN 'K' ELSE 'R' END AS ku,
                                    CASE WHEN x = 'a' THEN 0 ELSE 1 END AS la, CASE WHEN x = 'a' THEN 'K' ELSE 'R' END AS ka FROM w) w
                  ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.i = r.i - 1)),
        best AS (SELECT conv_id, s.c AS cost, s.a AS audit FROM r WHERE i = 1),
        l AS (SELECT conv_id, audit, unnest(string_split(audit, '')) AS l, unnest(range(len(audit))) AS k FROM best WHERE audit <> ''),
        p AS (SELECT *, count(*) FILTER (l <> 'I') OVER o AS i, count(*) FILTER (l <> 'D') OVER o AS place FROM l WINDOW o AS (PARTITION BY conv_id ORDER BY k)),
        q AS (SELECT p.*, w.role, w.text, w.x, max(CASE WHEN place = 1 AND l = 'K' AND x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS sys
              FROM p LEFT JOIN w ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i AND p.l <> 'I'),
        t AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole
              FROM q WHERE l <> 'D' GROUP BY conv_id),
        m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(cut) AS truncated,
                     count_if(two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN m ON o.conv_id IS NOT DISTINCT FROM m.conv_id
          LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN t ON o.conv_id IS NOT DISTINCT FROM t.conv_id""",
    # one row per kept term and pair of sources, no bitmaps
    "op13_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
        kl AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
        gt AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                     1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gt.total, 0) + 2 * kl.v) AS p,
                     1 + (1000000000::HUGEINT * (k.n + 2)) // (kl.total + 2 * kl.v) AS q
              FROM g JOIN k USING (lang) JOIN kl USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN gt USING (lang, source)),
        v AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::HUGEINT AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM r QUALIFY part = 'pair' OR rank <= 10""",
    # every pair of a label
    "op5_embedding_neardup": """
        WITH RECURSIVE x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        v AS (SELECT *, sqrt(list_sum([y * y FOR y IN e])) AS n FROM x
              WHERE label IS NOT NULL AND len(e) > 0 AND len([1 FOR y IN e IF y IS NULL OR isnan(y) OR isinf(y)]) = 0 AND len([1 FOR y IN e IF y <> 0]) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
        r AS (SELECT vec_id AS d, vec_id AS root FROM x UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.d WHERE r.root < l.b),
        c AS (SELECT d, min(root) AS root FROM r GROUP BY d)
        SELECT vec_id, coalesce(k, 0) AS n_links, root AS component_id, vec_id = root AS kept
        FROM x JOIN c ON d = vec_id LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) n ON a = vec_id""",
    # every pair that shares a shingle
    "op8_jaccard_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, greatest(len(ws) - 4, 1) + 1)]) AS sh FROM w WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT doc_id AS d, doc_id AS root FROM w UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.d WHERE r.root < l.b),
        c AS (SELECT d, min(root) AS root FROM r GROUP BY d)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id FROM w JOIN c ON d = w.doc_id LEFT JOIN n USING (doc_id)""",
    # every window of every item against every run of as many words
    "op9_decontamination": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, unnest([array_to_string(ws[i:i + 9], ' ') FOR i IN range(1, greatest(len(ws) - 9, 1) + 1)]) AS t FROM b WHERE len(ws) > 0),
        g AS (SELECT doc_id, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS t, unnest(range(1, len(ws) - k + 2)) AS i
              FROM d, (SELECT DISTINCT k FROM w) z WHERE len(ws) >= k),
        h AS (SELECT doc_id, i, k, item_id FROM g JOIN w USING (k, t)),
        p AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM h) y GROUP BY doc_id),
        m AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) q GROUP BY doc_id)
        SELECT d.doc_id, len(ws) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
