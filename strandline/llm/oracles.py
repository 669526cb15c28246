"""The queries as SQL, where SQL can express them on whole tables."""

_V = """
WITH v AS (SELECT DISTINCT run_no, sig_no, conservation c, divergence d, f_neg_hits f, rep_ratio r FROM signatures
           WHERE conservation IS NOT NULL AND divergence IS NOT NULL AND f_neg_hits IS NOT NULL AND rep_ratio IS NOT NULL
             AND NOT isnan(conservation) AND NOT isnan(divergence) AND NOT isnan(f_neg_hits) AND NOT isnan(rep_ratio)),
     a AS (SELECT run_no, sig_no, list_sort([
             1.0::DOUBLE / (60 + rank() OVER (PARTITION BY run_no ORDER BY c DESC) + (count(*) OVER (PARTITION BY run_no, c) - 1) / 2.0::DOUBLE),
             1.0::DOUBLE / (60 + rank() OVER (PARTITION BY run_no ORDER BY d DESC) + (count(*) OVER (PARTITION BY run_no, d) - 1) / 2.0::DOUBLE),
             1.0::DOUBLE / (60 + rank() OVER (PARTITION BY run_no ORDER BY f) + (count(*) OVER (PARTITION BY run_no, f) - 1) / 2.0::DOUBLE),
             1.0::DOUBLE / (60 + rank() OVER (PARTITION BY run_no ORDER BY r DESC) + (count(*) OVER (PARTITION BY run_no, r) - 1) / 2.0::DOUBLE)
           ]) l FROM v),
     b AS (SELECT run_no, sig_no, l[1] + l[2] + l[3] + l[4] AS fused FROM a),
     p AS (SELECT *, row_number() OVER (PARTITION BY run_no ORDER BY fused DESC, sig_no) AS place FROM b)
"""
_K = """
WITH e AS (SELECT DISTINCT assembly_idx s, hash x FROM (SELECT DISTINCT record_idx, assembly_idx FROM records) JOIN kmers USING (record_idx)
           WHERE assembly_idx IS NOT NULL AND hash IS NOT NULL),
     n AS (SELECT s, count(*) n FROM e GROUP BY s),
     o AS (SELECT a.s AS set_a, b.s AS set_b, na.n AS n_a, nb.n AS n_b, c.n_both FROM
             (SELECT a.s x, b.s y, count(*) n_both FROM e a JOIN e b USING (x) WHERE a.s < b.s GROUP BY ALL) c
             JOIN n na ON na.s = c.x JOIN n nb ON nb.s = c.y JOIN (SELECT DISTINCT s FROM e) a ON a.s = c.x
             JOIN (SELECT DISTINCT s FROM e) b ON b.s = c.y WHERE 5 * c.n_both >= 2 * least(na.n, nb.n))
"""
_W = """
WITH r AS (SELECT DISTINCT record_idx::BIGINT id, upper(seq) q FROM records WHERE seq IS NOT NULL),
     w AS (SELECT id, i - 1 AS start, q[i:i + 79] AS t FROM (SELECT id, q, unnest(range(1, length(q) - 78)) i FROM r)),
     c AS (SELECT * FROM w WHERE regexp_full_match(t, '[ACGT]+'))
"""
_SPANS = _W + """,
     f AS (SELECT t, min(id) a, max(id) b FROM c GROUP BY t HAVING min(id) <> max(id)),
     g AS (SELECT id, start, (id = a AND start = min(start) OVER (PARTITION BY id, t)) AS kept FROM c JOIN f USING (t)),
     h AS (SELECT *, CASE WHEN start = lag(start) OVER o + 1 AND kept = lag(kept) OVER o THEN 0 ELSE 1 END AS fresh FROM g
           WINDOW o AS (PARTITION BY id ORDER BY start)),
     k AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY start) AS run FROM h),
     s AS (SELECT id AS record_idx, min(start)::BIGINT AS start, (max(start) + 80)::BIGINT AS stop, kept FROM k GROUP BY id, run, kept)
"""
_PAIRS = """
WITH RECURSIVE r AS (SELECT DISTINCT record_idx::BIGINT id, upper(seq) q FROM records WHERE seq IS NOT NULL),
     w AS (SELECT id, q[i:i + 14] AS t FROM (SELECT id, q, unnest(range(1, length(q) - 13)) i FROM r)),
     k AS MATERIALIZED (SELECT DISTINCT id, least(t, reverse(translate(t, 'ACGT', 'TGCA'))) t FROM w WHERE regexp_full_match(t, '[ACGT]+')),
     n AS (SELECT id, count(*) n FROM k GROUP BY id),
     p AS (SELECT a.id a, b.id b, count(*) c FROM k a JOIN k b USING (t) WHERE a.id < b.id GROUP BY ALL),
     l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 2 * c >= x.n + y.n - c),
     s AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
     c AS (SELECT a AS x, a AS y FROM s UNION SELECT c.x, s.b FROM c JOIN s ON s.a = c.y)
"""
ORACLES = {
    "p1_found": _PAIRS + "SELECT DISTINCT x AS record_a, y AS record_b FROM c WHERE x < y",
    "p1_groups": _PAIRS + """,
     z AS (SELECT id, md5(string_agg(t, ',' ORDER BY t)) AS m FROM k GROUP BY id),
     f AS (SELECT id, min(id) OVER (PARTITION BY m) AS class_id FROM z),
     g AS (SELECT x AS id, min(y) AS y FROM c GROUP BY x)
SELECT i.record_idx, coalesce(f.class_id, i.record_idx) AS class_id, least(i.record_idx, g.y) AS group_id, i.assembly_idx, a.path
FROM (SELECT DISTINCT record_idx::BIGINT AS record_idx, assembly_idx FROM records WHERE record_idx IS NOT NULL) i
     LEFT JOIN f ON f.id = i.record_idx LEFT JOIN g ON g.id = i.record_idx
     LEFT JOIN (SELECT DISTINCT assembly_idx, path FROM assemblies) a USING (assembly_idx)""",
    "p2_found": _V + "SELECT run_no::BIGINT AS run_no, sig_no FROM p JOIN runs USING (run_no) WHERE place <= n_keep",
    "p2_ranking": _V + "SELECT run_no, sig_no, fused, place FROM p",
    "p3_found": _W + """,
     s AS (SELECT sig_no, record_idx own, q[i:i + 79] AS t FROM
            (SELECT DISTINCT sig_no, record_idx, upper(seq) q, unnest(range(1, length(seq) - 78)) i FROM signatures WHERE seq IS NOT NULL))
SELECT DISTINCT 'record' AS kind, a.id AS key_a, b.id AS key_b FROM c a JOIN c b USING (t) WHERE a.id < b.id
UNION ALL SELECT DISTINCT 'signature', sig_no, id FROM s JOIN c USING (t) WHERE id IS DISTINCT FROM own""",
    "p3_spans": _SPANS + "SELECT * FROM s",
    "p3_coverage": _SPANS + """,
     z AS (SELECT record_idx, unnest(range(start, stop)) i, NOT kept AS gone FROM s),
     y AS (SELECT record_idx, count(DISTINCT i) n, count(DISTINCT CASE WHEN gone THEN i END) g FROM z GROUP BY record_idx),
     x AS (SELECT record_idx::BIGINT record_idx, max(coalesce(length(seq), 0)) n_letters FROM records GROUP BY 1)
SELECT x.record_idx, n_letters, coalesce(n, 0) AS n_shared, coalesce(g, 0) AS n_removed FROM x LEFT JOIN y USING (record_idx)""",
    "p6_found": _K + "SELECT set_a::BIGINT AS assembly_a, set_b::BIGINT AS assembly_b FROM o",
    "p6_overlaps": _K + "SELECT set_a::BIGINT AS set_a, set_b::BIGINT AS set_b, n_a, n_b, n_both FROM o",
    "p8_found": r"""
WITH t AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w FROM benchmark),
     i AS (SELECT DISTINCT item_id, array_to_string(w[n:n + 11], ' ') g FROM (SELECT *, unnest(range(1, len(w) - 10)) n FROM t)),
     j AS (SELECT doc_id, unnest(CAST(text::JSON -> '$.cells' AS JSON[])) c FROM documents WHERE layout = 'json'),
     o AS (SELECT doc_id, c, unnest(CAST(coalesce(c -> '$.outputs', '[]') AS JSON[])) o FROM j),
     p AS (SELECT doc_id, array_to_string(CAST(c -> '$.source' AS VARCHAR[]), '') t FROM j
           UNION ALL SELECT doc_id, array_to_string(CAST(coalesce(o -> '$.text', o -> '$.traceback', '[]') AS VARCHAR[]), e'\n') FROM o
           UNION ALL SELECT doc_id, text FROM documents WHERE layout IS DISTINCT FROM 'json'),
     d AS (SELECT doc_id, list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') w FROM p WHERE t IS NOT NULL),
     k AS (SELECT doc_id, array_to_string(w[n:n + 11], ' ') g FROM (SELECT *, unnest(range(1, len(w) - 10)) n FROM d))
SELECT DISTINCT doc_id, item_id FROM k JOIN i USING (g)""",
    "p8_residue": """
SELECT doc_id, 0::BIGINT AS item_id, 0 AS n_spans, 0 AS longest, 0 AS n_words, 0::DOUBLE AS coverage FROM documents WHERE false""",
}
