"""DuckDB SQL for the queries of this subpackage that SQL can express. The others are tested against brute force."""

SHINGLE_COMPONENTS = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g
    FROM texts
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), ways AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
    SELECT a AS doc_id, a AS other FROM ways UNION SELECT reached.doc_id, ways.b FROM reached JOIN ways ON ways.a = reached.other
), least AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""

#: Turns are read from the table as they are: what the query reads back from the formatted text must equal them.
CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), escaped AS (
    SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\+') AS head,
        lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
    FROM turns
), checked AS (
    SELECT *, (before || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS allowed FROM escaped
), said AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(length('<|im_start|>' || head || chr(10) || body || '<|im_end|>' || chr(10))) AS formatted_chars,
        bool_and(allowed) AND last(role ORDER BY turn NULLS FIRST, role, text) = 'assistant' AS valid
    FROM checked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, valid
FROM said
"""

#: Bytes as two hexadecimal digits each; strings of 50 bytes by their MD5. Texts are cut into overlapping windows first, since a substring of a long text is slow.
REPEATS = r"""
WITH texts AS (
    SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
    SELECT k, doc_id, w, substr(h, 2 * w + 1, 2 * 549) AS h FROM (SELECT *, unnest(range(0, greatest(len(h) // 2 - 49, 0), 500)) AS w FROM texts)
), strings AS (
    SELECT k, doc_id, w + i AS pos, md5_number(substr(h, 2 * i + 1, 100)) AS m FROM (SELECT *, unnest(range(0, least(500, len(h) // 2 - 49))) AS i FROM windows)
), earliest AS (
    SELECT m, min(doc_id) AS doc_id FROM strings GROUP BY m HAVING min(doc_id) < max(doc_id)
), late AS (
    SELECT s.k, s.pos FROM strings s JOIN earliest e ON e.m = s.m WHERE e.doc_id < s.doc_id
), flagged AS (
    SELECT k, pos, coalesce(pos > lag(pos) OVER (PARTITION BY k ORDER BY pos) + 50, true) AS new FROM late
), runs AS (
    SELECT k, min(pos) AS a, max(pos) + 50 AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY k ORDER BY pos) AS run FROM flagged) GROUP BY k, run
), gaps AS (
    SELECT k, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS a, a AS b FROM runs
    UNION ALL SELECT k, max(b), NULL FROM runs GROUP BY k
), kept AS (
    SELECT t.k, string_agg(CASE WHEN g.b IS NULL THEN substr(t.h, 2 * g.a + 1) ELSE substr(t.h, 2 * g.a + 1, 2 * (g.b - g.a)) END, '' ORDER BY g.a, g.b NULLS LAST) AS h
    FROM gaps g JOIN texts t ON t.k = g.k GROUP BY t.k
), sums AS (
    SELECT k, sum(b - a) AS gone, count(*) AS n FROM runs GROUP BY k
)
SELECT t.doc_id, len(t.h) // 2 AS n_bytes, CAST(coalesce(s.gone, 0) AS BIGINT) AS n_removed, coalesce(s.n, 0) AS n_spans, sha256(unhex(coalesce(q.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN sums s ON s.k = t.k LEFT JOIN kept q ON q.k = t.k
"""


def centroid_rounds(rounds: int = 10) -> str:
    """Plain k-means in integers: every vector meets every centroid. One assignment and one mean a round, and one assignment more."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""met{t} AS MATERIALIZED (
    SELECT r, c, list_sum(list_transform(list_zip(k.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept k CROSS JOIN means{t} m
), near{t} AS MATERIALIZED (
    SELECT r, c, d FROM met{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)""")
        if t < rounds:
            steps.append(f"""sums{t} AS (
    SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM near{t} JOIN kept USING (r) CROSS JOIN range(1, 65) x(i) GROUP BY c, i
), means{t + 1} AS MATERIALIZED (
    SELECT m.c, coalesce(f.v, m.v) AS v FROM means{t} m
    LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM sums{t} GROUP BY c) f ON f.c = m.c
)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), means0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS c, v FROM kept QUALIFY c < 8
), {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY c) AS n_cluster
FROM near{rounds} JOIN kept USING (r) JOIN means{rounds} m USING (c)
"""


ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": SHINGLE_COMPONENTS,
    "op6_chat_formatting": CHAT,
    "op10_suffix_array_dedup": REPEATS,
    "op13_centroid_clustering": centroid_rounds(),
}
