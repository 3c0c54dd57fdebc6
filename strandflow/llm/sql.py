"""Oracle SQL of the document operators, for the same parquet tables."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
     hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
     words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_WORDS = r"'[^\x20\x09-\x0D]+'"

OP2 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
     win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
     low AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT win.doc_id, i FROM win JOIN low USING (s) WHERE win.doc_id > least)),
     each_word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM each_word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
     removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

_TRIM = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP6 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
     lines AS (SELECT doc_id, p, x, {_LOWER.format(_TRIM)} AS k FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS x FROM d)),
     hot AS (SELECT k, max(doc_id) AS holder FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
     judged AS (SELECT lines.*, holder IS NOT NULL AND holder <> doc_id AS gone FROM lines LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS}) AS w FROM documents),
     sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
     both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
     links AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
     reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT x, r FROM links JOIN reach ON reach.doc_id = y)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""

#: CRC-32 of an ASCII or UTF-8 text's bytes: each byte enters the register, which shifts out eight bits.
_STEP = "xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))"
_BYTES = "list_transform(range(1, octet_length(encode({0})) + 1), lambda i: CAST(('0x' || substr(hex(encode({0})), 2 * i - 1, 2)) AS BIGINT))"
_CRC = f"xor(list_reduce(flatten(list_prepend([4294967295], list_transform({_BYTES}, lambda x: [x, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: {_STEP}), 4294967295)"


def _crc(text: str) -> str:
    return _CRC.replace("{0}", text)


OP11 = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
     each_ AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
     h AS (SELECT run, n, {_crc("k")} AS h FROM each_),
     words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
     v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
     cut AS (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
     near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b USING (short, i) WHERE a.word <> b.word
              UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN v b ON a.short = b.word
              UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN v b ON a.short = b.word),
     best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word),
     j AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
     r AS (SELECT word, word AS root FROM v UNION SELECT r.word, j.form FROM r JOIN j ON j.word = r.root WHERE j.form IS NOT NULL)
SELECT j.word, j.form, r.root, j.n, CAST(j.n_near AS BIGINT) AS n_near, j.form_n FROM j JOIN r USING (word) JOIN j e ON e.word = r.root WHERE e.form IS NULL
"""

OP13 = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
     b AS (SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN t ON t.conv_id = c.base AND p <= h UNION ALL SELECT conv_id, 1, p, role, text FROM c JOIN t USING (conv_id) WHERE p > h),
     s AS (SELECT conv_id, row_number() OVER w AS d, string_agg(sha256(length(role) || ':' || role || text), ',') OVER w AS k, text FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, p ROWS UNBOUNDED PRECEDING)),
     m AS (SELECT conv_id, d, sha256(k) AS k, text FROM s UNION ALL SELECT conv_id, 0, '', '' FROM c),
     up AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS above, max(d) OVER (PARTITION BY conv_id) = d AS last FROM m),
     n AS (SELECT d, k, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n_convs, (count(*) - 1) * any_value(length(text)) AS saved,
                  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM up GROUP BY d, k),
     kids AS (SELECT d - 1 AS d, above AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
     tree AS (SELECT m.d, m.k, count(*) FILTER (NOT EXISTS (SELECT 1 FROM kids WHERE kids.d = n.d AND kids.k = n.k)) AS n_leaves, sum(saved) AS saved_tokens FROM n JOIN m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN tree USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN n p ON p.d = n.d - 1 AND p.k = n.above
"""
