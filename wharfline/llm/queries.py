"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.llm import audio, decontaminate, html_extract, line_dedup, packing, pii, quality, secret_scan, simhash, warc
from wharfline.sources.tables import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds recordings, so every vector is played as one."""
    return audio.recordings(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", audio.vector_recording)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.histories(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "seconds", F.col("place").alias("history_place"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii": op2_pii,
    "op3_line_dedup": op3_line_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_html": op7_html,
    "op8_audio": op8_audio,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _secret_sql() -> str:
    """Matches and the pieces between them give the places, as in the operator."""
    word = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(word(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = (
        ("assign", rf"""({names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", "AKIA[A-Z0-9]+", 0, 16),
        ("hex", "[0-9a-f]{32,}", 0, 32),
        ("token", "[A-Za-z0-9+/_-]{24,}", 0, 24),
    )
    parts = " UNION ALL ".join(
        f"""SELECT r, source, t, {k} AS kind, '{name}' AS name, v[i] AS value, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n
            FROM (SELECT r, source, t, regexp_extract_all(t, '{q}') AS m, regexp_extract_all(t, '{q}', {g}) AS v, regexp_split_to_array(t, '{q}') AS p FROM d) AS s, unnest(generate_series(1, len(m))) AS u(i) WHERE length(v[i]) >= {least}"""
        for k, (name, q, g, least) in enumerate(kinds)
    )
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
        s AS ({parts}),
        c AS (SELECT * FROM s WHERE kind < 3 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 12
              AND NOT EXISTS (SELECT 1 FROM s AS b WHERE b.r = s.r AND b.kind < 3 AND b.a < s.a + s.n AND s.a < b.a + b.n))),
        o AS (SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT coalesce('=' || source, '') || chr(1) || t) AS repos FROM c GROUP BY value),
        j AS (SELECT c.*, owners, repos, owners <= 2 AND repos <= 4 AS live, name || ':' || a || ':' || (a + n) AS w FROM c JOIN o USING (value)),
        g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                     string_agg(w, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(w, ',' ORDER BY a, kind) FILTER (kind < 3 OR live) AS spans,
                     count(*) FILTER (kind = 3 AND live) AS n_token, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(owners) AS n_owners, max(repos) AS n_repos FROM j GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
               coalesce(spans, '') AS spans, coalesce(n_token, 0) AS n_token, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_owners, 0) AS n_owners, coalesce(n_repos, 0) AS n_repos
        FROM d LEFT JOIN g USING (r)"""


ORACLE_SQL = {
    "op1_decontaminate": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                          regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
               FROM i, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s(p) WHERE len(w) > 0),
        dw AS (SELECT r, p, l, array_to_string(w[p:p + l - 1], ' ') AS g
               FROM d, (SELECT DISTINCT l FROM iw) AS ls, unnest(generate_series(1, len(w) - l + 1)) AS s(p)),
        h AS (SELECT r, p, dw.l, item_id FROM dw JOIN iw USING (l, g)),
        nh AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT r, p, l FROM h), unnest(generate_series(p, p + l - 1)) AS s(x) GROUP BY r),
        ni AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
               FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN nh USING (r) LEFT JOIN ni USING (r)""",
    # maximal runs of equal lines at two places, by the diagonal they lie on; the later place goes
    "op3_line_dedup": """
        WITH known AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
        l AS (SELECT r, no, trim(ls[no], ' ') AS line FROM known, unnest(generate_series(1, len(ls))) AS s(no) WHERE trim(ls[no], ' ') <> ''),
        u AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY no) AS k, length(line) - length(replace(line, ' ', '')) + 1 AS c FROM l),
        p AS (SELECT a.r AS ra, b.r AS rb, b.k - a.k AS diagonal, b.k, b.no, b.c FROM u a JOIN u b USING (line) WHERE a.r < b.r OR (a.r = b.r AND a.k < b.k)),
        g AS (SELECT *, k - row_number() OVER (PARTITION BY ra, rb, diagonal ORDER BY k) AS run FROM p),
        f AS (SELECT *, sum(c) OVER (PARTITION BY ra, rb, diagonal, run) AS words FROM g),
        gone AS (SELECT DISTINCT rb AS r, no FROM f WHERE words >= 5),
        kept AS (SELECT r, string_agg(ls[no], chr(10) ORDER BY no) AS t FROM (SELECT r, ls, no FROM known, unnest(generate_series(1, len(ls))) AS s(no)) ANTI JOIN gone USING (r, no) GROUP BY r)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text, coalesce(n.n, 0) AS n_lines, coalesce(x.n, 0) AS n_removed
        FROM documents d LEFT JOIN known w ON d.doc_id IS NOT DISTINCT FROM w.doc_id AND d.text = w.text LEFT JOIN kept USING (r)
        LEFT JOIN (SELECT r, count(*) AS n FROM u GROUP BY r) n USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) x USING (r)""",
    "op4_secret_scan": _secret_sql(),
    "op9_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)', ['host', 'path']) AS u, coalesce(url, '') AS url FROM pages),
        k AS (SELECT *, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN array_to_string(list_reverse(string_split(regexp_replace(lower(u.host), '^www[0-9]*\.', ''), '.')), ',') || ')' || coalesce(nullif(lower(u.path), ''), '/') ELSE lower(url) END AS url_key FROM p),
        s AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h, url_key, 1700000000 + page_id AS seconds, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS history_place FROM k),
        f AS (SELECT h, min(page_id) AS first FROM s GROUP BY h)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(generate_series(0, 31), lambda j:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, j // 4 * 5 + 1, 5) AS BIGINT) >> (15 - j % 4 * 5)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to, url_key, CAST(seconds AS BIGINT) AS seconds, history_place
        FROM s JOIN f USING (h)""",
}
