"""The registered queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from veritide.llm.decontaminate import op3_decontamination
from veritide.llm.fingerprints import op9_merkle_fingerprints
from veritide.llm.languages import op10_language_id
from veritide.llm.near_dup import op8_setsketch_near_dup
from veritide.llm.packing import op5_harmonic_packing
from veritide.llm.quality import op4_quality_classifier
from veritide.llm.secrets import ACCESS, ASSIGN, BASE, HEX, KINDS, MORE, op7_secret_scans
from veritide.llm.token_counts import op2_token_counts
from veritide.llm.url_filter import op6_url_filter
from veritide.llm.warc import op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_harmonic_packing": op5_harmonic_packing,
    "op6_url_filter": op6_url_filter,
    "op7_secret_scans": op7_secret_scans,
    "op8_setsketch_near_dup": op8_setsketch_near_dup,
    "op9_merkle_fingerprints": op9_merkle_fingerprints,
    "op10_language_id": op10_language_id,
}



def _secrets_sql() -> str:
    """Each rule's matches are marked, so that their places follow from the lengths of the parts between the marks.

    Texts with the characters 1 or 2 would need other marks.
    """
    rules = {"assign": ASSIGN.pattern, "access": ACCESS.pattern, "hex": HEX.pattern} | {k: r.pattern for k, (r, _) in MORE.items()}
    quoted = {k: rules[k].replace("'", "''") for k in KINDS}
    marked = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, {i} AS rank, string_split(regexp_replace(text, '({p})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM t"
        for i, (k, p) in enumerate(quoted.items())
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    names = ", ".join(f"'{k}'" for k in BASE)
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        m AS ({marked}),
        i AS (SELECT doc_id, kind, rank, parts, unnest(range(2, len(parts) + 1)) AS i FROM m),
        p AS (SELECT doc_id, kind, rank, split_part(parts[i], chr(2), 1) AS hit,
                     list_sum(list_transform(parts[1:i - 1], lambda x: length(x))) - (i - 2) AS first FROM i),
        f AS (SELECT doc_id, kind, rank, first, concat(kind, ':', CAST(first AS BIGINT), ':', CAST(first + length(hit) AS BIGINT)) AS span FROM p
              WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(hit, '{quoted["assign"]}', 2)) >= 8
                              WHEN 'access' THEN length(hit) >= 16 ELSE true END),
        g AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY first, rank) FILTER (kind IN ({names})) AS base,
                     string_agg(span, ',' ORDER BY first, rank) AS spans FROM f GROUP BY doc_id)
        SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN g ON t.doc_id = g.doc_id
    """


ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        f AS (SELECT html, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY html)
        SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
               CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f ON p.html = f.html AND p.n >= 100
    """,
    "op7_secret_scans": _secrets_sql(),
    "op8_setsketch_near_dup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        e AS (SELECT doc_id, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * p.both >= 85 * (na.n + nb.n - p.both)),
        u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id)
        SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id, min(r.root) = n.doc_id AS kept
        FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
    """,
}
