"""Queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, html, infill, leaks, lines, mixing, ranking, secrets, sharding, simhash, substrings, toxicity, urls
from .common import table


def op1_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark, sf_dir):
    return simhash.groups_digest(table(spark, sf_dir, "documents"))


def op4_html(spark, sf_dir):
    return html.main_texts(table(spark, sf_dir, "pages"))


def op5_leaks(spark, sf_dir):
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark, sf_dir):
    return toxicity.score_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark, sf_dir):
    return secrets.findings_digest(table(spark, sf_dir, "documents"))


def op8_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op9_substrings(spark, sf_dir):
    return substrings.without_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op10_sharding(spark, sf_dir):
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op11_infill(spark, sf_dir):
    return infill.infill_digest(table(spark, sf_dir, "documents"))


def op12_lines(spark, sf_dir):
    return lines.lines_digest(table(spark, sf_dir, "documents"))


def op13_ranking(spark, sf_dir):
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


QUERIES = {
    "op1_ann": op1_ann,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_html": op4_html,
    "op5_leaks": op5_leaks,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_urls": op8_urls,
    "op9_substrings": op9_substrings,
    "op10_sharding": op10_sharding,
    "op11_infill": op11_infill,
    "op12_lines": op12_lines,
    "op13_ranking": op13_ranking,
}
ORACLE_SQL: dict[str, str] = {
    "op9_substrings": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), w AS (
            SELECT row, i, array_to_string(words[i:i + 34], ' ') AS phrase
            FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS i FROM d)
        ), hit AS (
            SELECT row, i FROM w WHERE phrase IN (SELECT phrase FROM w GROUP BY phrase HAVING count(*) > 1)
        ), gone AS (
            SELECT DISTINCT row, unnest(range(i, i + 35)) AS place FROM hit
        ), kept AS (
            SELECT row, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS kept
            FROM (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d) ANTI JOIN gone USING (row, place)
            GROUP BY row
        )
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (row)
    """,
    "op11_infill": r"""
        WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
        g AS (SELECT *, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM h),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
              CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
        p AS (SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
    """,
    "op12_lines": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT row, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT hit), '')) AS kept_sha256
        FROM (SELECT *, key IN (SELECT key FROM f) AS hit FROM k) GROUP BY row, doc_id
    """,
    "op13_ranking": r"""
        WITH t AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS row, * FROM documents)),
        p AS (SELECT *, CAST(sum(tf) OVER (PARTITION BY row) AS BIGINT) AS n FROM (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL)),
        g AS (SELECT count(DISTINCT row) AS nd, count(*) AS nt FROM t),
        w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term),
        q AS (SELECT item_id, item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS item, * FROM benchmark)),
        s AS (SELECT item, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term), g GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, row) AS rank FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
    """,
}
