"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from chronofold.llm import bpe, langid, minhash, packing, pii, quality, secretscan, sharding, tokencount, topk
from chronofold.llm.common import table


def op1_byte_bpe(spark, sf_dir):
    return bpe.digest_documents(table(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark, sf_dir):
    return topk.search_embeddings(table(spark, sf_dir, "embeddings"))


def op5_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def quality_ablations(spark, sf_dir):
    return quality.ablation_report(table(spark, sf_dir, "documents"))


def op8_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op9_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    return tokencount.count_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_pii": op2_pii,
    "op3_language_id": op3_language_id,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_packing": op5_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_rules": op7_quality_rules,
    "quality_ablations": quality_ablations,
    "op8_minhash": op8_minhash,
    "op9_sharding": op9_sharding,
    "op10_token_counts": op10_token_counts,
}

#: The ledger of the quality rules as common table expressions; f is the ledger.
_LEDGER = r"""
        WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
        g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
        c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY 1),
        m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals, length(t) - length(replace(t, '!', '')) AS n_exclamations, len(lines)::BIGINT AS n_lines
              FROM w LEFT JOIN c USING (rid)),
        f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > 2 * n_words)::BIGINT + 8 * (10 * n_capitals > 3 * word_chars)::BIGINT
                + 16 * (2 * n_exclamations > n_words)::BIGINT + 32 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::BIGINT + 64 * (word_chars > 40 * n_words)::BIGINT)::BIGINT AS failed FROM m)
"""

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op4_exact_top_k": """
        WITH rows AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
                      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
                   FROM rows q JOIN rows d ON d.vec_id <> q.vec_id AND q.vec_id % 50 = 0 AND len(q.v) = len(d.v))
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 5
    """,
    "op7_quality_rules": _LEDGER
    + """
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
    """,
    "quality_ablations": _LEDGER
    + """
        , v AS (SELECT unnest([1, 2, 3]) AS version, unnest([3, 15, 127]) AS mask),
        b AS (SELECT unnest(range(7)) AS place, unnest(['few_words', 'repeated_windows', 'symbols', 'capitals', 'exclamations', 'repeated_lines', 'long_words']) AS rule)
        SELECT version::INTEGER AS version, rule, count(*) FILTER (failed & (1 << place) <> 0)::BIGINT AS n_failed, count(*) FILTER (failed & mask = 1 << place)::BIGINT AS n_only
        FROM f, v, b WHERE mask & (1 << place) <> 0 GROUP BY ALL
    """,
    "op8_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS sh FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY 1) r ON r.x = d.doc_id
    """,
}
