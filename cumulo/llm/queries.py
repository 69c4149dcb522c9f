"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from cumulo.llm.bpe import op2
from cumulo.llm.chunks import op8
from cumulo.llm.codes import op11
from cumulo.llm.language import op5
from cumulo.llm.lexical import op13
from cumulo.llm.mixing import op12
from cumulo.llm.ngrams import op1
from cumulo.llm.packing import op10
from cumulo.llm.pii import op3
from cumulo.llm.secrets import op4
from cumulo.llm.simhash import op6
from cumulo.llm.topk import op7
from cumulo.llm.vector_dedup import op9

QUERIES = {
    "op1_lm_scores": op1,
    "op2_byte_bpe": op2,
    "op3_pii": op3,
    "op4_secrets": op4,
    "op5_language_id": op5,
    "op6_simhash_near_dedup": op6,
    "op7_kd_tree_top_k": op7,
    "op8_substring_dedup": op8,
    "op9_vector_near_dedup": op9,
    "op10_best_fit_packing": op10,
    "op11_vector_codes": op11,
    "op12_source_mix": op12,
    "op13_lexical_search": op13,
}

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"



def _round(k: int) -> str:
    """Common tables of one Lloyd round: ``a{k}`` assigns parts to the entries of ``b{k}``, whose updates are ``b{k + 1}``."""
    return f"""a{k} AS (SELECT rn, part, CAST(min(d * 64 + e) AS BIGINT) % 64 AS e, CAST(min(d) AS BIGINT) AS d FROM (SELECT rn, part, e, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d FROM parts JOIN b{k} USING (part)) GROUP BY ALL),
      n{k} AS (SELECT part, e, pos, CAST(sum(v[pos]) AS BIGINT) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS pos FROM parts JOIN a{k} USING (rn, part)) GROUP BY ALL),
      m{k} AS (SELECT part, e, list(CAST((s - (s % n + n) % n) // n AS DOUBLE) ORDER BY pos) AS c FROM n{k} GROUP BY ALL),
      b{k + 1} AS (SELECT part, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, e)),"""


#: The others have no SQL form: hashes, automata, compression, learned weights and packings.  Their tests hold plain versions.
ORACLE_SQL: dict[str, str] = {
    "op7_kd_tree_top_k": f"""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_FINITE} AND vec_id IS NOT NULL),
      s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM p a JOIN p b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_vector_near_dedup": f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN {_FINITE} AND vec_id IS NOT NULL AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e FROM embeddings),
      l AS (SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.k <> b.k AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.95),
      reach(a, b) AS (SELECT k, k FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a), c AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON v.k = b GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
      SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c ON c.a = k LEFT JOIN n ON n.a = k""",
    "op11_vector_codes": f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, v) AS rn, vec_id, label, v FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_FINITE})),
      parts AS (SELECT rn, part, list_slice(v, part * (len(v) // 16) + 1, (part + 1) * (len(v) // 16)) AS v FROM kept, (SELECT unnest(range(16)) AS part)),
      b0 AS (SELECT part, rn - 1 AS e, v AS c FROM parts WHERE rn <= 64), {_round(0)} {_round(1)} {_round(2)}
      rows AS (SELECT rn, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rn),
      sha AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM (SELECT part, e, unnest(c) AS x, unnest(range(len(c))) AS pos FROM b2))
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM rows JOIN kept USING (rn), sha""",
    "op12_source_mix": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CAST('0x' || md5('20|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, ''))[:13] AS BIGINT) AS h FROM documents),
      q AS (SELECT doc_id, CASE max(quality) WHEN 1 THEN 4.0 WHEN 0 THEN 0.25 ELSE 1.0 END AS w FROM labels GROUP BY doc_id),
      s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
      f AS (SELECT *, (1.5 * sum(n) OVER () - 2.0 * (sum(n) OVER o - n)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level, row_number() OVER o AS k FROM s WINDOW o AS (ORDER BY 2.0 * n / w, source)),
      t AS (SELECT source, n AS source_size, least(w * coalesce((SELECT arg_min(level, k) FROM f WHERE w * level < 2.0 * n), 0), 2.0 * n) AS target FROM s),
      p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
      k AS (SELECT d.*, p.*, sum(size) OVER (PARTITION BY d.source ORDER BY -ln((h + 0.5) / 4503599627370496) / coalesce(w, 1.0), d.doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS sooner FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN q ON d.doc_id = q.doc_id)
      SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(passes * size + greatest(0, least(size, floor(target - passes * source_size) - sooner)) AS BIGINT) AS taken FROM k""",
    "op13_lexical_search": r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
      size AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS every FROM d WHERE len(terms) > 0),
      tf AS (SELECT k, doc_id, len(terms) AS n, t, count(*) AS tf FROM (SELECT k, doc_id, terms, unnest(terms) AS t FROM d) GROUP BY ALL),
      w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY t),
      i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
      s AS (SELECT i, item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // every)))) AS BIGINT) AS score FROM (SELECT i, item_id, unnest(terms) AS t FROM i) JOIN tf USING (t) JOIN w USING (t), size GROUP BY ALL),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank FROM s WHERE score > 0) SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
