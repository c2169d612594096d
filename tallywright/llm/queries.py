"""The registered queries of this folder over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import (
    bag_minhash,
    decontamination,
    lattice,
    line_dedup,
    main_text,
    packing,
    phrases,
    quality,
    repeats,
    token_counts,
    topk,
    training_order,
    whitening,
)
from tallywright.llm.common import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packing.digest(pieces)


def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_longest_previous_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.without_repeats(table(spark, sf_dir, "documents")))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(
        table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")
    )


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op6_composite_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op7_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bag_minhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "leader")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")
    )


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.kept_texts(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hierarchical_packing,
        op2_lattice_likelihood,
        op3_longest_previous_factor,
        op4_training_order,
        op5_exact_top_k,
        op6_composite_density,
        op7_quality_attention,
        op8_benchmark_containment,
        op9_token_counts,
        op10_bag_minhash,
        op11_phrase_collocations,
        op12_embedding_whitening,
        op13_line_dedup,
    )
}

#: Words and shingles of :mod:`tallywright.llm.decontamination`, and exact integer scores.
SQL: dict[str, str] = {
    "op5_exact_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5""",
    "op8_benchmark_containment": r"""
WITH texts AS (
    SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL
    UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL
), split AS (
    SELECT side, id, list_filter(
        regexp_split_to_array(lower(coalesce(text, '')), '[\x00-/:-`{-\x7f]+'), lambda w: w <> '') AS w
    FROM texts
), shingles AS (
    SELECT DISTINCT side, id, unnest(list_transform(
        range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
    FROM split WHERE len(w) > 0
), sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE side = 'b' GROUP BY id),
shared AS (
    SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
    FROM shingles d JOIN shingles b ON d.s = b.s WHERE d.side = 'd' AND b.side = 'b' GROUP BY ALL
)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN sizes ON item_id = sizes.id WHERE n_shared >= 0.8 * n_item""",
}

# Fixed values of op11 and op13: the case mapping, piece ends, word gaps and white space.
SQL["op11_phrase_collocations"] = r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
), p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
    SELECT lang, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
    FROM w, range(1, 5) r(n) WHERE len(w) >= n
), c AS (SELECT lang, n, g, count(*) AS f FROM g GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE n = 1 GROUP BY lang),
cand AS (SELECT lang, n, g AS phrase, f AS a, string_split(g, ' ') AS w FROM c WHERE n >= 2 AND f >= 30),
cuts AS (
    SELECT lang, phrase, n, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:n], ' ') AS rp
    FROM cand, range(1, 4) s(k) WHERE k < n
), sc AS (
    SELECT cuts.lang, phrase, cuts.n, a, k, cl.f AS l, cr.f AS r, ((2000000 * a::HUGEINT) // (cl.f + cr.f))::BIGINT AS score
    FROM cuts JOIN c cl ON cl.lang = cuts.lang AND cl.g = lp JOIN c cr ON cr.lang = cuts.lang AND cr.g = rp
), weakest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM sc) WHERE o = 1
), inner_spans AS (
    SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a AS outer_f
    FROM cand, range(2, 4) x(s), range(1, 4) y(i) WHERE s < n AND i + s - 1 <= n
), outer_max AS (SELECT lang, phrase, max(outer_f) AS outer_f FROM inner_spans GROUP BY ALL),
kept AS (
    SELECT weakest.* FROM weakest LEFT JOIN outer_max USING (lang, phrase)
    WHERE outer_f IS NULL OR 100 * outer_f < 80 * a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, totals.n, score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

SQL["op13_line_dedup"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (SELECT rid, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM d),
keyed AS (
    SELECT rid, doc_id, i, parts[i] AS line,
           translate(trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), keys AS (
    SELECT k, max(doc_id) AS keeper FROM keyed WHERE doc_id IS NOT NULL AND length(k) >= 20
    GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marks AS (
    SELECT keyed.*, coalesce(keyed.doc_id IS NOT NULL AND keyed.doc_id <> keys.keeper, false) AS dropped
    FROM keyed LEFT JOIN keys ON keyed.k = keys.k AND length(keyed.k) >= 20
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marks GROUP BY rid, doc_id"""
