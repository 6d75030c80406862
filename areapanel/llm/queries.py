"""The registered queries of this package: each derives the contracted columns from its operator."""

import hashlib
from functools import lru_cache

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline

from . import byte_bpe, compression, context_tree, cover_tree, factorization, jaccard, lexical, packing, ratio_rules, repair, repeats, secrets, token_files
from .common import table


def op1_cover_tree(spark, sf):
    return cover_tree.near_duplicates(table(spark, sf, "embeddings"), cosine=0.98)


def op2_best_fit_packing(spark, sf):
    docs = table(spark, sf, "documents")
    return packing.pack(
        docs, public_tokenizers.path("word_bpe_49k.json"), carry={"ids_crc32": F.crc32("ids")}
    )


def op3_compression_quality(spark, sf):
    docs = table(spark, sf, "documents")
    return compression.score(docs, compression.train(docs, table(spark, sf, "labels")), threshold=0.7)


@lru_cache(maxsize=1)
def _decimals(n):
    return [str(i) for i in range(n)]


def _digests(ids, decoded):
    text = ",".join(map(_decimals(1 << 16).__getitem__, ids.tolist()))
    return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def op4_byte_bpe(spark, sf):
    return byte_bpe.encode(
        table(spark, sf, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        finish=_digests,
        fields="n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def op5_ratio_rules(spark, sf):
    return ratio_rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("score")


def op6_ownership_secrets(spark, sf):
    return secrets.digests(secrets.scan(table(spark, sf, "documents")))


def op7_token_files(spark, sf):
    path = token_files.new_file(spark)
    token_files.write(table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_context_tree(spark, sf):
    return context_tree.score(table(spark, sf, "documents"), depth=6)


def op9_factorization_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return factorization.score(docs, factorization.train(docs, table(spark, sf, "labels")), threshold=0.3)


def op10_jaccard_join(spark, sf):
    return jaccard.similar_documents(table(spark, sf, "documents"), width=4, percent=85)


def op11_lightest_repair(spark, sf):
    return repair.report(table(spark, sf, "conversations"))


def op12_fp_tree_search(spark, sf):
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), top=10)


def op13_suffix_dedup(spark, sf):
    return repeats.without_repeats(table(spark, sf, "documents"), size=400)


def queries():
    found = {name: call for name, call in globals().items() if name.startswith("op")}
    return found | {"pipeline": corpus_pipeline.run}


_NEAR_VECTORS = """
    WITH RECURSIVE good AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND list_count(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND list_count(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
        AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
    ),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
    counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
      e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
    FROM embeddings e LEFT JOIN low l ON l.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""

_JACCARD = r"""
    WITH RECURSIVE split AS (
      SELECT doc_id, list_filter(
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
    ),
    shingles AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i:i+3], 'string_agg', ' ')) END) AS s FROM split
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY 1, 2
    ),
    links AS (
      SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
    ),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN low ON a = d.doc_id
"""

_RANKED = r"""
    WITH split AS (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
    ),
    real AS (SELECT row_number() OVER () AS d, doc_id, w, len(w) AS n FROM split WHERE len(w) > 0),
    corpus AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS length FROM real),
    counts AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM real) GROUP BY d, t),
    held AS (SELECT t, count(*) AS df FROM counts GROUP BY t),
    items AS (
      SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
    ),
    weights AS (
      SELECT item_id, i.t, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM items i JOIN held h ON h.t = i.t, corpus
    ),
    scores AS (
      SELECT item_id, r.doc_id, r.d,
        CAST(sum(q.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // length)))) AS BIGINT) AS score
      FROM weights q JOIN counts c ON c.t = q.t JOIN real r ON r.d = c.d, corpus GROUP BY 1, 2, 3
    ),
    ranked AS (
      SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
      FROM scores WHERE score > 0
    )
    SELECT * FROM ranked WHERE rank <= 10
"""


def oracle_sql():
    """DuckDB SQL of the queries that SQL can express; the others are tested against direct code."""
    return {"op1_cover_tree": _NEAR_VECTORS, "op10_jaccard_join": _JACCARD, "op12_fp_tree_search": _RANKED}
