"""Queries over the driver's tables, one per operator, and their oracle SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from wayfold.llm import bestfit, hilbert, langid, lm, mixing, neardup, packing, prefixes, quality, tokens, topk, vectors, whitening
from wayfold.llm.arrays import remainder
from wayfold.llm.storage import put
from wayfold.session import checkpoint_dir, prepare

TOKENIZER, PACKING_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


def _table(spark, sf_dir, name):
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def packing_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path(PACKING_TOKENIZER)


def op1_lm_score(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    out = lm.score(docs, remainder(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_temperature_mix(spark, sf_dir):
    out = mixing.mix(_table(spark, sf_dir, "documents"), entropy_share=0.95, max_repeats=4.0)
    return out.select("doc_id", "source", "epoch", "block", "tokens", "exponent", "weight")


def op3_quality_gam(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = remainder(F.col("doc_id"), 3) == 1
    return quality.classify(docs.select("doc_id", "text"), labels, ~held).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_order_minhash(spark, sf_dir):
    return neardup.classes(_table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    held = remainder(F.col("doc_id"), 4) == 2
    return langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_hilbert_shards(spark, sf_dir):
    dims = {"source": F.col("source"), "lang": F.col("lang"), "size": F.octet_length("text").cast("bigint")}
    out = hilbert.shard(_table(spark, sf_dir, "documents"), dims)
    return out.select("doc_id", "size", F.coalesce("text_crc32", F.crc32(F.lit("").cast("binary"))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("_h").alias("curve_index"))


def op7_exact_topk(spark, sf_dir):
    return topk.top(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_length_buckets(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_token_files(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    path = f"{checkpoint_dir(spark)}/wayfold-{uuid.uuid4().hex}"
    tokens.write(docs, path, tokenizer_file())
    return tokens.read(spark, path)


def op10_vector_dups(spark, sf_dir):
    return vectors.near(_table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark, sf_dir):
    turns = put(prefixes.numbered(_table(spark, sf_dir, "conversations")))
    rows, ids = prefixes.rebuilt(turns, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9)
    found = prefixes.tries(put(rows), ids)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return found.nodes.join(prefixes.end_digests(found.ends), ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_best_fit(spark, sf_dir):
    return bestfit.pack(_table(spark, sf_dir, "documents"), packing_tokenizer())


def all_queries():
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


#: Whole numbers, so the sums are exact in any order.
ORACLES = {
    "op7_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, x -> floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
                   WHERE len(embedding) > 0 AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_vector_dups": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
                   WHERE len(embedding) > 0 AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, x -> x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c""",
    # crc32 bit by bit: each byte of the decimal id, then eight shifts.
    "op11_prefix_trie": """
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
        i AS (SELECT DISTINCT conv_id FROM t),
        c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)) % 9 AS h FROM i),
        o AS (SELECT c.conv_id, 0 AS part, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= h UNION ALL
              SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h),
        r AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, count(*) OVER (PARTITION BY conv_id) AS n, string_agg(md5(concat(strlen(role), ':', role, text)), '') OVER w AS path FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
        m AS (SELECT conv_id, depth, bytes, n, path, CASE WHEN depth > 1 THEN left(path, 32 * (CAST(depth AS INTEGER) - 1)) ELSE '' END AS up FROM r
              UNION ALL SELECT i.conv_id, 0, 0, coalesce(k, 0), '', NULL FROM i LEFT JOIN (SELECT conv_id, count(*) AS k FROM r GROUP BY conv_id) USING (conv_id)),
        nodes AS (SELECT path, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM m GROUP BY path),
        kids AS (SELECT up, count(*) AS k FROM nodes WHERE up IS NOT NULL GROUP BY up),
        every AS (SELECT nodes.*, coalesce(k, 0) AS n_children, (n_convs - 1) * bytes AS own FROM nodes LEFT JOIN kids ON kids.up = nodes.path),
        below AS (SELECT left(path, 32 * CAST(d AS INTEGER)) AS top, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM every, generate_series(0, depth) AS g(d) GROUP BY 1)
        SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, f.ends_sha256
        FROM every f JOIN below b ON b.top = f.path LEFT JOIN nodes p ON p.path = f.up""",
}


def all_oracles():
    return dict(ORACLES)
