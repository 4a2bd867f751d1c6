"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingflow.llm import (
    byte_bpe, html_text, lm_scoring, merkle, minhash, mixing, near_vectors, order_minhash, packing, quality, toxicity, warc,
    whitening,
)
from listingflow.llm.linear import held_out
from listingflow.llm.ship import ship
from listingflow.plans.registry import query
from listingflow.scratch import materialize, scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _components(edges: str, nodes: str) -> str:
    """CTEs ``comp(node, component)``: the smallest node reachable over ``edges(a, b)``."""
    return f"""both_ways AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
reach(node, seen) AS (SELECT id, id FROM {nodes} UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""


@query(
    "op1_embedding_near_dedup",
    f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT id, e FROM v WHERE list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN e]) AND list_bool_or([x <> 0 FOR x IN e])),
edges AS (SELECT p.id AS a, q.id AS b FROM good p JOIN good q ON p.id < q.id AND len(p.e) = len(q.e)
          WHERE list_cosine_similarity(p.e, q.e) >= 0.95),
{_components('edges', 'v')}
SELECT v.id AS vec_id, (SELECT count(*) FROM edges WHERE a = v.id OR b = v.id) AS n_links,
       component AS component_id, v.id = component AS kept
FROM v JOIN comp ON comp.node = v.id""",
)
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_lm_scoring")
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.cross_entropy_difference(docs, lm_scoring.curated(docs, table(spark, sf_dir, "labels")))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query(
    "op4_minhash_near_dedup",
    f"""WITH RECURSIVE words AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
items AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS x FROM sets),
edges AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM items p JOIN items q ON p.x = q.x AND p.id < q.id
  GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
{_components('edges', 'sets')}
SELECT id AS doc_id, len(s) AS n_shingles, component AS component_id, id = component AS kept
FROM sets JOIN comp ON comp.node = sets.id""",
)
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op5_warc",
    """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (payload_digest)""",
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, files = scratch_path(spark, "warc"), scratch_path(spark, "warc-files")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    warc.write_warc(warc.read_archive(spark, path), files)
    # Written once more without the bodies, as the files are parsed in Python.
    records = materialize(warc.read_warc(spark, files, bodies=False).drop("header", "body"), "records")
    return warc.full_payloads(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_document_fingerprints")
def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", F.col("block"), "slot", "position")


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return whitened.withColumn("deviation", F.col("deviation").try_cast("long"))


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.coded_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def _sql_even(x: str) -> str:
    """Whether CRC-32 of the decimal number ``x`` is even, bit by bit."""
    bits = f"flatten([[ord(ch), 0, 0, 0, 0, 0, 0, 0] FOR ch IN string_split(CAST({x} AS VARCHAR), '')])"
    return (
        f"(list_reduce(list_prepend(4294967295, CAST({bits} AS BIGINT[])),"
        " lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))) & 1) = 1"
    )


def _sql_leaf(text: str) -> str:
    fields = [f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)]
    return f"sha256({' || '.join(fields)})"


@query(
    "op13_merkle_manifest",
    f"""WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, source, {_sql_leaf('text')} AS leaf,
         CASE WHEN {_sql_even('doc_id')} THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf('text')} END AS changed
  FROM documents),
ranked AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM docs),
nodes(tree, level, i, n, digest) AS (
  SELECT tree, 0, i, n, leaf FROM ranked
  UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1
  GROUP BY tree, level, n, i // 3),
kept AS MATERIALIZED (SELECT * FROM nodes),
tops(level, i, n, digest) AS (
  SELECT 0, tree, (SELECT count(DISTINCT tree) FROM ranked), digest FROM kept WHERE n = 1
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, n, i // 3),
steps AS MATERIALIZED (
  SELECT p.tree, p.level, p.i, p.n,
         coalesce(string_agg(q.digest, '' ORDER BY q.i) FILTER (q.i < p.i), '') AS before,
         coalesce(string_agg(q.digest, '' ORDER BY q.i) FILTER (q.i > p.i), '') AS after
  FROM (SELECT * FROM kept UNION ALL SELECT NULL, level, i, n, digest FROM tops) p
  JOIN (SELECT * FROM kept UNION ALL SELECT NULL, level, i, n, digest FROM tops) q
    ON p.tree IS NOT DISTINCT FROM q.tree AND p.level = q.level AND p.i // 3 = q.i // 3
  GROUP BY p.tree, p.level, p.i, p.n),
fold(id, tree, of, level, i, digest, proof, done) AS (
  SELECT id, tree, tree, 0, i, changed, '', false FROM ranked
  UNION ALL
  SELECT f.id, f.tree, CASE WHEN s.n > 1 THEN f.of END, CASE WHEN s.n > 1 THEN f.level + 1 ELSE 0 END,
         CASE WHEN s.n > 1 THEN f.i // 3 ELSE f.tree END,
         CASE WHEN s.n > 1 THEN sha256(s.before || f.digest || s.after) ELSE f.digest END,
         CASE WHEN s.n > 1 THEN f.proof || s.before || s.after ELSE f.proof END, f.of IS NULL AND s.n = 1
  FROM fold f JOIN steps s ON s.tree IS NOT DISTINCT FROM f.of AND s.level = f.level AND s.i = f.i WHERE NOT f.done),
root AS (SELECT digest AS root FROM tops WHERE n = 1)
SELECT r.doc_id, r.leaf, k.digest AS subroot, root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM ranked r JOIN kept k ON k.tree = r.tree AND k.n = 1 JOIN fold f ON f.id = r.id AND f.done, root""",
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))
