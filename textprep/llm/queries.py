"""The registered query of each operator, over its whole table, with DuckDB SQL where possible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textprep.catalog.registry import Query
from textprep.llm import (
    ann, fingerprints, lexical, line_dedup, merkle, minhash_dedup, mixing, packing, set_join,
    substring_dedup, suffix_dedup, token_counts, toxicity,
)
from textprep.llm.common import Scratch

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def sha256(text: str):
    return F.sha2(F.col(text).cast("binary"), 256)


@query("""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM parts, unnest(range(1, len(lines) + 1)) AS t(i)),
common AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), ''))
         AS kept_sha256
FROM lines LEFT JOIN common c ON lines.key = c.key
GROUP BY doc_id
""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256("text").alias("kept_sha256"))


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("""
WITH sized AS (
  SELECT doc_id, source, md5('mix|' || doc_id::VARCHAR) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, s, source_size, 3 * source_size AS cap, [5, 2, 1][(s - 1) % 3 + 1] AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               row_number() OVER (ORDER BY source NULLS LAST) AS s
        FROM sized GROUP BY source)),
shares AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS parts
  FROM sources
  WINDOW before AS (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT rest, parts FROM shares WHERE cap / w >= rest / parts ORDER BY cap / w, s LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap / w < shares.rest / shares.parts THEN cap::DOUBLE
              ELSE level.rest::DOUBLE * w / level.parts END AS target
  FROM shares, level),
words AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words FROM targets),
placed AS (
  SELECT doc_id, source, size,
         sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                         ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized)
SELECT doc_id, size, source_size, target,
       CAST(size * (words // source_size)
            + greatest(0, least(start + size, words % source_size) - start) AS BIGINT) AS taken,
       CAST(CASE WHEN size = 0 THEN 0
                 ELSE words // source_size + (start < words % source_size)::INT END AS BIGINT)
         AS copies
FROM placed JOIN words ON placed.source IS NOT DISTINCT FROM words.source
""")
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    mixed = mixing.mix(docs).documents
    columns = "size", "source_size", "target", "taken", "copies"
    return mixed.select(F.col("id").alias("doc_id"), *columns)


@query()
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return minhash_dedup.near_duplicates(docs, k=2, columns=["doc_id"])


@query()
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return fingerprints.fingerprint_edits(docs).select(
        F.col("id").alias("doc_id"), "n_chars", sha256("edited").alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


@query()
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = suffix_dedup.remove_repeats(docs, columns=["doc_id"])
    return found.select(
        "doc_id", "repeats.n_bytes", "repeats.n_removed",
        F.size("repeats.starts").cast("long").alias("n_spans"),
        F.sha2("repeats.kept", 256).alias("kept_sha256"),
    )


@query("""
WITH pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
      FROM pairs)
WHERE rank <= 20
""")
def op5_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.nearest(vectors, F.pmod(F.col("vec_id"), F.lit(20)) == 0)


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    scored = toxicity.score_toxicity(docs, labels)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query()
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = substring_dedup.remove_passages(docs, columns=["doc_id"])
    return found.select(
        "doc_id", "repeats.n_words", "repeats.n_repeated", "repeats.n_removed",
        F.col("repeats.first").alias("first_in"),
        F.sha2(F.col("repeats.kept").cast("binary"), 256).alias("kept_sha256"),
    )


@query()
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after two edits of each document, one inside and one at its end."""
    docs = table(spark, sf_dir, "documents", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = token_counts.count_tokens(docs).withColumnRenamed("n_tokens", "n_before")
    inside = "1L AS seq, n div 3 AS start, n div 20 AS removed, left(text, cast(n div 10 AS int))"
    at_end = "2L AS seq, n * 2 AS start, 0L AS removed, concat(' ', right(text, cast(n div 10 AS int)))"
    edits = F.expr(f"array(struct({inside} AS inserted), struct({at_end} AS inserted))")
    counted = counted.withColumn("n", F.length("text").cast("long"))
    counted = Scratch(spark, "counts").save(counted, "state")
    edited = token_counts.apply_edits(counted, edits)
    return edited.select(
        "doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"),
        F.col("n").alias("n_chars"), "n_encoded", sha256("text").alias("edited_sha256"),
    )


@query("""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, text,
    coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-')
    || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
    || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      range(8 * len(doc_id::VARCHAR)), lambda i: CASE WHEN i % 8 = 0
        THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INTEGER, 1)) ELSE 0 END::BIGINT)),
      lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) // 2, 3988292384::BIGINT)
                        ELSE xor(c, b) // 2 END) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, lang,
    sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295::BIGINT) % 3 = 0 THEN sha256(head || coalesce(
      strlen(text)::VARCHAR || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS p
  FROM hashed),
tree AS (
  SELECT p, 0 AS lvl, i, leaf AS d, n FROM leaves
  UNION ALL
  SELECT p, lvl + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (max(n) + 7) // 8
  FROM tree WHERE n > 1 GROUP BY p, lvl, i // 8),
subroots AS (SELECT p, d FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, p - 1 AS i, d, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (max(n) + 7) // 8
  FROM top WHERE n > 1 GROUP BY lvl, i // 8),
steps AS (
  SELECT p, lvl, i, d, i // 8 AS run, n FROM tree WHERE n > 1),
low AS (
  SELECT p, 0 AS lvl, i AS leaf_i, i, coalesce(tampered, leaf) AS f, '' AS proof, n FROM leaves
  UNION ALL
  SELECT a.p, a.lvl + 1, a.leaf_i, a.i // 8,
    sha256(string_agg(CASE WHEN s.i = a.i THEN a.f ELSE s.d END, '' ORDER BY s.i)),
    any_value(a.proof) || coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (s.i <> a.i), ''),
    (max(a.n) + 7) // 8
  FROM low a JOIN steps s ON a.p = s.p AND a.lvl = s.lvl AND a.i // 8 = s.run
  WHERE a.n > 1 GROUP BY a.p, a.lvl, a.leaf_i, a.i),
high AS (
  SELECT p, leaf_i, 0 AS lvl, p - 1 AS i, f, proof, (SELECT max(n) FROM top) AS n FROM low WHERE n = 1
  UNION ALL
  SELECT a.p, a.leaf_i, a.lvl + 1, a.i // 8,
    sha256(string_agg(CASE WHEN s.i = a.i THEN a.f ELSE s.d END, '' ORDER BY s.i)),
    any_value(a.proof) || coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (s.i <> a.i), ''),
    (max(a.n) + 7) // 8
  FROM high a JOIN top s ON a.lvl = s.lvl AND a.i // 8 = s.i // 8
  WHERE a.n > 1 GROUP BY a.p, a.leaf_i, a.lvl, a.i)
SELECT l.doc_id, l.leaf, s.d AS subroot, r.d AS root, sha256(h.proof) AS proof_sha256,
       h.f AS folded_root, h.f = r.d AS verified
FROM leaves l JOIN high h ON h.p = l.p AND h.leaf_i = l.i AND h.n = 1
JOIN subroots s ON s.p = l.p, (SELECT d FROM top WHERE n = 1) r
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all rows, and what a third of them lead to when tampered with."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    whole = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(changed, merkle.leaf(*whole, F.translate("text", upper, lower)))
    manifest = merkle.build_manifest(
        docs, merkle.leaf(*whole, F.col("text")), doc_id=F.col("doc_id"), tampered=tampered
    )
    proofs = merkle.prove(manifest, manifest.leaves)
    folded = merkle.folded("path", F.coalesce("tampered", "leaf"))
    proofs = proofs.withColumn("folded_root", folded)
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", merkle.siblings_digest("path").alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents),
item_terms AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS q FROM item_terms GROUP BY item_id, term),
sizes AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms
        WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), corpus),
impacts AS (
  SELECT doc_id, term,
         (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * corpus.docs) // corpus.terms)) AS i
  FROM tfs JOIN sizes USING (doc_id), corpus),
scores AS (
  SELECT item_id, doc_id, CAST(sum(q * w * i) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM scores WHERE score > 0)
WHERE rank <= 20
""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    found = lexical.search(docs, items)
    return found.select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score")


@query("""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (
  SELECT u AS a, v AS b FROM links
  UNION
  SELECT a, v FROM reach JOIN links ON b = u)
SELECT words.doc_id, coalesce(n, 0) AS n_shingles,
       least(words.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = words.doc_id), words.doc_id)) AS component_id,
       (SELECT count(*) FROM links WHERE u = words.doc_id) AS n_links
FROM words LEFT JOIN sizes USING (doc_id)
""")
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return set_join.jaccard_links(docs, k=4, percent=85)
