"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm import (bit_planes, chaining, exact_dedup, ffd_packing, langid, ngram_join, packing, quality,
                           spm_backend, suffix_dedup, token_store, toxicity, turn_repair)
from postpulse.llm.common import id_and_text, ship_package
from postpulse.llm.tokens import tokenizer_path
from postpulse.session import scratch_path
from postpulse.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql.strip()
        return run
    return wrap


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's categories in order: low quality first, then toxic."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))


CATEGORIES = ["low_quality", "toxic"]


@register("op1_suffix_array_dedup", """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(h[2 * p + 1:2 * p + 800]) AS k
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS p FROM d)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
runs AS (SELECT doc_id, min(p) AS lo, max(p) + 400 AS hi
         FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r
               FROM (SELECT doc_id, p,
                            coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 400, TRUE)::INT AS fresh
                     FROM hit))
         GROUP BY doc_id, r),
cuts AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans,
                list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM runs GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN los IS NULL THEN h ELSE array_to_string(
         [h[2 * CASE WHEN i = 1 THEN 0 ELSE his[i - 1] END + 1:
            2 * CASE WHEN i > len(los) THEN length(h) // 2 ELSE los[i] END] FOR i IN range(1, len(los) + 2)], '')
         END)) AS kept_sha256
FROM d LEFT JOIN cuts ON d.doc_id = cuts.doc_id
""")
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document covered by a 400-byte string that starts twice."""
    return suffix_dedup.removal_report(spark, table(spark, sf_dir, "documents")).drop("spans")


@register("op2_ngram_jaccard_join", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS s FROM words),
classes AS (SELECT min(doc_id) AS c, count(*) AS copies, any_value(k) AS s, list(doc_id) AS docs
            FROM (SELECT doc_id, list_sort(s) AS k FROM sets WHERE len(s) > 0) GROUP BY k),
items AS (SELECT c, len(s) AS n, unnest(s) AS x FROM classes),
links AS (SELECT a, b FROM (SELECT i.c AS a, j.c AS b, any_value(i.n) AS n, any_value(j.n) AS m, count(*) AS k
          FROM items i JOIN items j ON i.x = j.x AND i.c <> j.c GROUP BY 1, 2)
          WHERE k * 9 >= 4 * (n + m)),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY a),
groups AS (SELECT root, sum(copies)::BIGINT AS size FROM roots JOIN classes USING (c) GROUP BY root),
near AS (SELECT a AS c, sum(copies)::BIGINT AS n FROM links JOIN classes ON c = b GROUP BY a),
named AS (SELECT unnest(docs) AS doc_id, c, root, size, (coalesce(n, 0) + copies - 1)::BIGINT AS n_links
          FROM classes JOIN roots USING (c) JOIN groups USING (root) LEFT JOIN near USING (c))
SELECT sets.doc_id, coalesce(root, sets.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links,
       coalesce(c, sets.doc_id) AS copy_of, coalesce(size, 1)::BIGINT AS group_size,
       coalesce(root = sets.doc_id, TRUE) AS kept
FROM sets LEFT JOIN named ON sets.doc_id = named.doc_id
""")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word shingles, similarity 0.8."""
    return ngram_join.similar_documents(spark, table(spark, sf_dir, "documents")).drop("rid")


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier chain over every document; ``flagged`` is the toxic verdict."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit_chain(spark, id_and_text(docs), label_rows(spark, sf_dir), CATEGORIES)
    return toxicity.score(docs, chain)


@register("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into bins of 2,048 words."""
    return packing.pack(packing.items(table(spark, sf_dir, "documents"), 2048), capacity=2048)


@register("op5_quality_rules", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
      FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
many AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri)
         WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM many, (SELECT unnest(range(3)) AS k) GROUP BY 1),
base AS (SELECT w.doc_id, t, ws, len(ws)::BIGINT AS n_words,
                length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                len(ls)::BIGINT AS n_lines,
                (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                coalesce(rep.n, 0)::BIGINT AS n_repeat_words
         FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM base),
v AS (SELECT *,
  CASE WHEN word_chars < 3 * n_words THEN 1 WHEN word_chars > 12 * n_words THEN 2
       WHEN 10 * n_symbols > n_words THEN 3 WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 4
       WHEN 5 * (length(t) - length(replace(t, '!', ''))) > n_words THEN 5
       WHEN 10 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * word_chars THEN 6
       WHEN 10 * (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) > 3 * word_chars THEN 7
       WHEN 10 * len([x FOR x IN ws IF regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')]) < 7 * n_words
       THEN 8 ELSE 0 END AS failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND failed = 0) AS kept
FROM v
""")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the cascade's verdict.

    Which rule rejects a document first depends on measured costs, so that column stays
    with the operator.
    """
    return quality.apply_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


@register("op6_collinear_chaining")
def op6_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages of 50 words or more that every document shares with others."""
    return chaining.repeated_passages(spark, table(spark, sf_dir, "documents"))


@register("op7_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
           FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every document by the stateful stream."""
    return exact_dedup.exact_groups(spark, f"{sf_dir.rstrip('/')}/documents.parquet").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op8_token_store")
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as bit-packed ids in files, read back from them."""
    path = scratch_path(spark, "token-store")
    manifest = token_store.write_store(spark, table(spark, sf_dir, "documents"), path,
                                       tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_store.read_store(spark, path, manifest)


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@register("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with remainder 2 teach nothing."""
    docs = table(spark, sf_dir, "documents")
    trees = langid.fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text"))
    return langid.predict(docs, trees).withColumn("held_out", held_out(F.col("doc_id")))


@register("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, compared with sentencepiece and spelled back."""
    return spm_backend.encode_documents(table(spark, sf_dir, "documents"),
                                        tokenizer_path("piece_bpe_32k.model")).drop("ids")


def lloyd_sql(k: int, rounds: int) -> str:
    """The rounds unrolled: components as rows, centroids as rows."""
    ctes = [r"""
kept AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
         WHERE len(embedding) = 64
           AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS z
       FROM (SELECT v, sha256('3:' || vec_id) AS h FROM kept ORDER BY h LIMIT %d))""" % k]
    near = """
a%d AS (SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d
        FROM (SELECT vec_id, v, c, list_sum([(v[i] - z[i]) ** 2 FOR i IN range(1, 65)])::BIGINT AS d
              FROM kept, c%d) GROUP BY vec_id, v)"""
    for r in range(rounds):
        ctes += [near % (r, r), """
m%d AS (SELECT c, list(s ORDER BY i) AS z
        FROM (SELECT c, i, floor(sum(x)::HUGEINT / count(*))::BIGINT AS s
              FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a%d)
              GROUP BY c, i) GROUP BY c),
c%d AS (SELECT c%d.c, coalesce(m%d.z, c%d.z) AS z FROM c%d LEFT JOIN m%d ON c%d.c = m%d.c)""" % (
            r, r, r + 1, r, r, r, r, r, r, r)]
    ctes.append(near % (rounds, rounds))
    return "WITH " + ",".join(ctes) + """
SELECT a.vec_id, a.c::INT AS cluster, a.d AS distance,
       (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(z.z, ',')) AS centroid_sha256
FROM a%d a JOIN c%d z ON a.c = z.c""" % (rounds, rounds)


@register("op11_centroid_clustering", lloyd_sql(8, 10))
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector of ``embeddings`` in one of 8 clusters after 10 rounds."""
    return bit_planes.cluster_vectors(spark, table(spark, sf_dir, "embeddings"), k=8, rounds=10,
                                      seed="3:").drop("cluster_size")


@register("op12_first_fit_packing")
def op12_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 4,096."""
    return ffd_packing.pack(spark, table(spark, sf_dir, "documents"),
                            tokenizer_path("word_bpe_49k.json"), end_id=2)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the faults of the contract; ``copies`` 0 marks a row dropped."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault < 2, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
        .alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


@register("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    rows = damaged(table(spark, sf_dir, "conversations"))
    return turn_repair.repair(spark, rows, copies_col="copies")
