"""The queries of this subpackage: every operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str):
    def put(fn):
        QUERIES[name] = fn
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of every document by the compiled transducer."""
    from recordlake.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@register("op10_bpe_codec")
def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and decoded text."""
    from recordlake.llm.bpe_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), digests=True)


@register("op9_warc")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to WARC archives in the shared folder and reads them back."""
    from recordlake.llm.warc import read_archives, write_archives
    from recordlake.session import scratch_dir

    path = write_archives(table(spark, sf_dir, "pages"), f"{scratch_dir(spark, 'warc')}/archives")
    return read_archives(spark, path, payloads=False).select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


ORACLE["op9_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS leader FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> leader THEN leader END AS refers_to
FROM g
"""


@register("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; fitted on labels outside the held-out fold."""
    from recordlake.llm.quality_classifier import score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(crc_fold() != 0))
    return score(docs, model).select("doc_id", (crc_fold() == 0).alias("held_out"), "score",
                                     (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learned from those outside the held-out fold."""
    from recordlake.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.where(crc_fold() != 0))).select(
        "doc_id", (crc_fold() == 0).alias("held_out"), "lang_pred", "score")


@register("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and weakly supervised verdict for every document."""
    from recordlake.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


@register("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    import public_tokenizers

    from recordlake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@register("op1_embedding_near_dedup")
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with equal labels at cosine 0.93."""
    from recordlake.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE["op1_embedding_near_dedup"] = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), u AS (
  SELECT * FROM e
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x : x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x : x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(vec_id, via) AS (
  SELECT vec_id, vec_id FROM e
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.via
), root AS (SELECT vec_id, min(via) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN root USING (vec_id) LEFT JOIN n USING (vec_id)
"""


@register("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 85 % similarity of their five-word shingles."""
    from recordlake.llm.minhash_forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


#: The sets as DuckDB lists; a link needs a common shingle, so pairs come from the shingles' postings.
ORACLE["op3_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i + 4], ' '))) END AS g FROM d
), u AS (
  SELECT g, min(doc_id) AS rep, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM s) WHERE len(g) > 0 GROUP BY g
), p AS (SELECT rep, n, unnest(g) AS x FROM u
), link AS (
  SELECT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.x = b.x AND a.rep <> b.rep
   AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(rep, via) AS (
  SELECT rep, rep FROM u UNION SELECT r.rep, l.b FROM reach r JOIN link l ON l.a = r.via
), root AS (SELECT rep, min(via) AS component_id FROM reach GROUP BY rep)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(root.component_id, s.doc_id) AS component_id,
       coalesce(root.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN u ON u.g = list_sort(s.g) LEFT JOIN root USING (rep)
"""


@register("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that all documents share, at similarity 0.8."""
    from recordlake.llm.substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "start_word", "end_word", F.col("ref").alias("ref_doc_id"), "ref_start_word",
        "ref_end_word", "similarity")


@register("op13_fill_in_middle")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document's output, and of the text rebuilt from it."""
    from recordlake.llm.fill_in_middle import transform

    return transform(table(spark, sf_dir, "documents"), digests=True)


ORACLE["op13_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id::VARCHAR) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents
), n AS (
  SELECT *, len(w)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n
), p AS (
  SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS prefix, coalesce(array_to_string(w[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(w[b + 1:], ''), '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@register("op12_source_divergence")
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence between all sources of each language, and each source's terms in excess."""
    from recordlake.llm.source_divergence import audit

    return audit(table(spark, sf_dir, "documents"))


ORACLE["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs
  FROM (SELECT k, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM c GROUP BY lang, term HAVING sum(docs) >= 10
), l AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM kept GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), full_counts AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n, kept.lang_n
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), p AS (
  SELECT f.lang, f.source, f.term, f.n, 1 + 1000000000 * (f.n + 2) // (sum(f.n) OVER (PARTITION BY f.lang, f.source)::HUGEINT + 2 * l.v) AS p,
         1 + 1000000000 * (f.lang_n + 2) // (l.total + 2 * l.v) AS q
  FROM full_counts f JOIN l USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms)
WHERE rank <= 10
"""


@register("op11_recursive_bpe")
def op11_recursive_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and decoded bytes, by recursive queries in the tasks."""
    import public_tokenizers

    from recordlake.llm.recursive_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"),
                         public_tokenizers.PATTERN, digests=True)
