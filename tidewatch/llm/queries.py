"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    centroid_clustering, collocations, html_extract, language_id, media_jpeg, nearest_neighbours, ngram_join, packing, quality_rules, sentencepiece_viterbi, substring_dedup, suffix_dedup, url_filters,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokens_packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_packed(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """Predictions for all documents by prototypes of those that are not held out."""
    prototypes = language_id.train(docs.filter(~held_out()))
    return language_id.identify(docs, prototypes)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = language_id.train(docs.filter(~held_out()))
    return language_id.identify(docs.select("doc_id", "text"), prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    verdict = quality_rules.train(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, verdict).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "quality_score")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media_jpeg.store(docs, "text")
    return stored.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "stored.payload_bytes",
        "stored.payload_sha256",
        "stored.tail_crc32",
        F.octet_length("stored.media").cast("long").alias("media_bytes"),
        F.sha2("stored.media", 256).alias("media_sha256"),
        "stored.feature",
        "stored.height",
        "stored.width",
        "stored.rgb",
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, counted and hashed, and what they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_viterbi.digest(docs, model).select("doc_id", "digest.*")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clustering.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id 50 divides; all rows are searched."""
    return nearest_neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("text", "lang"), least=30, top=2000)


def queries() -> dict:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_packing": op2_packing,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_language_id": op4_language_id,
        "op5_html_extraction": op5_html_extraction,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_media_columns": op8_media_columns,
        "op9_url_filters": op9_url_filters,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_nearest_neighbours": op12_nearest_neighbours,
        "op13_collocations": op13_collocations,
    }


#: Words of every text, in order.
_WORDS = r"""words AS (
  SELECT doc_id, list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)"""

_OP1 = (
    "WITH RECURSIVE "
    + _WORDS.replace("{text}", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """
, sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), shared AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS common FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT x, y FROM shared WHERE 100 * common >= 75 * (nx + ny - common)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) c ON c.a = s.doc_id"""
)

_OP3 = """WITH raw AS (SELECT doc_id, text AS t, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), wins AS (SELECT doc_id, unnest(range(0, n - 399)) AS p, h FROM raw WHERE n >= 400
), keys AS (SELECT doc_id, p, md5(substring(h, 2 * p + 1, 800)) AS k FROM wins
), many AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM keys) WHERE c > 1
), gaps AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS fresh FROM many
), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM gaps
), spans AS (SELECT doc_id, r, min(p) AS a, max(p) + 400 AS b FROM runs GROUP BY 1, 2
), cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM spans
), kept AS (SELECT c.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substring(h, 2 * since + 1, 2 * (a - since)) || CASE WHEN next IS NULL THEN substring(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS rest
  FROM cut c JOIN raw USING (doc_id) GROUP BY 1)
SELECT r.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256,
  CASE WHEN t IS NOT NULL THEN decode(unhex(coalesce(rest, h))) END AS text FROM raw r LEFT JOIN kept k ON k.doc_id = r.doc_id"""

_OP6 = (
    "WITH "
    + _WORDS.replace("{text}", "coalesce(text, '')")
    + """
, wins AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM words WHERE len(w) >= 20
), keys AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS k FROM wins
), late AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM keys) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, p + i AS at FROM late, (SELECT unnest(range(20)) AS i)
), gone_list AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1
), one AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM words
), kept AS (SELECT o.doc_id, string_agg(word, ' ' ORDER BY o.at) AS rest FROM one o ANTI JOIN gone g ON g.doc_id = o.doc_id AND g.at = o.at GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM words w LEFT JOIN gone_list g ON g.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id"""
)


#: Vectors without null or non-finite components.
_REAL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op11(k: int = 16, rounds: int = 3) -> str:
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_REAL} AND len(embedding) = 64)""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS (SELECT row, vec_id, v, c, d FROM (SELECT x.*, c, list_sum(list_transform(range(1, 65), lambda j: (x.v[j] - y.v[j]) * (x.v[j] - y.v[j]))) AS d FROM kept x, c{i} y)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY j) AS v FROM (SELECT c, j, sum(CAST(x AS HUGEINT)) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c
), c{i + 1} AS (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))"""
            )
    return (
        "WITH "
        + "\n, ".join(steps)
        + f"""
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(o.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} o USING (c)"""
    )


_OP12 = f"""WITH real AS (SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {_REAL} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
  FROM real q JOIN real c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM pairs QUALIFY rank <= 5"""

_OP13 = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), places AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS m)
), counts AS (SELECT lang, m, w[i:i + m - 1] AS w, count(*) AS f FROM places GROUP BY ALL
), totals AS (SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY 1
), long AS (SELECT * FROM counts WHERE m > 1 AND f >= 30
), cuts AS (SELECT c.lang, c.w, c.m, c.f AS a, l.f AS l, r.f AS r, CAST(2000000 AS HUGEINT) * c.f // (CAST(l.f AS HUGEINT) + r.f) AS score, k
  FROM (SELECT *, unnest(range(1, m)) AS k FROM long) c JOIN counts l ON l.lang = c.lang AND l.w = c.w[1:c.k] JOIN counts r ON r.lang = c.lang AND r.w = c.w[c.k + 1:c.m]
), scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1
), inner_ AS (SELECT lang, w[i:i + s - 1] AS w, max(f) AS longer FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM long)) GROUP BY 1, 2
), kept AS (SELECT s.lang, array_to_string(s.w, ' ') AS phrase, a, l, r, score FROM scored s LEFT JOIN inner_ i ON i.lang = s.lang AND i.w = s.w WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express; the others rest on tokenizers, trained models or a file format."""
    return {"op1_ngram_join": _OP1, "op3_suffix_dedup": _OP3, "op6_substring_dedup": _OP6, "op11_centroid_clustering": _op11(), "op12_nearest_neighbours": _OP12, "op13_collocations": _OP13}
