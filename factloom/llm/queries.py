"""Registered queries of the corpus operators, and their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import ann, license_scan, line_dedup, mix, ngram_join, packing, quality_rules, secret_scan, spelling, token_counts, toxicity, vector_codes, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix.taken_words(mix.mix_sources(table(spark, folder, "documents").select("doc_id", "text", "source"), block_words=64, shard_blocks=4096, exact=False))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.classified(table(spark, folder, "documents"), ngram_join.Measure(words=4, percent=85))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_scan(table(spark, folder, "documents")).drop("templates")


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    files = warc.write_archives(table(spark, folder, "pages"), warc.archive_folder(spark))
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    m = quality_rules.judged(table(spark, folder, "documents").select("doc_id", "text"))
    return m.select("doc_id", *[f"_m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "_verdict.base_failed", "_verdict.kept")


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digests(table(spark, folder, "documents"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.digests(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_source_mix, op2_nearest_vectors, op3_best_fit_packing, op4_toxicity, op5_ngram_jaccard_join, op6_license_scan, op7_secret_scan, op8_warc, op9_quality_rules, op10_token_counts, op11_line_dedup, op12_spelling_variants, op13_vector_codes)}

def _codes_sql(rounds: int = 2) -> str:
    """Integer vectors, then rounds of nearest entries (e = entries, a = assignments), then codes and their errors."""
    near = """a{k} AS (SELECT r, p, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT x.r, x.p, e.c, list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
            FROM x JOIN e{k} e ON e.p = x.p) GROUP BY r, p),
        """
    move = """m{k} AS (SELECT a.p, a.c, i, sum(x.v[i]) AS t, count(*) AS n FROM a{j} a JOIN x ON x.r = a.r AND x.p = a.p, (SELECT unnest([1, 2, 3, 4]) AS i) GROUP BY ALL),
        n{k} AS (SELECT p, c, list((t - ((t % n) + n) % n) // n ORDER BY i) AS v FROM m{k} GROUP BY p, c),
        e{k} AS (SELECT e.p, e.c, coalesce(n.v, e.v) AS v FROM e{j} e LEFT JOIN n{k} n ON n.p = e.p AND n.c = e.c),
        """
    steps = "".join(near.format(k=k) + move.format(k=k + 1, j=k) for k in range(rounds)) + near.format(k=rounds)
    return f"""
        WITH u AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS (SELECT r, p, w[4 * p + 1:4 * p + 4] AS v FROM u, (SELECT unnest(range(16)) AS p)),
        e0 AS (SELECT p, r - 1 AS c, v FROM x WHERE r <= 64),
        {steps}h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) AS s FROM e{rounds}),
        k AS (SELECT r, string_agg(lpad(lower(to_hex(c)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.s AS codebooks_sha256 FROM k JOIN u ON u.r = k.r, h"""


ORACLES = {
    "op5_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        c AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT p, q FROM c JOIN n x ON x.doc_id = p JOIN n y ON y.doc_id = q WHERE 100 * c >= 85 * (x.n + y.n - c)),
        b AS (SELECT p AS u, q AS v FROM e UNION ALL SELECT q, p FROM e),
        r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.to_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.component_id
        FROM (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id) d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM q""",
    "op9_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        e AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        v AS (SELECT r, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM e WHERE len(w) > 2)),
        a AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM v),
        c AS (SELECT r, count(DISTINCT i + k) AS n FROM a, (VALUES (0), (1), (2)) AS x(k) WHERE c > 1 GROUP BY r),
        m AS (SELECT e.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
            CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
            len(list_filter(w, lambda x: lower(x) IN ('the', 'of', 'and', 'to', 'in', 'is', 'that', 'for', 'was', 'with', 'a', 'on', 'be', 'at', 'or', 'as', 'it', 'by', 'le', 'la', 'de', 'et', 'les',
              'des', 'en', 'un', 'une', 'du', 'que', 'qui', 'est', 'au', 'der', 'die', 'und', 'das', 'den', 'von', 'zu', 'mit', 'ist', 'auf', 'für', 'im', 'el', 'los', 'las', 'y', 'del', 'se',
              'por', 'con', 'para', 'una', 'no', 'su', 'es', 'lo'))) AS n_stop
          FROM e LEFT JOIN c ON c.r = e.r),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 14.0 * n_words AND n_symbols <= 0.3::DOUBLE * n_words AND n_dup_lines <= 0.35::DOUBLE * n_lines
            AND n_stop >= 0.04::DOUBLE * n_words AS kept FROM f""",
    "op11_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        x AS (SELECT r, doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM d),
        y AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM x),
        g AS (SELECT k, max(doc_id) AS top FROM y WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        z AS (SELECT y.*, g.k IS NOT NULL AND y.doc_id IS DISTINCT FROM g.top AS gone FROM y LEFT JOIN g ON g.k = y.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM z GROUP BY r, doc_id""",
    "op13_vector_codes": _codes_sql(),
}
