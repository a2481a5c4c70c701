"""Registered queries of the training-data operators, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, html_extract, language_id, license_scan, ngram_join, substring_dedup, toxicity, url_filter

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(read(spark, sf_dir, "documents")).drop("keep_locator")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"), 3, 1)
    found = language_id.identify(docs, language_id.fit(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(read(spark, sf_dir, "documents")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), vocabulary_path())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeated(read(spark, sf_dir, "documents")))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"), 5, 0)
    found = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels"), ~out))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_ngram_join, op4_license_scan, op5_bpe, op6_substring_dedup, op7_html_extract, op8_toxicity, op9_url_filter, op10_decontaminate)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Phrases and notices as rows (template, label, text, base).
_TEMPLATES = [(t, *row) for t, row in enumerate([(v, k, True) for k, v in license_scan.PHRASES.items()] + [(*n, False) for n in license_scan.NOTICES])]

ORACLE = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op3_ngram_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        x AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        e AS (SELECT u, v FROM x JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * c >= 80 * (p.n + q.n - c)),
        r(id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.v FROM r JOIN e ON r.other = e.u),
        c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id""",
    "op4_license_scan": rf"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
        t(template, label, txt, base) AS (VALUES {", ".join(f"({t}, '{label}', '{text}', {base})" for t, label, text, base in _TEMPLATES)}),
        g AS (SELECT template, label, base, len(w) AS size, i AS tpos, w[i + 1] AS one, w[i + 2] AS two FROM (SELECT *, string_split(txt, ' ') AS w, unnest(range(0, len(string_split(txt, ' ')) - 1)) AS i FROM t)),
        p AS (SELECT k, pos, w[pos + 1] AS one, w[pos + 2] AS two FROM (SELECT k, w, unnest(range(0, greatest(len(w) - 1, 0))) AS pos FROM d)),
        v AS (SELECT k, template, label, base, size, pos, tpos, pos - tpos AS diagonal FROM p JOIN g USING (one, two)),
        dg AS (SELECT k, template, base, diagonal, min(pos) AS lo, max(pos) AS hi FROM v GROUP BY ALL),
        nw AS (SELECT *, CASE WHEN NOT base AND diagonal - lag(diagonal) OVER o <= {license_scan.GAP} AND lo - lag(hi) OVER o <= {license_scan.GAP} + 1 THEN 0 ELSE 1 END AS fresh
               FROM dg WINDOW o AS (PARTITION BY k, template ORDER BY diagonal)),
        bd AS (SELECT *, sum(fresh) OVER (PARTITION BY k, template ORDER BY diagonal) AS band FROM nw),
        u AS (SELECT v.*, bd.band FROM v JOIN bd USING (k, template, diagonal)),
        c(k, template, band, pos, tpos, n) AS (
            SELECT k, template, band, pos, tpos, 1 FROM u
            UNION SELECT u.k, u.template, u.band, u.pos, u.tpos, c.n + 1 FROM c JOIN u ON u.k = c.k AND u.template = c.template AND u.band = c.band AND u.pos > c.pos AND u.tpos > c.tpos),
        lg AS (SELECT k, template, band, max(n) AS n FROM c GROUP BY ALL),
        sp AS (SELECT u.k, u.label, u.base, min(u.pos) AS start, any_value(lg.n) / (u.size - 1) AS cover
               FROM u JOIN lg USING (k, template, band) GROUP BY u.k, u.template, u.band, u.label, u.base, u.size),
        ok AS (SELECT * FROM sp WHERE cover >= CASE WHEN base THEN 1 ELSE {license_scan.COVER} END),
        r AS (SELECT k, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
              FROM ok GROUP BY k)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM d LEFT JOIN r USING (k)""",
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d),
        x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
        o AS (SELECT h, min(doc_id) AS origin FROM x GROUP BY h),
        b AS (SELECT doc_id, i FROM x JOIN o USING (h) WHERE origin < doc_id),
        r AS (SELECT DISTINCT doc_id, i + j AS k FROM b, range(0, 50) AS t(j)),
        n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
        u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
        k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.k) AS kept FROM u ANTI JOIN r ON u.doc_id = r.doc_id AND u.k = r.k GROUP BY u.doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op10_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
               FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
        z AS (SELECT DISTINCT size FROM bw),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS t FROM p, z WHERE i + size - 1 <= len(w)),
        h AS (SELECT dw.doc_id, dw.i, dw.size, bw.item FROM dw JOIN bw ON dw.t = bw.t AND dw.size = bw.size),
        n AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, range(0, 10) AS t(j) WHERE j < h.size GROUP BY doc_id),
        m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(m.s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op9_url_filter": rf"""
        WITH r(v, h, p) AS (VALUES {", ".join(str(r) for r in url_filter.RULES)}),
        x AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
        u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM x),
        m AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
              FROM u JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
        SELECT u.page_id, u.host, u.path, m.rule,
               coalesce(m.v, CASE WHEN list_has_any(string_split(replace(u.host, '-', '.'), '.'), {url_filter.LISTED_WORDS}) THEN 'block' ELSE 'allow' END) AS verdict
        FROM u LEFT JOIN m USING (page_id)""",
}
