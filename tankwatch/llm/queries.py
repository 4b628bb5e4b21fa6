"""The registered queries of this package, each a thin digest of its operator's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tankwatch.llm import collocations, conversations, decontaminate, embeddings, language, lines, lm, ngram_join, packing, spots, substrings, toxicity, url_filter
from tankwatch.llm.common import large, remainder, table

#: The listing that op5 judges by.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("toxic is not null").select("doc_id", "toxic")
    model = toxicity.fit(docs.where(remainder(F.col("doc_id")) != 0).join(large(labels), "doc_id"))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = language.fit_dictionaries(docs.where(remainder(F.col("doc_id")) != 0))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return language.identify(docs, learned).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted", "margin")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    scored = lm.score(docs, docs.where(remainder(F.col("doc_id")) != 1))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.ngram_join(docs, words=3, percent=90)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return collocations.collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spots.compare_edits(docs).drop("edited")


QUERIES = {"op1_toxicity": op1_toxicity, "op2_embeddings": op2_embeddings, "op3_language": op3_language, "op4_lm": op4_lm, "op5_url_filter": op5_url_filter, "op6_ngram_join": op6_ngram_join, "op7_decontaminate": op7_decontaminate, "op8_substrings": op8_substrings, "op9_packing": op9_packing, "op10_lines": op10_lines, "op11_collocations": op11_collocations, "op12_conversations": op12_conversations, "op13_spots": op13_spots}

#: DuckDB SQL for the queries that SQL can express.
SQL = {
    "op2_embeddings": r"""
        WITH RECURSIVE good AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        reach(node, other) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
        least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
        FROM embeddings e JOIN least l ON l.node = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
    """,
    "op5_url_filter": r"""
        WITH parts AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (
            SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
        rules(rule_host, rule_path, verdict) AS (
            VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        fits AS (
            SELECT p.*, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST, length(rule_host) DESC) AS place
            FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        spots AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(w) >= k),
        f AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, CAST(count(*) AS HUGEINT) AS a FROM spots GROUP BY ALL),
        total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM worded GROUP BY lang),
        cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
        cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM cand),
        scored AS (
            SELECT c.*, l.a AS l, r.a AS r, (2000000 * c.a) // (l.a + r.a) AS score FROM cuts c
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, c.cut), ' ')
            JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, c.cut + 1, c.k), ' ')),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inner_ AS (
            SELECT lang, a AS longer, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
            FROM (SELECT c.lang, c.a, c.w, m, unnest(range(1, c.k - m + 2)) AS i FROM cand c, (VALUES (2), (3)) AS parts(m) WHERE m < c.k)),
        longest AS (SELECT lang, phrase, max(longer) AS longer FROM inner_ GROUP BY ALL),
        kept AS (SELECT b.* FROM best b LEFT JOIN longest g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.longer IS NULL OR 100 * g.longer < 80 * b.a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
    """,
}
