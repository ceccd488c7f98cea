"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


@query(
    "op7_exact_dedup",
    """
    WITH d AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents
    )
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM d WINDOW g AS (PARTITION BY t)
    """,
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import groups

    return groups(table(spark, sf_dir, "documents"))


@query("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import plan

    p = plan(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "shards")


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import groups

    return groups(table(spark, sf_dir, "documents"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lang_id import predictions

    return predictions(table(spark, sf_dir, "documents"))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secret_scan import report

    return report(table(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import scores

    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_embedding_near_dedup")
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.hnsw import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_index import report

    return report(table(spark, sf_dir, "documents"))


@query(
    "op3_line_dedup",
    """
    WITH RECURSIVE lines AS (
      SELECT doc_id, (unnest(range(len(p))))::INTEGER AS line_no, unnest(p) AS line
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
    ),
    places AS (SELECT * FROM lines WHERE trim(line, ' ') <> ''),
    distinct_lines AS MATERIALIZED (
      SELECT line, count(*) AS n_copies, min({'d': doc_id, 'l': line_no}) AS first,
             row_number() OVER (ORDER BY min({'d': doc_id, 'l': line_no})) AS id
      FROM places GROUP BY line
    ),
    pairs AS MATERIALIZED (
      SELECT a.id AS a, b.id AS b
      FROM distinct_lines a JOIN distinct_lines b
        ON length(b.line) BETWEEN length(a.line) - 2 AND length(a.line) + 2 AND a.id < b.id
      WHERE length(a.line) >= 24 AND length(b.line) >= 24
        AND levenshtein(a.line, b.line) <= 2
    ),
    links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach AS (
      SELECT a AS id, a AS seen FROM links
      UNION
      SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.seen
    ),
    comp AS (SELECT id, min(seen) AS root FROM reach GROUP BY id),
    degree AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
    SELECT p.doc_id, p.line_no, d.n_copies, coalesce(g.n_links, 0) AS n_links,
           r.first.d AS first_doc_id, r.first.l AS first_line_no,
           p.doc_id = r.first.d AND p.line_no = r.first.l AS kept
    FROM places p JOIN distinct_lines d ON p.line = d.line
    LEFT JOIN comp ON comp.id = d.id LEFT JOIN degree g ON g.id = d.id
    JOIN distinct_lines r ON r.id = coalesce(comp.root, d.id)
    """,
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import classes

    return classes(table(spark, sf_dir, "documents"))


@query(
    "op13_filter_audit",
    """
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
    ),
    l AS (
      SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id
    ),
    w AS (
      SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             min(doc_id) OVER (PARTITION BY t) AS first_id
      FROM d
    ),
    f AS (
      SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
             [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
              100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first_id, false)] AS fails
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id
    ),
    cells AS (
      SELECT part, fails, count(*) AS n, sum(good)::BIGINT AS n_good, sum(toxic)::BIGINT AS n_toxic
      FROM f GROUP BY part, fails
    ),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    orders AS (
      SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
      FROM letters a, letters b, letters c, letters d, letters e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
    ),
    steps AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM orders),
    seen AS (
      SELECT part, filter_order, step, n, n_good, n_toxic, fails,
             ascii(filter_order[step]) - 64 AS k, fails[ascii(filter_order[step]) - 64] AS here,
             len(list_filter(range(1, step), lambda i: fails[ascii(filter_order[i]) - 64])) > 0 AS gone
      FROM cells, steps
    ),
    counts AS (
      SELECT part, filter_order, step, any_value(k) AS k,
             coalesce(sum(n) FILTER (NOT here AND NOT gone), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (here AND len(list_filter(fails, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
             coalesce(sum(n_good) FILTER (here AND NOT gone), 0)::BIGINT AS good_lost,
             coalesce(sum(n_toxic) FILTER (here AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM seen GROUP BY part, filter_order, step
    )
    SELECT * EXCLUDE (k), (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM counts
    """,
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op11_phrase_collocations",
    """
    WITH d AS (
      SELECT coalesce(lang, 'und') AS lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents
    ),
    pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
    ws AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws),
    lengths AS (SELECT unnest(range(1, 5)) AS m),
    f AS MATERIALIZED (
      SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
      FROM places JOIN lengths ON i + m - 1 <= len(w) GROUP BY ALL
    ),
    words AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 30),
    cuts AS (SELECT *, unnest(range(1, m)) AS k FROM c),
    scores AS (
      SELECT cuts.lang, cuts.phrase, cuts.a, k, x.f AS l, y.f AS r,
             (2000000::HUGEINT * cuts.a // (x.f + y.f))::BIGINT AS score
      FROM cuts
      JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:k], ' ')
      JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[k + 1:], ' ')
    ),
    best AS (
      SELECT * FROM scores
      QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ),
    parts AS (
      SELECT DISTINCT c.lang, c.phrase AS longer, c.a, array_to_string(c.w[i:i + p.m - 1], ' ') AS phrase
      FROM c, lengths p, (SELECT unnest(range(1, 4)) AS i)
      WHERE p.m >= 2 AND p.m < c.m AND i + p.m - 1 <= c.m
    ),
    kept AS (
      SELECT * FROM best
      WHERE NOT EXISTS (
        FROM parts p WHERE p.lang = best.lang AND p.phrase = best.phrase AND 100::HUGEINT * p.a >= 80::HUGEINT * best.a
      )
    )
    SELECT kept.lang, row_number() OVER o AS rank, phrase, a, l, r, n, score
    FROM kept JOIN words USING (lang)
    WINDOW o AS (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase)
    QUALIFY row_number() OVER o <= 2000
    """,
)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query("op12_word_bpe")
def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.word_bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"))
