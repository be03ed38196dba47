"""The registered opN_ queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.decontaminate import find_windows
from weftline.llm.exact_dedup import exact_dedup
from weftline.llm.language_id import fit, identify, is_held_out
from weftline.llm.license_scan import license_scan
from weftline.llm.line_dedup import line_dedup
from weftline.llm.lm_score import score_corpus
from weftline.llm.ngram_join import near_groups
from weftline.llm.packing import pack_documents
from weftline.llm.secret_scan import ALLOW, CLASSES, secret_scan, spelled
from weftline.llm.token_files import checksums, read_tokens, token_folder, write_tokens

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op2_line_dedup",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT r, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {UPPER_LOWER}) AS key FROM l),
    frequent AS (SELECT key FROM (SELECT DISTINCT r, key FROM k WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10),
    m AS (SELECT k.r, k.line, k.pos, f.key IS NOT NULL AS gone FROM k LEFT JOIN frequent f ON k.key = f.key),
    g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
                 coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r)
    SELECT d.doc_id, g.n_lines::BIGINT AS n_lines, g.n_dropped::BIGINT AS n_dropped, sha256(g.kept) AS kept_sha256
    FROM d JOIN g ON d.r = g.r
    """,
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op8_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT d.doc_id, g.keep_id, g.group_size::BIGINT AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
    FROM d JOIN g ON d.t = g.t
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def _span_sql(kind: str, rank: int, pattern: str, part: int = 0) -> str:
    """Spans of a pattern from the matches and what lies between them."""
    return f"""
    {kind} AS (
      SELECT r, {rank} AS rank, '{kind}' AS kind, value, part, s AS start_, s + length(value) AS end_ FROM (
        SELECT r, value, part, (sum(length(gap)) OVER w + coalesce(sum(length(value)) OVER w, 0) - length(value))::BIGINT AS s FROM (
          SELECT r, unnest(ms) AS value, unnest(ps) AS part, unnest(gaps[1:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i FROM (
            SELECT r, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {part}) AS ps, string_split_regex(t, '{pattern}') AS gaps
            FROM d WHERE regexp_matches(t, '{pattern}')))
        WINDOW w AS (PARTITION BY r ORDER BY i)))"""


def _entropy_sql(kind: str, cls, taken: str) -> str:
    """Candidates, the entropy sum of each of their windows, and the spans that the windows over the threshold cover."""
    return f"""{_span_sql(kind + "_all", 0, cls.pattern)},
    {kind}_candidates AS (SELECT * FROM {kind}_all WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '{ALLOW}')),
    {kind}_windows AS (SELECT r, start_, i, substring(value, i, {cls.least}) AS win FROM (SELECT *, unnest(range(1, (length(value) - {cls.least} + 2)::BIGINT)) AS i FROM {kind}_candidates)),
    {kind}_sums AS (SELECT r, start_, i, sum(({cls.log_sums}::BIGINT[])[n + 1]) AS total FROM (
        SELECT r, start_, i, ch, count(*) AS n FROM (SELECT r, start_, i, unnest(string_split(win, '')) AS ch FROM {kind}_windows) GROUP BY ALL) GROUP BY ALL),
    {kind}_over AS (SELECT r, start_ + min(i) - 1 AS s, start_ + max(i) - 1 + {cls.least} AS e FROM {kind}_sums WHERE total <= {cls.limit} GROUP BY r, start_),
    {kind} AS (SELECT o.r, {3 + CLASSES.index(cls)} AS rank, '{kind}' AS kind, s AS start_, e AS end_ FROM {kind}_over o
        WHERE NOT EXISTS (SELECT 1 FROM {taken} b WHERE b.r = o.r AND b.start_ < o.e AND o.s < b.end_))"""


def _secret_sql() -> str:
    from weftline.llm import secret_scan as m

    quoted = m.ASSIGN.replace("'", "''")
    first, second = CLASSES
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    {_span_sql("assign", 0, quoted, 2)}, {_span_sql("access", 1, m.ACCESS)}, {_span_sql("hex", 2, m.HEX)},
    base AS (SELECT r, rank, kind, start_, end_ FROM assign WHERE length(part) >= {m.ASSIGN_LEAST}
        UNION ALL SELECT r, rank, kind, start_, end_ FROM access UNION ALL SELECT r, rank, kind, start_, end_ FROM hex),
    {_entropy_sql(first.kind, first, "base")},
    more AS (SELECT * FROM base UNION ALL SELECT * FROM {first.kind}),
    {_entropy_sql(second.kind, second, "more")},
    spans AS (SELECT * FROM more UNION ALL SELECT * FROM {second.kind}),
    b AS (SELECT r, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
        string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, rank) AS s FROM base GROUP BY r),
    a AS (SELECT r, string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, rank) AS s FROM spans GROUP BY r)
    SELECT d.doc_id, coalesce(b.n_assign, 0)::BIGINT AS n_assign, coalesce(b.n_access, 0)::BIGINT AS n_access, coalesce(b.n_hex, 0)::BIGINT AS n_hex,
        sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans
    FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN a ON a.r = d.r
    """


@query("op5_secret_scan", _secret_sql())
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spelled(F.col("base_spans")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


@query("op6_ngram_jaccard")
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), width=5, num=75, den=100)


_WORDS_SQL = rf"""regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"""


@query(
    "op7_decontamination",
    f"""
    WITH item AS (SELECT item_id::VARCHAR AS item_id, {_WORDS_SQL} AS w FROM benchmark),
    win AS (SELECT item_id, least(len(w), 10) AS n, w[b:b + least(len(w), 10) - 1] AS ws
            FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS b FROM item WHERE len(w) > 0)),
    keyed AS (SELECT DISTINCT item_id, n, array_to_string(ws, ' ') AS s FROM win),
    d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
    -- a first word that some window starts with is looked at
    heads AS (SELECT DISTINCT n, string_split(s, ' ')[1] AS head FROM keyed),
    words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
    near AS (SELECT words.r, words.p, h.n FROM words JOIN heads h ON words.x = h.head),
    texts AS (SELECT near.r, near.p, near.n, array_to_string(d.w[near.p:near.p + near.n - 1], ' ') AS s FROM near JOIN d ON d.r = near.r WHERE near.p + near.n - 1 <= len(d.w)),
    hit AS (SELECT t.r, t.p, t.n, k.item_id FROM texts t JOIN keyed k ON k.n = t.n AND k.s = t.s),
    cover AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
    ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(i.s, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN cover c ON c.r = d.r LEFT JOIN ids i ON i.r = d.r
    """,
)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_windows(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    n_hit = F.size("hits").cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op1_token_binary")
def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_folder(spark)
    files = write_tokens(documents(spark, sf_dir), folder)
    return checksums(read_tokens(spark, folder, files))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = fit(docs.where(~is_held_out()))
    return identify(docs, profiles).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(documents(spark, sf_dir))
    spelt = F.transform("findings", lambda x: F.concat_ws(":", x["line"], x["license"], x["missing"], x["extra"]))
    names = F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["license"])))
    return out.select("doc_id", F.size("findings").cast("long").alias("n_findings"), F.array_join(names, ",").alias("licenses"), F.array_join(spelt, ",").alias("findings"))


@query("op10_lm_score")
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(documents(spark, sf_dir))
