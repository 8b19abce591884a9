"""The registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import (
    alignment,
    exact,
    licenses,
    mixing,
    packing,
    periodic,
    quality,
    secrets,
    sentences,
    simhash,
    token_output,
    toxicity,
    url_rules,
)
from linkloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"))


def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judged_urls(_table(spark, folder, "pages"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, folder, "documents"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(_table(spark, folder, "documents"))


def op6_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_output.packed_ids(_table(spark, folder, "documents"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(_table(spark, folder, "documents"))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, folder, "documents"))
    rules = secrets.BASE + secrets.ADDED
    base = F.concat(*[F.col(r.kind) for r in secrets.BASE])
    every = F.concat(*[F.col(r.kind) for r in rules])
    return found.select(
        "doc_id",
        *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE],
        F.sha2(F.encode(secrets.listed(base, rules), "UTF-8"), 256).alias("base_sha256"),
        secrets.listed(every, rules).alias("spans"),
    )


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.repeated_spans(_table(spark, folder, "documents"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_planted_runs(_table(spark, folder, "documents")))
    top = periodic.longest_power(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.license_scan(_table(spark, folder, "documents"))
    at = F.transform("places", lambda p: p["at"].cast("long"))
    base = licenses.base_labels(F.col("places"))
    every = F.array_sort(F.array_union(base, F.transform("met", lambda m: m["label"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        licenses.score(F.col("places"), F.col("met")).alias("score"),
    )


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = alignment.alignments(_table(spark, folder, "documents"))
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2(F.encode("groups", "UTF-8"), 256))
    return alignment.scored(aligned.withColumn("groups_sha256", digest).drop("groups")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def queries() -> dict[str, Query]:
    import corpus_pipeline

    own = (op1_best_fit_packing, op2_url_rules, op3_simhash, op4_quality_rules, op5_exact_dedup, op6_token_output,
           op7_mixing, op8_secrets, op9_toxicity, op10_repeated_spans, op11_periodic_runs, op12_licenses,
           op13_alignment)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_EXACT_SQL = r"""
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM rows
"""


def _letters(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _secrets_sql() -> str:
    rules = secrets.BASE + secrets.ADDED
    cases = []
    for order, rule in enumerate(rules):
        pattern = rule.pattern
        if rule.kind == "assign":  # RE2 folds further letters into (?i)
            words = "|".join(_letters(w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
            pattern = pattern.replace("(?i:password|passwd|secret|token|api_?key)", words)
        pattern = pattern.replace("'", "''")
        cases.append(
            f"SELECT id, doc_id, {order} AS k, '{rule.kind}' AS kind, "
            f"unnest(regexp_extract_all(text, '{pattern}', 0)) AS match, unnest(regexp_extract_all(text, '{pattern}', {rule.group})) AS held, "
            f"unnest(string_split_regex(text, '{pattern}')) AS gap, {rule.least} AS least, "
            f"generate_subscripts(string_split_regex(text, '{pattern}'), 1) AS i "
            f"FROM texts WHERE regexp_matches(text, '{pattern}')"
        )
    named = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
steps AS ({' UNION ALL '.join(cases)}),
placed AS (
  SELECT *, sum(length(gap) + coalesce(length(match), 0)) OVER (PARTITION BY id, k ORDER BY i) AS e FROM steps
),
spans AS (
  SELECT id, k, kind, CAST(e - length(match) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed
  WHERE match IS NOT NULL AND length(held) >= least
),
found AS (
  SELECT id, {counts}, {named} AS spans, {named} FILTER (WHERE k < {len(secrets.BASE)}) AS base FROM spans GROUP BY id
)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN found USING (id)
"""


def _licenses_sql() -> str:
    def phrase(p: licenses.Phrase) -> str:
        stands = " AND ".join(f"words[i + {k}] = '{word}'" for k, word in enumerate(p.words, 1))
        return f"list_transform(list_filter(range(len(words)), lambda i: {stands}), lambda i: {{'place': i, 'label': '{p.label}'}})"

    half = licenses.BLOCK // 2
    asked = ", ".join(
        f"({number}, '{t.label}', {t.asks(licenses.THRESHOLD)}, {len(t.words)}, '{word}')"
        for number, t in enumerate(licenses.TEMPLATES) for word in t.words
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
bases AS (
  SELECT id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels
  FROM (SELECT id, unnest({" || ".join(map(phrase, licenses.BASE))}, recursive := true) FROM texts) GROUP BY id
),
placed AS (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM texts),
blocks AS (
  SELECT id, word, i // {half} AS block FROM placed
  UNION ALL SELECT id, word, i // {half} - 1 FROM placed WHERE i >= {half}
),
asked(template, label, asks, size, word) AS (VALUES {asked}),
shared AS (
  SELECT id, block, template, any_value(label) AS label, any_value(asks) AS asks, any_value(size) AS size,
    count(DISTINCT word) AS overlap
  FROM blocks JOIN asked USING (word) GROUP BY ALL
),
met AS (
  SELECT id, list(DISTINCT label) AS labels, max(overlap / size) AS score FROM shared WHERE overlap >= asks GROUP BY id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(bases.n, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(bases.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(bases.labels, []) || coalesce(met.labels, []))), ',') AS labels,
  CASE WHEN bases.n > 0 THEN 1.0 ELSE coalesce(met.score, 0.0) END::DOUBLE AS score
FROM texts LEFT JOIN bases USING (id) LEFT JOIN met USING (id)
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op5_exact_dedup": _EXACT_SQL, "op8_secrets": _secrets_sql(), "op12_licenses": _licenses_sql()}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
