"""The thin queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import backoff, cascade, decontaminate, htmltext, iblt, intervals, langid, licences, mixing, oracles, quality, resample, simhash, tokenfile
from folioscope.llm.shared import crc32_mod4, shared_folder, table


def op3_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), words=4, bits=64, radius=4)
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_mod4() == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare_versions(table(spark, sf_dir, "documents"))


#: The tokenizer file of op4; a path on each machine.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    tokenfile.write(table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=2)
    return tokenfile.read(spark, folder)


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return checked.drop("text")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(table(spark, sf_dir, "documents"))


def op10_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_mod4() == 2, F.lit(False))
    machine = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.judge(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sales_and_sessions(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "clicks"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_simhash_near_dups": op3_simhash_near_dups,
    "op4_token_files": op4_token_files,
    "op5_benchmark_leaks": op5_benchmark_leaks,
    "op6_licence_scan": op6_licence_scan,
    "op7_html_main_text": op7_html_main_text,
    "op8_source_mix": op8_source_mix,
    "op9_lm_scores": op9_lm_scores,
    "op10_quality_scores": op10_quality_scores,
    "op11_quality_rules": op11_quality_rules,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_interval_overlaps": op13_interval_overlaps,
}

OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' || coalesce(source, '')) AS ord
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS everything
  FROM src),
rated AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS r,
    (everything - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM weighed),
common AS (SELECT arg_min(rate, r) AS rate FROM rated WHERE rate * weight < cap),
aim AS (
  SELECT source, source_size, least(cap, coalesce((SELECT rate FROM common) * weight, cap)) AS target, greatest(1, CAST(ceil(source_size / 262144.0::DOUBLE) AS BIGINT)) AS shards
  FROM rated),
placed AS (
  SELECT s.*, a.source_size, a.target, CAST('0x' || substr(ord, 1, 8) AS BIGINT) % a.shards AS shard
  FROM sized s JOIN aim a ON s.source IS NOT DISTINCT FROM a.source),
votes AS (
  SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size, CAST(ceil(sum(size) / 32.0::DOUBLE) AS BIGINT) AS blocks,
    CASE WHEN max(source_size) > 0 THEN max(target) * CAST(sum(size) AS BIGINT) / max(source_size) ELSE 0 END AS vote
  FROM placed GROUP BY source, shard),
even AS (SELECT *, CAST(floor(vote / 32 + 0.5) AS BIGINT) AS even FROM votes),
missing AS (SELECT CAST(round_even(sum(vote) / 32, 0) AS BIGINT) - CAST(sum(even) AS BIGINT) AS m, sum(vote) AS total FROM even),
steps AS (
  SELECT source, shard, vote, even, m, unnest(range(1, CAST(ceil(CAST(abs(m) AS DOUBLE) * vote / total) AS BIGINT) + 2)) AS step
  FROM even, missing WHERE total > 0 AND m <> 0),
more AS (SELECT source, shard FROM steps WHERE m > 0 QUALIFY row_number() OVER (ORDER BY vote / (2 * (even + step - 1) + 1) DESC, source NULLS LAST, shard, step) <= m),
less AS (SELECT source, shard FROM steps WHERE m < 0 AND step <= even QUALIFY row_number() OVER (ORDER BY vote / (2 * (even - step) + 1), source DESC NULLS FIRST, shard DESC, step DESC) <= -m),
change AS (SELECT source, shard, sum(c) AS c FROM (SELECT *, 1 AS c FROM more UNION ALL SELECT *, -1 FROM less) GROUP BY source, shard),
quota AS (
  SELECT e.source, e.shard, e.blocks, CAST(e.even + coalesce(c.c, 0) AS BIGINT) AS quota
  FROM even e LEFT JOIN change c ON e.source IS NOT DISTINCT FROM c.source AND e.shard = c.shard),
laid AS (
  SELECT p.*, q.blocks, q.quota, CASE WHEN q.blocks > 0 THEN q.quota // q.blocks ELSE 0 END AS rounds,
    CAST('0x' || substr(md5('mix:' || coalesce(p.source, '') || ':' || CAST(p.shard AS VARCHAR)), 1, 8) AS BIGINT) % greatest(q.blocks, 1) AS first,
    CAST(sum(p.size) OVER (PARTITION BY p.source, p.shard ORDER BY p.ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - p.size AS a
  FROM placed p JOIN quota q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard),
ends AS (SELECT *, a + size AS b, first * 32 AS lo, (first + quota - rounds * blocks) * 32 AS hi, blocks * 32 AS whole FROM laid)
SELECT doc_id, size, source_size, target,
  CAST(least(rounds * size + greatest(0, least(b, least(hi, whole)) - greatest(a, lo)) + greatest(0, least(b, hi - whole) - greatest(a, 0)), size * 2) AS BIGINT) AS taken
FROM ends
"""

def _licence_sql(threshold: float = 0.8) -> str:
    """DuckDB SQL of the licence scan; templates and their bigrams are made by SQL, too."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ",\n  ".join(f"({i}, {quote(name)}, {quote(text)})" for i, (name, text) in enumerate(licences.TEMPLATES))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    terms = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH templates(template, licence, body) AS (VALUES
  {rows}),
template_words AS (SELECT template, licence, {terms.format("body")} AS w FROM templates),
template_pairs AS (SELECT template, licence, len(w) - 1 AS n_b, unnest({pairs}) AS bigram FROM template_words),
known AS (SELECT template, licence, n_b, bigram, count(*) AS c_b FROM template_pairs GROUP BY ALL),
units AS (
  SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), list_concat(string_split_regex(text, '\\n[ \\t\\r]*\\n'), [text]))) AS u
  FROM documents),
unit_words AS (SELECT doc_id, u, {terms.format("u")} AS w FROM units),
unit_pairs AS (SELECT doc_id, u, len(w) - 1 AS n_a, unnest({pairs}) AS bigram FROM unit_words),
counts AS (SELECT doc_id, u, n_a, bigram, count(*) AS c_a FROM unit_pairs GROUP BY ALL),
common AS (
  SELECT doc_id, u, n_a, template, licence, n_b, sum(least(c_a, c_b)) AS common
  FROM counts JOIN known USING (bigram) WHERE n_a BETWEEN n_b * {low!r}::DOUBLE AND n_b * {high!r}::DOUBLE GROUP BY ALL),
dice AS (SELECT doc_id, u, licence, 2.0::DOUBLE * common / (n_a + n_b) AS dice FROM common),
best AS (SELECT doc_id, u, licence, dice FROM dice WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY doc_id, u ORDER BY dice DESC, licence) = 1),
found AS (SELECT doc_id, count(*) AS n_matches, arg_min(licence, (-dice, licence)) AS licence, max(dice) AS dice FROM best GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, licence, coalesce(dice, 0.0::DOUBLE) AS dice
FROM documents d LEFT JOIN found USING (doc_id)
"""


ORACLES: dict[str, str] = {
    "op6_licence_scan": _licence_sql(), "op8_source_mix": OP8_SQL,
    "op11_quality_rules": oracles.QUALITY_RULES_SQL, "op12_importance_resampling": oracles.RESAMPLE_SQL, "op13_interval_overlaps": oracles.INTERVALS_SQL,
}
