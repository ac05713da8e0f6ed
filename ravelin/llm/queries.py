"""The operators' queries over their whole tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3).select("doc_id", "fingerprint", "component_id")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), span=400)


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ravelin.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.quality import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.line_dedup import drop_boilerplate

    kept = drop_boilerplate(table(spark, sf_dir, "documents"), host_col="source", counts=True)
    return kept.selectExpr("doc_id", "source", "__lines AS n_lines", "__dropped AS n_dropped", "md5(cast(text AS binary)) AS kept_md5")


ORACLE_SQL["op5_line_dedup"] = """
WITH pages AS (SELECT doc_id, source, text, coalesce(source, '') AS host, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT host, count(*) AS total FROM pages GROUP BY host),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM pages) GROUP BY host, line),
boiler AS (
  SELECT host, list(line) AS dropped FROM seen JOIN totals USING (host)
  WHERE n >= 5 AND n > 0.2 * total AND trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    ')) <> '' GROUP BY host
),
kept AS (SELECT doc_id, source, text, lines, CASE WHEN dropped IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(dropped, x)) END AS left_over FROM pages LEFT JOIN boiler USING (host))
SELECT doc_id, source, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(left_over), 0) AS BIGINT) AS n_dropped,
  CASE WHEN text IS NULL THEN NULL ELSE md5(array_to_string(left_over, chr(10))) END AS kept_md5 FROM kept
"""


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.pii import digest_spans

    return digest_spans(table(spark, sf_dir, "documents"))


@query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.chat import read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)], rows.schema)
    return read_back(rows.union(extra))


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
