"""The queries of this package, by name. Each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletide.llm import (
    conversation_repair, decontam, exact_dedup, hard_negatives, line_dedup, packing, quality, simhash, substring_dedup, token_counts, toxicity, url_filter, warc,
)
from tabletide.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(list(url_filter.RULES.items()), "rule string, verdict string")
    return url_filter.judge(pages, rules, url_filter.listed_pages(pages))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), every=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=shifted)


QUERIES = (
    op1_substring_dedup,
    op2_warc,
    op3_url_filter,
    op4_toxicity,
    op5_packing,
    op6_token_counts,
    op7_quality,
    op8_decontamination,
    op9_line_dedup,
    op10_simhash,
    op11_exact_dedup,
    op12_conversation_repair,
    op13_hard_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


#: The same in DuckDB, where SQL can say it: record types by payload digest, and rules by host suffix and path prefix.
ORACLE = {
    "op2_warc": """
        with p as (select page_id, url, coalesce(html, '') as html from pages),
        d as (select page_id, url, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest from p),
        f as (select payload_digest, max(page_id) as first from d where payload_bytes >= 1000 group by 1)
        select page_id, payload_bytes, payload_digest, url,
            case when f.first <> page_id then 'revisit' else 'response' end as record_type,
            case when f.first <> page_id then f.first end as refers_to
        from d left join f using (payload_digest)
    """,
    "op3_url_filter": """
        with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        s as (
            select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
            from u
        ),
        r(rule, verdict) as (values """ + ", ".join(f"('{k}', '{v}')" for k, v in url_filter.RULES.items()) + """),
        h as (select rule, verdict, substr(rule, 1, instr(rule, '/') - 1) as of_host, substr(rule, instr(rule, '/')) as of_path from r),
        b as (
            select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
            from s left join h on (host = of_host or suffix(host, '.' || of_host)) and starts_with(path, of_path)
            group by all
        )
        select page_id, host, path, rule, coalesce(verdict, case when left(md5(host || path), 1) in ('0', '1') then 'block' else 'allow' end) as verdict
        from b
    """,
    "op11_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))
    """,
    "op13_hard_negatives": """
        with e as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                [floor(256 * cast(x as double)) for x in embedding] as v
            from embeddings
            where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
        ),
        s as (
            select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, cast(list_dot_product(a.v, b.v) as bigint) as score
            from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
        ),
        p as (
            select anchor_id, vec_id as positive_id, score as positive_score from s where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
        )
        select anchor_id, positive_id, cast(row_number() over w as int) as rank, vec_id as negative_id, positive_score, score as negative_score
        from p join s using (anchor_id)
        where not same and 80 * positive_score <= 100 * score and score <= positive_score
        window w as (partition by anchor_id, positive_id order by score desc, vec_id)
        qualify row_number() over w <= 5
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
