"""The registered queries of this package: thin wrappers that derive the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import archive_and_read

    return archive_and_read(_table(spark, sf_dir, "pages"), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import apply_rules, fit_ratio

    docs = _table(spark, sf_dir, "documents")
    ratio = fit_ratio(docs, _table(spark, sf_dir, "labels"))
    return apply_rules(docs.select("doc_id", "text"), ratio).select("doc_id", "rules.n_words", "rules.word_chars", "rules.n_symbols", "rules.n_dup_lines", "rules.n_repeat_words", "rules.base_failed", "rules.kept", "rules.ratio")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.embedding_dedup import link_components

    return link_components(_table(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_classifier import classify, fit, held_out

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, _table(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "quality_score.score", "quality_score.predicted")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_extract import extract_pages, fit

    pages = _table(spark, sf_dir, "pages")
    made = extract_pages(pages.select("page_id", "url", "html"), fit(pages))
    return made.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import removal_digest

    return removal_digest(_table(spark, sf_dir, "documents"), kept_text=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import hex_digits, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import assign_shards

    made = assign_shards(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import best_fit

    return best_fit(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.bpe import digests

    made = digests(F.col("text"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return _table(spark, sf_dir, "documents").select("doc_id", made.alias("made")).select("doc_id", "made.*")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat_format import format_digest

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # conversation -7 says the template's own control strings
    said = F.lit(r"\### Assistant: </turn> ok").alias("text")
    two = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role"), said) for i, r in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.lit(-7).alias("conv_id"), F.explode(two).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")
    return format_digest(turns.unionByName(extra))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.periodic_runs import run_digest

    return run_digest(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.conversation_repair import repair_digest

    return repair_digest(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_quality_rules, op3_sharding, op4_embedding_dedup, op5_quality_classifier, op6_packing, op7_bpe, op8_html_extract, op9_suffix_dedup, op10_simhash, op11_chat_format, op12_periodic_runs, op13_conversation_repair)}
ORACLE_SQL: dict[str, str] = {
    "op11_chat_format": r"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
        ), marked as (
            select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as before,
                row_number() over (partition by conv_id order by turn nulls first, role, text) as place,
                length(text) + length(text) - length(replace(text, '\', ''))
                    + coalesce(list_sum([length(x) - 2 for x in regexp_extract_all(text, '#{3,}')]), 0)
                    + (length(text) - length(replace(text, '</turn>', ''))) // 7 as size
            from turns
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by place) filter (where role = 'assistant'), '')) as loss_sha256,
            cast(sum(size + 9 + case when before is null or before <> role then 6 + length(url_encode(role)) else 0 end) as bigint) as formatted_chars
        from marked group by conv_id
    """,
}
