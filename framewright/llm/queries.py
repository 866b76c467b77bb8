"""The registered queries of the text operators, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe, decontam, html_extract, language_id, license_scan, license_sql, line_dedup, merkle, merkle_sql, near_dedup, packing, quality, sharding, token_counts, whitening
from framewright.scratch import new_path
from framewright.session import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.size("licenses").cast("long").alias("n_licenses"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.filter(~language_id.held_out()), sample_rows=3000)
    return language_id.predict(docs.withColumn("held_out", language_id.held_out()), model, ("doc_id", "held_out"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, new_path(spark, "token-cache"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), ids_as_text=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), least=0.8)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), ("page_id", "url"), "html")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents"), quality.Rules(), with_text=False)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = merkle.leaf([F.col("n_chars") + 1 if c == "n_chars" else c for c in told])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = merkle.manifest(table(spark, sf_dir, "documents"), merkle.leaf(told), "lang", "doc_id", {"altered": F.when(chosen, altered)})
    proved = merkle.verified(made, F.coalesce("altered", "leaf"))
    return proved.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where a long cannot hold it; the operator has it as decimal."""
    done = whitening.whiten(table(spark, sf_dir, "embeddings"), keep=4)
    return done.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


_LINE_DEDUP_SQL = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), common as (
  select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10
)
select k.doc_id, count(*)::bigint as n_lines, count(c.key)::bigint as n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) order by k.pos) filter (where c.key is null), '')) as kept_sha256
from keyed k left join common c on k.key = c.key
group by k.doc_id
"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_DECONTAMINATION_SQL = f"""
with item as (
  select item_id, {_WORDS} as words from benchmark
), win as (
  select item_id, least(len(words), 10) as n, unnest(range(1, len(words) - least(len(words), 10) + 2)) as pos, words from item where len(words) > 0
), grams as (
  select distinct item_id, n, array_to_string(words[pos:pos + n - 1], ' ') as gram from win
), doc as (
  select doc_id, {_WORDS} as words from documents
), size as (
  select distinct n from grams
), place as (
  select doc_id, n, words, unnest(range(1, greatest(len(words) - n + 2, 1))) as pos from doc cross join size
), hit as (
  select p.doc_id, p.pos, p.n, g.item_id from place p join grams g on p.n = g.n and array_to_string(p.words[p.pos:p.pos + p.n - 1], ' ') = g.gram
), covered as (
  select doc_id, count(distinct w) as n_hit from (select doc_id, unnest(range(pos, pos + n)) as w from hit) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id
)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(i.n_items, 0)::bigint as n_items,
       sha256(coalesce(i.ids, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from doc d left join covered c using (doc_id) left join items i using (doc_id)
"""

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_bpe": op4_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_sharding": op7_sharding,
    "op8_html_extraction": op8_html_extraction,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle": op11_merkle,
    "op12_packing": op12_packing,
    "op13_whitening": op13_whitening,
}

ORACLES = {"op1_license_scan": license_sql.duckdb_sql(), "op5_line_dedup": _LINE_DEDUP_SQL, "op9_decontamination": _DECONTAMINATION_SQL, "op11_merkle": merkle_sql.duckdb_sql()}
