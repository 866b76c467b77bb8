"""Token counts through a digest cache.

The cache is a Parquet table (content_sha256, tokenizer_sha256, n_bytes,
n_tokens). A run joins the digests of its contents to the cache, encodes each
distinct missing content once, appends the new counts and reads every count from
the cache. A second run over the same contents encodes nothing. A run that fails
appends nothing, since Spark commits a job's files together; a cache has one writer
at a time.

Defined cases: a null text counts as the empty text (0 tokens, 0 bytes). Equal
texts are encoded once and each row gets its count, repeated rows included. An
empty input gives an empty result. Only the id and text columns are read, so
extra columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import charsets, worker
from framewright.scratch import Tables

CACHE_SCHEMA = "content_sha256 binary, n_bytes long, n_tokens long, tokenizer_sha256 string"

#: Missing digests up to which they are broadcast: some 30 MB of digests as a hash table.
MAX_SENT = 500_000

#: Pieces whose counts a Python worker keeps; the store is emptied when full.
PIECES_KEPT = 500_000

_L, _D, _W = charsets.LETTERS, charsets.DIGITS, charsets.WHITE
_tails = "'s|'t|'re|'ve|'m|'ll|'d"
_PLAIN = f"{_tails}| ?[{_L}]+| ?[{_D}]+| ?[^\\s{_L}{_D}]+|\\s+(?!\\S)|\\s+"
_FULL = regex.compile(rf"{_tails}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+")


class PieceCounter(dict):
    """Counts tokens piece by piece for byte-level files that split text by the usual pattern.

    The library merges within a piece only, so a text's count is the sum over its
    pieces; a piece is encoded when first met. Texts that hold an added token, and
    files of another make, go to the library as they are.
    """

    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        made = json.loads(Path(path).read_text())
        split = made.get("pre_tokenizer") or {}
        self.by_piece = (
            split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not made.get("normalizer")
        )
        added = [re.escape(x["content"]) for x in made.get("added_tokens", [])]
        self.added = re.compile("|".join(added)) if added else None
        self.plain = re.compile(_PLAIN)

    def __missing__(self, piece: str) -> int:
        n = len(self.library.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        """The number of tokens of one text."""
        if not self.by_piece or (self.added and self.added.search(text)):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        pieces = (self.plain if charsets.is_plain(text) else _FULL).findall(text)
        return sum(map(self.__getitem__, pieces))


def counter(path: str) -> PieceCounter:
    """This process's counter for a tokenizer file."""
    kept = worker.store("token_counts")
    if path not in kept:
        kept[path] = PieceCounter(path)
    return kept[path]


class PieceModelCounter:
    """Counts tokens of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.library.encode(text))


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer file: the version that keys the cache, and names its folder there."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _counting(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path) if path.endswith(".json") else PieceModelCounter(path)
        for batch in batches:
            n = [own.count(text) for text in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("content_sha256"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["content_sha256", "n_bytes", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache; empty where nothing has been written yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(cache_path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def _known(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """The counts of one tokenizer; only its folder is read."""
    return read_cache(spark, cache_path).filter(F.col("tokenizer_sha256") == version).drop("tokenizer_sha256")


def fill_cache(docs: DataFrame, cache_path: str, tokenizer_path: str, text_col: str = "text") -> None:
    """Encode the distinct contents of docs that the cache lacks, and append their counts. One job at a time may append.

    Digests alone meet the cache. Contents are then read for the missing ones only: few of
    these are broadcast, so that other texts stay where they are; many meet the distinct
    contents, of which one copy a task is shuffled.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    tables = Tables(spark)
    content = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(content, 256)).alias("content_sha256")
    missing = tables.write(docs.select(digest).distinct().join(_known(spark, cache_path, version).select("content_sha256"), "content_sha256", "left_anti"), "token-missing")
    n = missing.count()
    if n:
        contents = docs.select(digest, content.alias("content"))
        if n <= MAX_SENT:
            wanted = contents.join(F.broadcast(missing), "content_sha256", "left_semi").dropDuplicates(["content_sha256"])
        else:
            wanted = contents.dropDuplicates(["content_sha256"]).join(missing, "content_sha256")  # inner, as a semi join would go below the dedupe
        counted = wanted.select("content_sha256", F.octet_length("content").cast("long").alias("n_bytes"), "content").mapInArrow(_counting(tokenizer_path), "content_sha256 binary, n_bytes long, n_tokens long")
        counted.withColumn("tokenizer_sha256", F.lit(version)).write.mode("append").partitionBy("tokenizer_sha256").parquet(cache_path)
    tables.close()


def compact_cache(spark: SparkSession, cache_path: str, to_path: str, files: int = 64) -> None:
    """A copy of the cache in few files for each tokenizer; the caller moves on to it and deletes the old one."""
    read_cache(spark, cache_path).repartition(files, "content_sha256").write.partitionBy("tokenizer_sha256").parquet(to_path)


def token_counts(docs: DataFrame, cache_path: str, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    fill_cache(docs, cache_path, tokenizer_path, text_col)
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    rows = docs.select(F.col(id_col), digest.alias("content_sha256"))
    # No aggregate below the join: the side of a hot content can then be split.
    counts = _known(docs.sparkSession, cache_path, tokenizer_digest(tokenizer_path))
    return rows.join(counts, "content_sha256", "left").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
