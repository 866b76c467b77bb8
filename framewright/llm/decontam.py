"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Words are runs of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of the
text with A-Z lower-cased. A window is ``n`` consecutive words of a benchmark item;
an item with fewer words, but not none, is one window.

Each document's windows are hashed by doubling (1, 2, 4, 8 words) and looked up in
the set of benchmark hashes, which travels inside the plan while it holds at most
``MAX_SENT`` windows. Larger benchmarks meet the document windows in a shuffle join of
hashes alone: a row number, a place and a hash for each window, some four times the
bytes of the texts, of which only hits come back. Hits are then verified by comparing
the words themselves; results are equal.

Only DataFrame functions are used. With up to ``MAX_SENT`` windows the texts are read
once and never shuffled: only hits, and one short row per document, are. Beyond, the
rows are written once with a number each, and meet their hits by it.

Defined cases: a null text has no words and is never contaminated; items without
words have no windows; a null item id is not listed. Repeated items are listed
once per id; repeated documents are judged one by one. An empty benchmark leaves
every document clean. Columns made on the way carry a ``_dc_`` prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.drops import free_name, without
from framewright.scratch import write_table

#: Distinct benchmark windows up to which their hashes travel in the plan: at most 1.6 MB.
MAX_SENT = 200_000
#: Bytes of window texts and item ids up to which these are broadcast to the hits.
MAX_TEXTS = 64 << 20

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PIECE = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The normalised words of a text."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _GAP), "")


def _with_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds _dc_h<L> for each length: the hash of every window of L words of _dc_words, by its place."""
    have = {1: "_dc_p1"}
    df = df.withColumn("_dc_p1", F.transform("_dc_words", lambda w: F.xxhash64(w)))

    def joined(left: str, right: str, shift: int, length: int) -> Column:
        whole = F.zip_with(left, F.slice(right, shift + 1, F.greatest(F.size(right) - shift, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        return F.slice(whole, 1, F.greatest(F.size("_dc_words") - (length - 1), F.lit(0)))

    power = 2
    while power <= max(lengths, default=1):
        df = df.withColumn(f"_dc_p{power}", joined(have[power // 2], have[power // 2], power // 2, power))
        have[power] = f"_dc_p{power}"
        power *= 2
    for length in lengths:
        parts = [p for p in sorted(have, reverse=True) if length & p]
        at, done = have[parts[0]], parts[0]
        for k, p in enumerate(parts[1:]):
            name = f"_dc_h{length}_{k}"
            df = df.withColumn(name, joined(at, have[p], done, done + p))
            at, done = name, done + p
        df = df.withColumn(f"_dc_h{length}", F.col(at))
    return df.select(*[c for c in df.columns if not c.startswith(("_dc_p",)) and not (c.startswith("_dc_h") and c.count("_") > 2)])


def _spelled(words: str, at: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.col(words), at + 1, length), " ")


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window: _dc_len, _dc_hash, _dc_text and _dc_items, the ids (as strings) of its items."""
    items = benchmark.select(F.col(id_col).cast("string").alias("_dc_item"), words_of(F.col(text_col)).alias("_dc_words")).filter(F.size("_dc_words") > 0)
    items = items.withColumn("_dc_len", F.least(F.size("_dc_words"), F.lit(n)))
    windows = items.withColumn("_dc_at", F.explode(F.sequence(F.lit(0), F.size("_dc_words") - F.col("_dc_len"))))
    spelled = windows.select("_dc_item", "_dc_len", _spelled("_dc_words", F.col("_dc_at"), F.col("_dc_len")).alias("_dc_text"))
    return spelled.groupBy("_dc_len", "_dc_text").agg(F.array_compact(F.collect_set("_dc_item")).alias("_dc_items"))


def _hashed_windows(windows: DataFrame, lengths: list[int]) -> DataFrame:
    hashed = _with_hashes(windows.withColumn("_dc_words", F.split("_dc_text", " ")), lengths)
    return hashed.withColumn("_dc_hash", F.coalesce(*[F.when(F.col("_dc_len") == k, F.element_at(f"_dc_h{k}", 1)) for k in lengths])).select("_dc_len", "_dc_hash", "_dc_text", "_dc_items")


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs' columns and _dc_n_words, _dc_covered (places of hit words, ascending) and _dc_items (sorted ids with a window in the text)."""
    keep = docs.columns
    windows = benchmark_windows(benchmark, n, item_col, item_text_col)
    lengths = sorted(r[0] for r in windows.select("_dc_len").distinct().collect())
    base = docs.withColumn("_dc_words", words_of(F.col(text_col))).withColumn("_dc_n_words", F.size("_dc_words").cast("long"))
    none = F.array().cast("array<int>"), F.array().cast("array<string>")
    if not lengths:
        return base.select(*keep, "_dc_n_words", none[0].alias("_dc_covered"), none[1].alias("_dc_items"))
    hashes = _hashed_windows(windows, lengths)
    sent = hashes.select("_dc_len", "_dc_hash").distinct().limit(MAX_SENT + 1).collect()
    rows = base.withColumn("_dc_row", F.monotonically_increasing_id())
    hashed = _with_hashes(rows, lengths)
    if len(sent) <= MAX_SENT:
        found = hashed
        for k in lengths:
            values = ",".join(f"{r[1]}L" if r[1] != -(2**63) else "(-9223372036854775807L - 1L)" for r in sent if r[0] == k)
            found = found.withColumn(f"_dc_h{k}", F.expr(f"filter(transform(_dc_h{k}, (h, i) -> if(h in ({values}), i, null)), i -> i is not null)"))
        found = found.withColumn("_dc_hits", F.flatten(F.array(*[F.transform(f"_dc_h{k}", _place(k)) for k in lengths])))
    else:
        found = _met_by_hash(rows, hashes, lengths, text_col)
    spelled = F.transform("_dc_hits", lambda h: F.struct(h["at"].alias("at"), h["len"].alias("len"), F.array_join(F.slice("_dc_words", h["at"] + 1, h["len"]), " ").alias("text")))
    one = found.withColumn("_dc_hits", F.when(F.size("_dc_hits") > 0, spelled)).select("_dc_row", F.explode_outer("_dc_hits").alias("_dc_hit"), *_carried(keep, text_col))
    flat = one.select("*", F.col("_dc_hit.at").alias("_dc_at"), F.col("_dc_hit.len").alias("_dc_len"), F.col("_dc_hit.text").alias("_dc_text")).drop("_dc_hit")
    known = hashes.select("_dc_len", "_dc_text", "_dc_items")
    size = known.agg(F.sum(F.octet_length("_dc_text") + F.coalesce(F.octet_length(F.array_join("_dc_items", ",")), F.lit(0)) + 64)).first()[0] or 0
    joined = flat.join(F.broadcast(known) if size <= MAX_TEXTS else known, ["_dc_len", "_dc_text"], "left")
    hit = F.col("_dc_items").isNotNull()
    per_row = joined.groupBy("_dc_row").agg(
        *[F.first(c).alias(c) for c in _carried(keep, text_col)],
        F.collect_set(F.when(hit, F.struct("_dc_at", "_dc_len"))).alias("_dc_spans"),
        F.collect_set("_dc_items").alias("_dc_items"),  # windows of the same items give one list
    )
    per_row = per_row.withColumn("_dc_items", F.sort_array(F.array_distinct(F.flatten("_dc_items"))))
    covered = F.sort_array(F.array_distinct(F.flatten(F.transform("_dc_spans", lambda s: F.sequence(s["_dc_at"], s["_dc_at"] + s["_dc_len"] - 1)))))
    return per_row.withColumn("_dc_covered", covered)


def _place(length: int):
    return lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"))


def _hash_place(length: int):
    return lambda h, i: F.struct(i.alias("at"), F.lit(length).alias("len"), h.alias("hash"))


def _met_by_hash(rows: DataFrame, hashes: DataFrame, lengths: list[int], text_col: str) -> DataFrame:
    """rows with _dc_hits: the places whose windows have the hash of a benchmark window."""
    rows, _ = write_table(rows.drop("_dc_words"), "decontam-rows")
    rows = rows.withColumn("_dc_words", words_of(F.col(text_col)))
    hashed = _with_hashes(rows.select("_dc_row", "_dc_words"), lengths)
    every = F.flatten(F.array(*[F.transform(f"_dc_h{k}", _hash_place(k)) for k in lengths]))
    flat = hashed.select("_dc_row", F.explode(every).alias("_dc_w")).select("_dc_row", F.col("_dc_w.at").alias("at"), F.col("_dc_w.len").alias("_dc_len"), F.col("_dc_w.hash").alias("_dc_hash"))
    met = flat.join(hashes.select("_dc_len", "_dc_hash").distinct().hint("merge"), ["_dc_len", "_dc_hash"], "left_semi")
    hits = met.groupBy("_dc_row").agg(F.collect_list(F.struct("at", F.col("_dc_len").alias("len"))).alias("_dc_hits"))
    return rows.join(hits, "_dc_row", "left")


def _carried(keep: list[str], text_col: str) -> list[str]:
    """Columns that go along with a row's hits: all but the text, which is not shuffled."""
    return [*[c for c in keep if c != text_col], "_dc_n_words"]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, n_words, n_hit, n_items, items (sorted ids) and contaminated."""
    found = find_hits(docs.select(id_col, text_col), benchmark, n, text_col)
    n_hit = F.size("_dc_covered").cast("long")
    return found.select(
        id_col,
        F.col("_dc_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_dc_items").cast("long").alias("n_items"),
        F.col("_dc_items").alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """docs without contaminated documents, or (spans) with the hit words cut out of their texts.

    Rows are known by id; rows that share an id share its verdict.
    """
    found = find_hits(docs.select(id_col, text_col), benchmark, n, text_col)
    own, places = free_name(docs, "_dc_id"), free_name(docs, "_dc_covered")
    hits = found.filter(F.size("_dc_covered") > 0).select(F.col(id_col).alias(own), F.col("_dc_covered").alias(places))
    if not spans:
        return without(docs, hits.select(own), id_col)
    hits = hits.groupBy(own).agg(F.array_distinct(F.flatten(F.collect_list(places))).alias(places))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(_PIECE), F.lit(0))
    left = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(places, i)), "")
    text = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(left)
    return docs.join(hits, docs[id_col].eqNullSafe(hits[own]), "left").select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
