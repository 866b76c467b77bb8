"""Near-duplicate documents by DartMinHash signatures of weighted word shingles.

A document is the multiset of its shingles: five consecutive words of the
lower-cased text (one shingle of all words if there are fewer). A shingle's
weight is the number of times it occurs.

Signature. Every (shingle, k-th unit of its weight) is a strip on which darts land
at hashed ranks, a Poisson process seeded by the shingle and k alone. A document
draws only darts of rank below (K ln K + 2 K) over its total weight, about K ln K
of them however long it is, hashes each to one of K coordinates and keeps the
earliest per coordinate; coordinates left empty are filled by letting ranks grow.
Two documents agree on a coordinate with the probability of their weighted Jaccard
similarity.

Joining. ``BANDS`` bands of ``ROWS`` coordinates are hashed to buckets. Documents
with the same words are one node. Pairs are verified by the weighted Jaccard
similarity of their shingles (hashes of 48 bits), and those of ``least`` or more are
links. First every node of a bucket is paired with four leaders (see ``candidates``),
linear in the bucket. Nodes that still share a bucket with another component go on to
``left_open``, which finds every pair of different components that can be a link by a
prefix filter on rare shingles; these are verified too. So no pair that meets in a
bucket is missed, and a bucket's pairs are not all made. Classes are the connected
components of the links, found by label propagation over written tables.

Figures: a pair of similarity 0.8 meets in a bucket with probability 0.9999. Two
different shingles have the same hash with probability 2^-48. Pairs left open grow
with the square of a bucket only where many texts are within ``least`` of one text
that is not there itself, and not of each other.

Defined cases: null texts are never linked and each is a class by itself; texts
without a word are in one class with equal ones only. Equal texts are always in one class, as are repeated rows. A class
is named by the lowest id in it; a null id is higher than any other, and a class of
null ids only has a null name. An empty table gives an empty result. Only the id
and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import worker
from framewright.llm.drops import without
from framewright.scratch import Tables, drop_path, write_table

SHINGLE, BANDS, ROWS = 5, 25, 5
K = BANDS * ROWS
#: Parts of a bucket, each led by its most central node.
PARTS = 3
#: Ratio of the sizes in one band of sizes.
STEP = 1.08
#: Bytes of text handled at a time in one task.
CHUNK = 1 << 20

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it belongs to a word (letters, digits, all of non-ASCII), and a random number."""
    word = np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)])
    return word, mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


_BASE = np.uint64(0xD6E8FEB86659FD93)


def _table(name: str, base: int, n: int) -> np.ndarray:
    """At least n powers of a base modulo 2^64, kept while this operator has the worker."""
    kept = worker.store("near_dedup")
    if name not in kept or len(kept[name]) < n:
        grown = np.full(n + n // 4 + 1, np.uint64(base), np.uint64)
        grown[0] = 1
        kept[name] = np.multiply.accumulate(grown)
    return kept[name]


def _power(n: int) -> np.ndarray:
    return _table("powers", int(_BASE), n)[:n]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of UTF-8 bytes, and where it starts."""
    is_word, code = _tables()
    inside = is_word[data]
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # Words as polynomials: sums of code(byte) * BASE^(end - place), read off from running sums.
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * _power(len(data))[::-1], out=running[1:])
    words = (running[end] - running[start]) * _inverse(len(data) - end)
    return mix(words ^ ((end - start).astype(np.uint64) * _GOLD)), start


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about CHUNK bytes, never inside a word."""
    is_word, _ = _tables()
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and is_word[data[end]]:
            rest = np.flatnonzero(~is_word[data[end : end + CHUNK]])
            end = end + int(rest[0]) if len(rest) else min(end + CHUNK, len(data))
        yield at, end
        at = end


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Shingle hashes of all texts in order, how many each text has, and a digest of each text's words (empty: no word)."""
    datas = [x.lower().encode() for x in texts]
    data = np.frombuffer(b" ".join([*datas, b""]), np.uint8)
    found = [(w, s + at) for at, end in _pieces(data) for w, s in [_words(data[at:end])]]
    words = np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in found)])
    start = np.concatenate([np.zeros(0, np.int64), *(s for _, s in found)])
    sizes = np.array([len(d) + 1 for d in datas], np.int64)
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    counts = np.diff(first)
    digests = [xxhash.xxh3_128_digest(words[a:b].tobytes()) if b > a else b"" for a, b in zip(first[:-1], first[1:], strict=True)]
    n_shingles = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    offset = np.repeat(first[:-1], n_shingles) + np.arange(n_shingles.sum()) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    last = np.repeat(first[1:], n_shingles)
    out = np.zeros(len(offset), np.uint64)
    for k in range(SHINGLE):
        at = offset + k
        there = at < last
        out = mix(out * _BASE + np.where(there, words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else 0, np.uint64(k + 1)))
    return out, n_shingles, digests


_inverse_base = pow(int(_BASE), -1, 1 << 64)


def _inverse(n: np.ndarray) -> np.ndarray:
    """BASE^-n modulo 2^64."""
    return _table("inverses", _inverse_base, int(n.max()) + 1 if len(n) else 1)[n]


def weighted(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document number, shingle) with its weight."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc))).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """DartMinHash: for each document, the hash of the earliest dart in each of k coordinates; any non-negative weights."""
    total = np.bincount(doc, weights, n_docs)
    units = np.ceil(weights).astype(np.int64)
    strip = np.repeat(np.arange(len(doc)), units)
    unit = np.arange(len(strip)) - np.repeat(np.cumsum(units) - units, units)
    seed = mix(hashes[strip] ^ mix((unit + 1).astype(np.uint64) * _GOLD))
    owner, edge = doc[strip], weights[strip] - unit  # a strip's last unit may be a part of one
    best_rank, best = np.full(n_docs * k, np.inf), np.zeros(n_docs * k, np.uint64)
    reach = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    open_docs = total > 0
    rank, count = -np.log(_unit(mix(seed))), np.ones(len(seed), np.uint64)
    while open_docs.any():
        live = np.flatnonzero(open_docs[owner] & (rank < reach[owner]))
        while len(live):
            dart = mix(seed[live] + count[live] * _M1)
            inside = np.flatnonzero(_unit(mix(dart ^ _M2)) < edge[live])
            caught = live[inside]
            slot = owner[caught] * k + (mix(dart[inside] ^ _GOLD) % np.uint64(k)).astype(np.int64)
            # Earliest dart per coordinate: write in descending rank, so the smallest stays.
            order = np.argsort(-rank[caught], kind="stable")
            r, s, d = rank[caught][order], slot[order], dart[inside][order]
            keep = r < best_rank[s]
            r, s, d = r[keep], s[keep], d[keep]
            best_rank[s], best[s] = r, d
            rank[live] -= np.log(_unit(mix(dart + _GOLD)))
            count[live] += np.uint64(1)
            live = live[rank[live] < reach[owner[live]]]
        empty = np.isinf(best_rank.reshape(n_docs, k)).any(1)
        open_docs &= empty
        reach = reach * 2
    return best.reshape(n_docs, k)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """The bucket of each band: BANDS columns."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.zeros(parts.shape[:2], np.uint64) + (np.arange(BANDS, dtype=np.uint64) * _GOLD)
    for r in range(ROWS):
        out = mix(out * _BASE + parts[:, :, r])
    return out.view(np.int64)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array([v or None for v in values], pa.binary())


@worker.releasing
def _banding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = batch.column(1).to_pylist()
        texts = [x or "" for x in given]
        for a, b in _chunks(texts):
            hashes, counts, digests = shingles(texts[a:b])
            mask, seen = np.zeros(len(digests), bool), {b""}  # equal documents of a chunk are signed once
            for k, d in enumerate(digests):
                mask[k] = d not in seen
                seen.add(d)
            chosen = hashes[np.repeat(mask, counts)]
            doc, own, weights = weighted(chosen, counts[mask])
            signed = band_hashes(signatures(doc, own, weights, int(mask.sum()))) if mask.any() else np.zeros((0, BANDS), np.int64)
            rows = {digests[k]: j for j, k in enumerate(np.flatnonzero(mask))}
            bands = pa.array([signed[rows[d]] if d and mask[k] else None for k, d in enumerate(digests)], pa.list_(pa.int64()))
            # Texts without a word have no bands, and are one node if they are equal.
            named = [d or (b"" if x is None else xxhash.xxh3_128_digest(x.encode(), 1)) for d, x in zip(digests, given[a:b], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _binary(named), bands, pa.array(counts, pa.int64())], ["id", "node", "bands", "size"])


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """48 bits of each shingle, sorted per text; the k-th of equal shingles of a text gets a number of its own."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    nth = np.arange(len(doc)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    again = nth > 0
    hashes[again] = mix(hashes[again] + nth[again].astype(np.uint64) * _GOLD)
    hashes >>= np.uint64(16)
    return hashes[np.lexsort((hashes, doc))]


def packed(tokens: np.ndarray) -> bytes:
    """Numbers of 48 bits in six bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


@worker.releasing
def _shingling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed shingles of each text."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in _chunks(texts):
            hashes, counts, digests = shingles(texts[a:b])
            own = np.split(_distinct(hashes, counts), np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([_binary(digests), pa.array(map(packed, own), pa.binary())], ["node", "shingles"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted lists of distinct numbers; of shingles with repeats if repeats are numbered."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(a) + len(b) - common)


def _verifying(least: float):
    @worker.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.store("near_dedup")
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [similarity(unpacked(x), unpacked(y)) >= least for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def candidates(nodes: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) to verify first: every node a of a bucket with the bucket's leaders b.

    Beside them the nodes of all buckets of two or more: node, size, band, bucket, n.

    A node is the more central the more nodes its buckets hold: what copies were made
    from meets more of them than they meet of each other. By hash, a bucket's nodes
    are dealt to ``PARTS``, anew in each band; the most central node of each part
    leads, and the one that is first by hash.
    """
    slots = nodes.select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    sizes = tables.write(slots.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-buckets")
    met = tables.write(slots.join(sizes, ["band", "bucket"]), "near-met")
    mark = F.xxhash64("node", "band")
    ranked = met.join(met.groupBy("node").agg(F.sum("n").alias("central")), "node").withColumn("mark", mark).withColumn("part", F.pmod(mark, F.lit(PARTS)))
    most = [F.max(F.when(F.col("part") == k, F.struct("central", "node"))).alias(f"m{k}") for k in range(PARTS)]
    leaders = ranked.groupBy("band", "bucket").agg(F.min(F.struct("mark", "node")).alias("first"), *most)
    named = F.array_distinct(F.array_compact(F.array("first.node", *[f"m{k}.node" for k in range(PARTS)])))
    leaders = tables.write(leaders.select("band", "bucket", named.alias("leaders")), "near-leaders")
    others = F.array_except("leaders", F.array("node"))
    pairs = met.select("node", "band", "bucket").join(leaders, ["band", "bucket"]).select(F.col("node").alias("a"), F.explode(others).alias("b"))
    return pairs.distinct(), met


@worker.releasing
def _unpacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, token: one row for each packed shingle."""
    for batch in batches:
        for k in range(batch.num_rows):
            tokens = unpacked(batch.column(1)[k].as_py()).view(np.int64)
            for at in range(0, len(tokens), 1 << 16):
                part = tokens[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(part), pa.binary()), pa.array(part)], ["node", "token"])


def left_open(met: DataFrame, labels: DataFrame, held: DataFrame, least: float, tables: Tables) -> DataFrame:
    """Distinct pairs (a, b) of nodes that share no component and may be links; no link is left out.

    Only nodes that share a bucket with another component are looked at. A link shares
    at least ``least / (1 + least)`` of the shingles of both, so in one order of all
    shingles, the rarest first, the first shared one stands early in both: at place
    n - that number or before. Nodes are joined on such shingles, by bands of their
    sizes; of each group's largest component no pairs are made.
    """
    told = met.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    told = tables.write(told.select("node", "size", "label", "band", "bucket"), "near-told")
    mixed = told.groupBy("band", "bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    mixed = tables.write(mixed.select("band", "bucket"), "near-mixed")
    some = told.join(mixed.hint("merge"), ["band", "bucket"], "left_semi").select("node", "size", "label").distinct()
    some = tables.write(some, "near-some")
    tokens = held.join(some.select("node").hint("merge"), "node", "left_semi").select("node", "shingles").mapInArrow(_unpacking, "node binary, token long")
    tokens = tables.write(tokens, "near-tokens")
    # Aggregates are written before they are joined: a hot shingle or bucket on the other side can then be split.
    shared = tables.write(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "near-df")
    ordered = tokens.join(shared.hint("merge"), "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    t, share = F.lit(least), least / (1 + least)
    n = F.col("size")
    alone = n - F.size("shared")
    early = F.greatest(n - F.ceil(n * t - 1e-6) + 1 - alone, F.lit(0)).cast("int")
    rows = ordered.join(some.hint("merge"), "node").select("node", "label", "size", alone.alias("alone"), F.slice("shared", 1, early).alias("early"))
    rows = rows.select("node", "label", "size", "alone", F.posexplode("early").alias("at", "pair"))
    place = F.col("alone") + F.col("at")
    band = lambda x: F.floor(F.log(x) / math.log(STEP)).cast("int")
    top = F.least(n / t, (n - place) / share - n) + 1e-6
    rows = rows.select("node", "label", "size", place.alias("place"), F.col("pair.token").alias("token"), band(n).alias("own"), band(n * t - 1e-6).alias("from"), F.when(top >= n * t - 1e-6, band(top)).alias("to"))
    rows = rows.filter("to is not null").withColumn("other", F.explode(F.sequence("from", "to"))).drop("from", "to")
    rows = tables.write(rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")), "near-early")
    key = ["token", "low", "high"]
    per = rows.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("m")).groupBy(*key).agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all")).filter("all > top.m")
    per = tables.write(per.select(*key, F.col("top.label").alias("top")), "near-tops")
    rows = tables.write(rows.join(per.hint("merge"), key), "near-groups")
    one = rows.filter("label <> top").select("token", "own", "other", *[F.col(c).alias(f"x_{c}") for c in ("node", "label", "size", "place")])
    two = rows.select("token", F.col("own").alias("other"), F.col("other").alias("own"), *[F.col(c).alias(f"y_{c}") for c in ("node", "label", "size", "place")])
    need = (F.col("x_size") + F.col("y_size")) * share - 1e-6
    fits = (F.col("x_place") <= F.col("x_size") - need) & (F.col("y_place") <= F.col("y_size") - need)
    found = one.join(two.hint("merge"), ["token", "own", "other"]).filter((F.col("x_label") != F.col("y_label")) & fits)
    return found.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def stars(links: DataFrame) -> DataFrame:
    """Fewer links of the same components: each a keeps its link to the highest b, to which its others are linked instead."""
    top = links.groupBy("a").agg(F.max("b").alias("top"), F.collect_set("b").alias("all"))  # at most BANDS * (PARTS + 1) leaders each
    return top.select("top", F.explode(F.array_union("all", F.array("a"))).alias("node")).filter("node <> top").select(F.col("node").alias("a"), F.col("top").alias("b")).distinct()


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """node, label for every node of the links; the label is the lowest node of its connected component."""
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select("b", "a"))
    both, edges_path = write_table(both.toDF("a", "b"), "near-edges")
    labels, path = write_table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "near-labels")
    while True:
        told = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        heard = labels.join(told, labels["node"] == told["a"]).select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        heard, heard_path = write_table(heard, "near-heard")
        # A label's own label is at least as low: half the remaining way in one step.
        jump = heard.select(F.col("node").alias("at"), F.col("label").alias("low"))
        new = heard.join(jump, heard["label"] == jump["at"], "left").select("node", "was", F.least("label", F.coalesce("low", "label")).alias("label"))
        new, new_path = write_table(new, "near-labels")
        moved = new.filter("was <> label").limit(1).count()
        drop_path(spark, heard_path)
        drop_path(spark, path)
        labels, path = new.select("node", "label"), new_path
        if not moved:
            drop_path(spark, edges_path)
            return labels, path


def near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, class_id (the lowest id of its class) and class_size."""
    tables = Tables(docs.sparkSession)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_banding, f"id {kind}, node binary, bands array<long>, size long")
    rows = tables.keep(made, "near-rows")
    # Equal texts of other chunks were signed again, to the same bands.
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.max("bands").alias("bands"), F.max("size").alias("size"))
    nodes = tables.write(nodes, "near-nodes")
    pairs, met = candidates(nodes, tables)
    wanted = met.select("node").distinct()
    # Merge joins at every size: the shingles move alike, however few pairs there are.
    texts = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).mapInArrow(_shingling, "node binary, shingles binary")
    held = tables.write(texts.filter("node is not null").join(wanted.hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "near-shingles")
    left, right = held.toDF("a", "left_shingles"), held.toDF("b", "right_shingles")

    def linked(pairs: DataFrame) -> DataFrame:
        checked = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left_shingles", "right_shingles")
        return tables.write(checked.mapInArrow(_verifying(least), "a binary, b binary"), "near-links")

    labels, path = components(stars(linked(pairs)))
    tables.paths.append(path)
    more = linked(left_open(met, labels, held, least, tables))
    if more.limit(1).count():
        ends = [labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label")) for x in ("a", "b")]
        between = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).distinct()
        joined, path = components(between)
        tables.paths.append(path)
        # A node that had no link is its own label; those of the links so far take the label of theirs.
        own = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("low")), "label", "left").select("node", F.coalesce("low", "label").alias("label"))
        labels = tables.write(own.union(joined.join(labels.select("node"), "node", "left_anti").select("node", "label")), "near-labels")
    # Only linked nodes meet their class; every other node is a class by itself.
    joined = tables.write(nodes.select("node", "low", "n").join(labels, "node"), "near-joined")
    classes = tables.write(joined.groupBy("label").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size")), "near-sums")
    named = joined.select("node", "label").join(classes, "label").select("node", "class_id", "class_size")
    lone = nodes.filter("n > 1").join(labels.select("node"), "node", "left_anti").select("node", F.col("low").alias("class_id"), F.col("n").alias("class_size"))
    named = tables.keep(named.union(lone), "near-classes")
    tables.close()
    return (
        rows.select("id", "node")
        .join(named, "node", "left")
        .select(F.col("id").alias(id_col), F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))
    )


def keep_one(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: the one with the class's lowest id. Rows that share an id stay or go together."""
    classes = near_duplicates(docs, least, id_col, text_col)
    return without(docs, classes.filter(~F.col(id_col).eqNullSafe(F.col("class_id"))).select(id_col), id_col)
