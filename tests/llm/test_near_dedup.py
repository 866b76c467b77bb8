"""Near-duplicate classes against brute force."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from framewright.llm import near_dedup


def brute_shingles(text):
    """The multiset of five-word shingles in plain Python; the operator's own helpers are not used."""
    words = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    size = min(5, len(words))
    return Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else Counter()


def exact_links(rows, least=0.8):
    """Pairs of places whose weighted Jaccard similarity is least or more; every pair that shares a shingle is counted out."""
    holders, sizes, own = {}, [], []
    for k, (_, text) in enumerate(rows):
        units = [(s, nth) for s, n in brute_shingles(text).items() for nth in range(n)]
        sizes.append(len(units))
        own.append([holders.setdefault(u, []) for u in units])
        for held in own[-1]:
            held.append(k)
    holders = {id(v): np.array(v) for v in holders.values()}
    sizes, links = np.array(sizes), set()
    for a, units in enumerate(own):
        if units:
            common = np.bincount(np.concatenate([holders[id(u)] for u in units]), minlength=len(rows))[:a]
            links |= {(int(b), a) for b in np.flatnonzero((common > 0) & (common >= least * (sizes[a] + sizes[:a] - common)))}
    return links


def exact_classes(rows, least=0.8):
    """id -> lowest id of its class."""
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in exact_links(rows, least):
        x, y = sorted((root(a), root(b)))
        label[y] = x
    wordless = {}
    for k, (_, text) in enumerate(rows):
        if text is not None and not brute_shingles(text):
            label[root(k)] = wordless.setdefault(text, root(k))
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root(k)] = min(low.get(root(k), i), i)
    return {i: low[root(k)] for k, (i, _) in enumerate(rows)}


def copies(draw, n, length, most, base=5000):
    """A text of random words and n - 1 copies, each with up to most of its words changed."""
    words = [f"w{k}" for k in draw.integers(0, base, length)]
    out = [" ".join(words)]
    for k in range(1, n):
        own = list(words)
        for at in draw.choice(length, draw.integers(1, most + 1), replace=False):
            own[at] = f"x{draw.integers(0, 10**9)}"
        out.append(" ".join(own))
    return out


def test_classes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = exact_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want
    sizes = {c: sum(x == c for x in want.values()) for c in want.values()}
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got.values())


def test_near_copies_of_one_text(spark):
    """Copies that differ from each other more than from the text they come from."""
    draw = np.random.default_rng(5)
    words = [f"w{k}" for k in draw.integers(0, 5000, 300)]
    rows = [(0, " ".join(words))]
    for k in range(1, 150):
        own = list(words)
        for at in draw.choice(300, 5, replace=False):
            own[at] = f"x{k}_{at}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join(f"z{x}" for x in draw.integers(0, 5000, 200))) for k in range(50)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == exact_classes(rows)


def test_a_class_of_thousands_of_near_copies(spark):
    """Classes equal to brute force, and nearly all links joined: copies far from the first text link to each other, or to none."""
    draw = np.random.default_rng(11)
    texts = [*copies(draw, 2600, 120, 4), *copies(draw, 300, 90, 3), *(" ".join(f"y{x}" for x in draw.integers(0, 10**6, 50)) for _ in range(100))]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = exact_classes(rows)
    assert {i: r["class_id"] for i, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got.values()) and max(sizes.values()) > 1000


def test_recall_of_links(spark, sf_dir):
    """Of the pairs of at least 0.8 by brute force, those that come into one class."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    links = exact_links(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert links and all(got[rows[a][0]] == got[rows[b][0]] for a, b in links)


def test_every_pair_of_a_bucket_counts(spark, monkeypatch):
    """Many small classes in the same buckets, more than its leaders are linked to."""
    monkeypatch.setattr(near_dedup, "band_hashes", lambda signature: np.zeros((len(signature), near_dedup.BANDS), np.int64))
    draw = np.random.default_rng(7)
    rows = []
    for k in range(150):
        words = [f"w{x}" for x in draw.integers(0, 10**6, 60)]
        rows += [(10 * k + j, " ".join([*words[:57], *(f"v{k}x{j}x{x}" for x in range(3))])) for j in range(2 + k % 2)]
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = exact_classes(rows)
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert all(r["class_size"] == 2 + i // 10 % 2 for i, r in got.items())


def test_the_prefix_filter_loses_no_link(spark):
    """All pairs that may be links are found with no component known, whatever their sizes and repeats."""
    draw = np.random.default_rng(13)
    texts = []
    for k in range(40):
        base = copies(draw, 6, int(draw.integers(5, 80)), 2, base=int(draw.integers(3, 200)))
        texts += [*base, base[0] + " " + " ".join(base[1].split()[: len(base[1].split()) // 5]), " ".join(base[2].split()[2:])]
    rows = list(enumerate(texts))
    packed = [near_dedup.shingles([t]) for t in texts]
    nodes = {}
    for (i, _), (hashes, counts, digests) in zip(rows, packed):
        nodes.setdefault(digests[0], (i, near_dedup.packed(near_dedup._distinct(hashes, counts)), int(counts[0])))
    held = spark.createDataFrame([(bytearray(d), bytearray(x)) for d, (_, x, _) in nodes.items()], "node binary, shingles binary")
    met = spark.createDataFrame([(bytearray(d), n, 0, 0) for d, (_, _, n) in nodes.items()], "node binary, size long, band int, bucket long")
    none = spark.createDataFrame([], "node binary, label binary")
    tables = near_dedup.Tables(spark)
    found = {tuple(sorted((nodes[bytes(r["a"])][0], nodes[bytes(r["b"])][0]))) for r in near_dedup.left_open(met, none, held, 0.8, tables).collect()}
    own = {i for i, _, _ in nodes.values()}
    links = {(a, b) for a, b in exact_links(rows) if a in own and b in own}
    assert links and links <= found and len(found) < 20 * len(links)


def test_pieces_do_not_change_shingles(monkeypatch):
    text = "some words, é日本 and a" + "x" * 300 + " tail " * 40
    whole = near_dedup.shingles([text, "", text + " more"])
    monkeypatch.setattr(near_dedup, "CHUNK", 7)
    cut = near_dedup.shingles([text, "", text + " more"])
    assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(whole, cut))


def test_signatures_agree_as_often_as_weights_do():
    draw = np.random.default_rng(1)
    hashes = draw.integers(0, 2**63, 400).astype(np.uint64)
    a, b = draw.random(400) * 3, draw.random(400) * 3
    b[:150] = a[:150]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    doc = np.repeat([0, 1], 400)
    one = near_dedup.signatures(doc, np.concatenate([hashes, hashes]), np.concatenate([a, b]), 2, 4096)
    assert abs((one[0] == one[1]).mean() - want) < 0.04


def test_odd_rows(spark, odd, nothing):
    got = near_dedup.near_duplicates(odd)
    rows = got.collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by_id[5] == {4} and by_id[6] == {4} and by_id[4] == {4}
    assert by_id[1] == {1} and by_id[2] == {2} and by_id[13] == {13}
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] for r in kept.filter(F.col("doc_id").isNotNull()).collect())
    assert ids == [-14, 1, 2, 3, 4, 7, 8, 9, 10, 11, 12, 13]
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert near_dedup.keep_one(nothing).count() == 0
