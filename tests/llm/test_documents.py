"""Language ID, line dedup, sharding, decontamination, quality rules, HTML and licences: laws, brute force and odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import decontam, html_extract, language_id, line_dedup, quality, sharding
from framewright.llm.queries import QUERIES
from framewright.session import table


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


# Language ID


def test_language_accuracy_on_held_out_rows(spark, sf_dir):
    told = QUERIES["op2_language_id"](spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    rows = [r for r in told.collect() if r["held_out"] and r["lang"] and r["text"] and len(r["text"].split()) >= 5]
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in told.collect())


def test_language_odd_rows(spark, odd, nothing):
    model = language_id.train(odd)
    got = language_id.predict(odd, model).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is not None:
            has = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") != has and (r["score"] == 0) != has
    assert language_id.predict(odd, language_id.train(nothing)).filter("lang_pred <> 'und'").count() == 0
    assert language_id.predict(nothing, model).count() == 0


def test_ftrl_is_its_formula():
    """Weights equal to the update rule, written out number by number."""
    draw = np.random.default_rng(3)
    rows = [(np.array(sorted(draw.choice(6, 3, replace=False))), draw.random(3), int(draw.integers(0, 3))) for _ in range(40)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.02
    weights, bias = language_id.ftrl(rows, 3, alpha, beta, l1, l2, epochs=2)
    z, n = {}, {}

    def weight(c, f):
        l, zz, nn = (0.0 if f == "bias" else l1), z.get((c, f), 0.0), n.get((c, f), 0.0)
        return 0.0 if abs(zz) <= l else -(zz - (l if zz > 0 else -l)) / ((beta + nn**0.5) / alpha + l2)

    for _ in range(2):
        for at, values, label in rows:
            x = [*zip(at.tolist(), values.tolist()), ("bias", 1.0)]
            own = {(c, f): weight(c, f) for c in range(3) for f, _ in x}
            score = [np.exp(sum(own[c, f] * v for f, v in x)) for c in range(3)]
            for c in range(3):
                error = score[c] / sum(score) - (c == label)
                for f, v in x:
                    g = error * v
                    before = n.get((c, f), 0.0)
                    z[c, f] = z.get((c, f), 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / alpha * own[c, f]
                    n[c, f] = before + g * g
    np.testing.assert_allclose(weights[:, :6], [[weight(c, f) for f in range(6)] for c in range(3)], atol=1e-9)
    np.testing.assert_allclose(bias, [weight(c, "bias") for c in range(3)], atol=1e-9)
    assert (weights == 0).mean() > 0.99


def test_the_temperature_has_the_least_loss():
    draw = np.random.default_rng(4)
    labels = draw.integers(0, 3, 200)
    logits = draw.normal(size=(200, 3)) * 3 + 2 * np.eye(3)[labels]
    t = language_id.calibrate(logits, labels)

    def loss(t):
        p = np.exp(logits / t)
        p = np.log(p / p.sum(1, keepdims=True))
        smooth = 1 / 202
        return -np.mean((1 - smooth) * p[np.arange(200), labels] + smooth * p.mean(1))

    assert all(loss(t) <= loss(t * f) + 1e-9 for f in (0.5, 0.9, 0.99, 1.01, 1.1, 2))


def test_rare_languages_are_learned(spark):
    draw = np.random.default_rng(5)
    words = {"aa": ["alba", "lana", "bala"], "bb": ["quix", "zyx", "wox"], "cc": ["mumu", "umo", "omum"]}
    rows = [(k if k % 7 else None, " ".join(draw.choice(words[lang], 8)), lang) for k, lang in enumerate(["aa"] * 3000 + ["bb"] * 12 + ["cc"] * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, sample_rows=200)
    told = language_id.predict(docs.select("doc_id", "text", "lang"), model, ("doc_id", "lang")).collect()
    assert all(r["lang"] == r["lang_pred"] for r in told)
    assert language_id.shares({"a": 10**6, "b": 10}, 3000)["b"] == 1.0
    counts = {"a": 10**6, "b": 10**5, "c": 10}
    assert sum(counts[k] * s for k, s in language_id.shares(counts, 3000).items()) <= 1.25 * 3000


# Line dedup


def brute_lines(rows, least):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[x.strip(strip).translate(low) for x in (t or "").split("\n")] for _, t in rows]
    n = Counter(k for ks in keys for k in set(ks))
    return [(i, "\n".join(x for x, k in zip((t or "").split("\n"), ks) if not (k and n[k] >= least)), len(ks), sum(bool(k) and n[k] >= least for k in ks)) for (i, t), ks in zip(rows, keys)]


@pytest.mark.parametrize("broadcast_mb", [64, 0])
def test_lines_of_odd_rows(spark, odd, nothing, broadcast_mb):
    index = line_dedup.LineIndex(spark, min_docs=2, max_broadcast_mb=broadcast_mb)
    index.add(odd)
    got = index.apply(odd)
    assert got.columns == [*odd.columns, "_n_lines", "_n_dropped"]
    want = brute_lines([(r["doc_id"], r["text"]) for r in odd.collect()], 2)
    assert ordered(got.select("doc_id", "text", "_n_lines", "_n_dropped").collect()) == ordered(want)
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_index_is_reversible(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first, second = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    alone, both = (line_dedup.LineIndex(spark, min_docs=3, keys_per_shard=50) for _ in range(2))
    alone.add(first)
    both.add(first)
    both.add(second)
    everything = line_dedup.LineIndex(spark, min_docs=3)
    everything.add(docs)
    assert ordered(both.counts().collect()) == ordered(everything.counts().collect())
    both.remove(second)
    assert ordered(both.counts().collect()) == ordered(alone.counts().collect())
    assert ordered(both.apply(first).collect()) == ordered(alone.apply(first).collect())


def test_an_index_is_opened_where_it_was_left(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first, second = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    begun = line_dedup.LineIndex(spark, min_docs=3, keys_per_shard=50)
    begun.add(first)
    few = begun.shards
    line_dedup.LineIndex(spark, begun.path, min_docs=3, keys_per_shard=10).add(second)
    opened = line_dedup.LineIndex(spark, begun.path, min_docs=3, keys_per_shard=10)
    assert opened.generation == 2 and opened.shards > few
    whole = line_dedup.LineIndex(spark, min_docs=3)
    whole.add(docs)
    lazy = opened.apply(docs)
    want = ordered(whole.apply(docs).collect())
    opened.remove(second)
    opened.vacuum()
    assert ordered(lazy.collect()) == want
    alone = line_dedup.LineIndex(spark, min_docs=3)
    alone.add(first)
    again = line_dedup.LineIndex(spark, begun.path, min_docs=3)
    assert ordered(again.counts().collect()) == ordered(alone.counts().collect())
    assert ordered(again.apply(first).collect()) == ordered(alone.apply(first).collect())
    again.max_broadcast_mb = 0
    assert ordered(again.apply(first).collect()) == ordered(alone.apply(first).collect())
    with pytest.raises(ValueError, match="min_docs"):
        line_dedup.LineIndex(spark, begun.path, min_docs=4)


@pytest.mark.parametrize("broadcast_mb", [64, 0])
def test_line_columns_that_clash(spark, broadcast_mb):
    names = ["_n_lines", "_N_DROPPED", "_row", "_lines", "_drop", "_drop_row", "_at", "hi", "lo", "_text"]
    rows = [(k, "a line\nanother " + str(k), *range(len(names))) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    index = line_dedup.LineIndex(spark, min_docs=3, max_broadcast_mb=broadcast_mb)
    index.add(docs)
    done = index.apply(docs)
    assert done.columns == [*docs.columns, "_n_lines_", "_n_dropped_"]
    assert ordered(done.collect()) == ordered((k, f"another {k}", *range(len(names)), 2, 1) for k in range(3))


def test_cuckoo_filter():
    draw = np.random.default_rng(2)
    keys = draw.integers(-(2**63), 2**63, (3000, 2))
    own = line_dedup.CuckooFilter.holding(keys[:, 0], keys[:, 1])
    assert own.contains(keys[:, 0], keys[:, 1]).all()
    for hi, lo in keys[:1500].tolist():
        assert own.delete(hi, lo)
    assert own.contains(keys[1500:, 0], keys[1500:, 1]).all()
    assert own.contains(keys[:1500, 0], keys[:1500, 1]).mean() < 0.02
    again = line_dedup.CuckooFilter.from_bytes(own.to_bytes())
    assert (again.table == own.table).all()


# Sharding


def check_rows_law(rows, shards):
    per = Counter(r["shard"] for r in rows)
    counts = [per.get(k, 0) for k in range(shards)]
    assert set(per) <= set(range(shards)) and max(counts) - min(counts) <= 1
    for k in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(per.get(k, 0)))


def test_sharding(spark, sf_dir, odd, nothing):
    for docs in (table(spark, sf_dir, "documents"), odd):
        rows = sharding.shard_documents(docs).collect()
        check_rows_law(rows, 8)
        texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
        assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    assert sharding.shard_documents(nothing).count() == 0


def test_groups_come_together(spark):
    rows = [(k, f"text {k // 5}") for k in range(4000)]
    done = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_rows_law(done, 8)
    where = {r["doc_id"]: r["shard"] for r in done}
    split = sum(len({where[5 * g + k] for k in range(5)}) > 1 for g in range(800))
    assert split < 80  # by chance alone nearly all are split


def test_a_group_of_a_third_of_all_rows(spark):
    rows = [(k, "same" if k % 3 == 0 else f"text {k}") for k in range(3000)]
    check_rows_law(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), rounds=3).collect(), 8)


@pytest.mark.parametrize("one_id", [None, 7])
def test_rows_of_one_id_are_spread(spark, monkeypatch, one_id):
    monkeypatch.setattr(sharding, "SALT_ROWS", 100)
    rows = [(one_id, "same" if k % 3 == 0 else f"text {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check_rows_law(sharding.shard_documents(docs, rounds=2).collect(), 8)
    nodes = docs.selectExpr("doc_id as id", "md5(text) as group")
    seen = []
    monkeypatch.setattr(sharding, "_numbered", lambda rows, quota, total: seen.append(rows) or rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0)))
    sharding.balanced_shards(nodes, rounds=0)
    assert max(r["count"] for r in seen[0].groupBy("group", "_salt").count().collect()) < 300


# Decontamination


def brute_hits(text, items, n):
    def words(t):
        low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    own, hit, found = words(text), set(), set()
    for i, t in items:
        ws = words(t)
        size = min(n, len(ws))
        windows = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} if ws else set()
        for k in range(len(own) - size + 1) if windows else ():
            if tuple(own[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                found |= {str(i)} if i is not None else set()
    return len(own), len(hit), len(found), sorted(found), bool(hit)


@pytest.mark.parametrize("sent", [200_000, 0])
def test_contamination(spark, odd, nothing, monkeypatch, sent):
    monkeypatch.setattr(decontam, "MAX_SENT", sent)
    items = [(1, "One two THREE four five six seven eight nine ten eleven twelve"), (2, "dark wood"), (3, None), (4, "..."), (10, "dark wood"), (None, "lazy dog and"), (5, "x a b " * 8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(odd, bench, 10)
    want = [(r["doc_id"], *brute_hits(r["text"], items, 10)) for r in odd.collect()]
    assert ordered((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in got.collect()) == ordered(want)
    assert decontam.contamination(nothing, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).filter("contaminated").count() == 0
    clashing = odd.withColumns({c: F.lit(1) for c in ("_drop_id", "_DC_id", "_dc_covered", "_dc_words")})
    for spans in (False, True):
        assert decontam.remove_contaminated(clashing, bench, spans=spans).columns == clashing.columns
        assert decontam.remove_contaminated(clashing, bench, spans=spans).count() == decontam.remove_contaminated(odd, bench, spans=spans).count()
    kept = decontam.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_contaminated(odd, bench, spans=True).collect()}
    assert "dark wood" not in cut[4] and "lazy" not in cut[4] and "quick brown fox" in cut[4]


# Quality rules


def brute_quality(text):
    text = text or ""
    blank = "\x20\x09\x0a\x0b\x0c\x0d"
    words = re.findall(f"[^{blank}]+", text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(grams)
    inside = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(blank):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def brute_verdict(text):
    """kept, written out from the rules line by line."""
    blank, lines = "\x20\x09\x0a\x0b\x0c\x0d", (text or "").split("\n")
    n, lost = len(re.findall(f"[^{blank}]+", text or "")), 0
    phrases = quality.BOILERPLATE.pattern.split("|")
    assert len(phrases) > 30
    for k, line in enumerate(lines):
        words = re.findall(f"[^{blank}]+", line)
        if not words:
            continue
        end = k  # the last line of the run of wrapped lines
        while True:
            own = lines[end].strip(blank)
            if own[-1] in ".!?…:;,\"')]}”’»。！？、，।॥؟؛،۔።፧៕។။།" or "\u0e00" <= own[-1] <= "\u0eff":
                closed = True
                break
            following = lines[end + 1].strip(blank) if end + 1 < len(lines) else ""

            def verse(x):
                rest = x.split()[1:]
                return len(rest) >= 2 and x[0].isalpha() and x[0] == x[0].upper() and sum(w[0] != w[0].lower() for w in rest) * 2 < len(rest) + 1

            if not following or not (len(own) >= 40 or following[0].islower() or verse(own) and verse(following)):
                closed = False
                break
            end += 1
        symbols = sum(c in "#*$%&|<>" for c in line)
        separators = sum(c in "|»›•·" for c in line) + len([w for w in re.split(r"\s", line) if w == ">"])
        notice = len(words) <= 12 and quality.BOILERPLATE.search(line)
        if not closed or 10 * symbols >= len(line) or separators >= 3 or notice:
            lost += len(words)
    return lost, not brute_quality(text)[5] and lost <= 0.5 * n


def test_verdicts(spark, sf_dir, odd):
    for docs in (odd, table(spark, sf_dir, "documents")):
        got = [(r["doc_id"], r["n_lost_words"], r["kept"]) for r in quality.clean_lines(docs).collect()]
        assert ordered(got) == ordered((r["doc_id"], *brute_verdict(r["text"])) for r in docs.collect())


def test_quality(spark, sf_dir, odd, nothing):
    for docs in (odd, table(spark, sf_dir, "documents")):
        rows = quality.clean_lines(docs).collect()
        got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows]
        assert ordered(got) == ordered((r["doc_id"], *brute_quality(r["text"])) for r in docs.collect())
        assert all(not (r["base_failed"] and r["kept"]) for r in rows)
    assert quality.clean_lines(nothing).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "यह एक लंबा वाक्य है जो किसी विशेष बात के बारे में नहीं है।\nदूसरा वाक्य भी यहाँ पर लिखा हुआ है।",
        "هل هذا سؤال طويل عن لا شيء على وجه الخصوص يا صديقي؟\nوهذا جواب طويل آخر عنه هنا۔",
        "นี่ คือ ประโยค ยาว ที่ ไม่ มี เรื่อง อะไร เป็น พิเศษ เลย\nและ นี่ คือ อีก ประโยค หนึ่ง",
        "ይህ ስለ ምንም ነገር ያልሆነ ረጅም ዓረፍተ ነገር ነው።\nይህም ሌላ ዓረፍተ ነገር ነው።",
        "The woods are lovely to the eye\nAnd all the stars are in the sky\nBut I have miles to go today\nBefore I find the hidden way.\n\nThe wind is soft upon the lake\nAnd keeps the little birds awake.",
    ],
)
def test_other_scripts_and_verse_stay(text):
    done = dict(zip(quality._COLUMNS, quality.judge(text, quality.Rules())))
    assert done["kept"] and done["n_lost_words"] == 0 and brute_verdict(text) == (0, True)


@pytest.mark.parametrize("text", ["Home Page\nOur Latest News\nContact The Office", "Click Here To Win\nSubscribe To Our Page\nFollow Our Friends\nBuy All Of It Now", "one two three\nfour five six\nseven eight nine ten"])
def test_menus_are_no_verse(text):
    done = dict(zip(quality._COLUMNS, quality.judge(text, quality.Rules())))
    assert not done["kept"] and done["n_lost_words"] == done["n_words"]


def test_line_rules():
    rules = quality.Rules()
    prose = "This is a long and ordinary sentence about nothing in particular, with its stop."
    other = "Another line that shares no run of words with it; it is there so that much remains, and says so plainly."
    text = "\n".join(["Home | About | Contact | Log in", prose, "Accept all cookies.", other, "a heading without a stop", ""])
    done = dict(zip(quality._COLUMNS, quality.judge(text, rules)))
    assert done["kept"] and done["cleaned"] == "\n".join([prose, other, ""])
    wrapped = "This is prose that an editor has broken into lines of\nabout sixty columns, and only the last line of each\nparagraph ends in a stop."
    assert dict(zip(quality._COLUMNS, quality.judge(wrapped + "\n\n" + wrapped.replace("prose", "text"), rules)))["n_lost_words"] == 0
    menus = "Home | About | Contact | Log in\nAll rights reserved, read more\nsome words of a list\nand others of the next\n"
    assert not dict(zip(quality._COLUMNS, quality.judge(menus + prose, rules)))["kept"]



# HTML


def test_html():
    page = """<html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
    <header><p>no header</p></header><nav><ul><li><a href="/">no menu</a></li></ul></nav><!-- no <p>comment</p> -->
    <article><h1>Head &amp; title</h1><p>First   <b>bold</b>&nbsp;text<br>here.<p>Second &lt;one&gt;.</p><aside>no aside</aside>
    <div class="ad">no advert</div><form><p>no form</p></form><section id="comments"><p>no comment</p></section><p>Last.</p></article>
    <footer>no footer</footer></body></html>"""
    assert html_extract.main_text(page) == "Head & title\n\nFirst bold text here.\n\nSecond <one>.\n\nLast."
    body = "Words of an article that go on for a while, long enough to be text. " * 3
    plain = f"<body><div class='menu'><a>no</a></div><div><p>{body}</p><p>Short.</p><p>{body}</p></div><div id=sidebar><p>no</p></div><p><a href=x>no link line</a></p></body>"
    assert html_extract.main_text(plain) == f"{body.strip()}\n\nShort.\n\n{body.strip()}"
    for text in (None, "", "<", "<p", "<!--", "<script>x", "&", "<div class='x"):
        assert isinstance(html_extract.main_text(text), str)


def test_html_wrappers_are_no_noise():
    body = "Words of an article that go on for a while, long enough to be text. " * 3
    article = f"<article><p>{body}</p><div class='ad'>no advert</div><p>Short.</p></article><section id=comments><article>no comment</article></section>"
    want = f"{body.strip()}\n\nShort."
    for name in ("content with-sidebar", "no-sidebar", "has-banner", "social-enabled"):
        assert html_extract.main_text(f"<body><div class='{name}'><div class=widget-area>{article}</div></div></body>") == want
        assert html_extract.main_text(f"<body><div class='{name}'><p>{body}</p></div></body>") == body.strip()
    assert html_extract.main_text(f"<body><form action=x>{article}</form><footer>no</footer></body>") == want
    assert html_extract.main_text(f"<body><div><p>{body}</p></div><section id=comments><article>no comment</article></section></body>") == body.strip()


def test_html_odd_rows(spark, odd, nothing):
    pages = odd.withColumnRenamed("doc_id", "page_id").withColumn("url", F.lit(None).cast("string")).withColumnRenamed("text", "html")
    rows = html_extract.extract(pages).collect()
    assert len(rows) == odd.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_extract.extract(nothing.selectExpr("doc_id as page_id", "source as url", "text as html")).count() == 0
