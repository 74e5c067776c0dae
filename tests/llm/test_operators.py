"""The other operators against brute force, the libraries, held-out labels, and odd rows."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harness import compare, connect
from iotlens.llm import bpe, extract, language, mixing, quality, queries, tokenfile, topk, toxicity, urls
from iotlens.llm.common import id_share, table
from iotlens.plans.registry import Entry

ODD = [None, "", " ", "\n\n", "x", "don't <|endoftext|> stop", "日本 語 🙂", "a\x1cb\x85c", "é̸ ÀÉ", "aaaa " * 5000]
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, medium, name):
    result = compare(spark, connect(medium), name, Entry(queries.QUERIES[name], queries.SQL[name]), medium)
    assert result["status"] == "ok", result


def texts(medium, n=300):
    return [r[0] for r in connect(medium).execute(f"SELECT text FROM documents LIMIT {n}").fetchall()] + ODD


def test_bpe_equals_library_and_round_trips(medium):
    own, lib = bpe.ByteBpe(BYTES, max_words=500), Tokenizer.from_file(BYTES)
    rows = texts(medium)
    for part in (rows[:150], rows[150:], rows[:20]):
        flat, lens = own.encode_batch(part)
        ends = np.cumsum(lens)
        for t, s, e, back in zip(part, ends - lens, ends, own.decode_batch(flat, lens)):
            want = lib.encode(t or "", add_special_tokens=False).ids
            assert flat[s:e].tolist() == want
            assert back == lib.decode(want, skip_special_tokens=False) == (t or "")


def test_bpe_columns(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(ODD)], "doc_id long, text string, n_tokens int")
    coded = bpe.decode(bpe.encode(df, BYTES), BYTES).collect()
    assert [r["decoded"] for r in coded] == [t or "" for t in ODD]


def test_token_files(spark):
    rows = [(k % 7, t) for k, t in enumerate(ODD * 3)] + [(None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((tuple(r) for r in tokenfile.digests(df, WORDS, 2, 49_408).collect()), key=lambda r: r[1])
    lib = Tokenizer.from_file(WORDS)
    want = sorted(((i, np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in out] == [w[0] for w in want]
    assert sorted(map(str, ((r[0], r[2], r[3]) for r in out))) == sorted(map(str, ((i, len(b) // 4, zlib.crc32(b)) for i, b in want)))
    assert [r[1] for r in out] == np.concatenate([[0], np.cumsum([r[2] for r in out])[:-1]]).tolist()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.digests(empty, WORDS, 2, 49_408).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 50_000])
def test_rans_round_trip_stretches_and_checksum(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 5000).astype("<u4")
    coder = tokenfile.Coder(tokenfile.normalise(np.bincount(ids, minlength=5000)))
    payload = coder.encode(ids)
    assert (coder.decode(payload) == ids).all()
    for first, last, states, words in coder.stretches(payload):  # each on its own
        got = coder.decode_stretch(first, last, states, words)
        want = ids[first * tokenfile.LANES : last * tokenfile.LANES]
        assert (got[: len(want)] == want).all()
    with pytest.raises(ValueError):
        coder.decode(payload[:-1] + bytes([payload[-1] ^ 1]))


def test_quality_counts_equal_brute_force(medium):
    rows = texts(medium)
    got = quality.text_stats(rows)
    for t, r in zip(rows, got.itertuples()):
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count = {}
        for x in windows:
            count[x] = count.get(x, 0) + 1
        covered = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert (r.n_symbols, r.n_dup_lines) == (sum(map((t or "").count, "#*$%&|<>")), len(lines) - len(set(lines)))


def test_binomial_tail_and_fixed_sequence():
    for k, n, p in ((0, 10, 0.1), (3, 40, 0.2), (40, 40, 0.3)):
        exact = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)
    zeros, some = [0] * len(quality.GRID), [5] * len(quality.GRID)
    assert quality.choose(2000, zeros, some, 0.01, 0.003) == quality.GRID[-1]
    assert quality.choose(100, zeros, some, 0.01, 0.003) is None  # too few rows prove nothing
    assert quality.choose(2000, [0, 0, 900, *zeros[3:]], some, 0.01, 0.003) == quality.GRID[1]  # the first failure ends the test


def test_quality_false_rejections_are_limited(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op9_quality(spark, d).join(table(spark, d, "labels"), "doc_id").filter("quality = 1 and not base_failed")
    row = got.agg(F.avg((~F.col("kept")).cast("double")), F.count("*")).first()
    assert row[0] < 0.05 and row[1] > 3000


def test_language_held_out_and_odd(spark, medium):
    out = queries.op1_language(spark, medium).join(table(spark, medium, "documents").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    model = language.fit(table(spark, medium, "documents"))
    names, scores = model.predict([None, "", "123 ... !", "zzzzqqq", "日本"], {})
    assert names[:3] == ["und"] * 3 and all(n in model.languages for n in names[3:]) and all(0 <= s <= 1 for s in scores)
    none = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert none.predict(["some text", None], {}) == (["und", "und"], [0.0, 0.0])


def test_toxicity_held_out_and_odd(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op2_toxicity(spark, d).filter("held_out").join(table(spark, d, "labels"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.75 and n.get((0, 1), 0) / n[0, 0] < 0.01
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert 0 <= model.score(None) == model.score("") <= 1


def test_toxicity_of_very_long_texts(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.fit(docs, labels.filter(id_share("doc_id", 3) != 1))
    rows = docs.join(labels.filter(id_share("doc_id", 3) == 1), "doc_id").select("lang", "toxic", "text", F.size(F.split("text", " ")).alias("n")).orderBy("doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        for toxic in (0, 1):
            own = [r for r in rows if (r["lang"], r["toxic"]) == (lang, toxic)]
            for start in range(0, len(own), max(1, len(own) // 8)):  # 20,000 words of held-out rows, from eight places on
                parts, n = [], 0
                for r in (own[start:] + own[:start]) * 9:
                    parts.append(r["text"])
                    n += r["n"]
                    if n >= 20_000:
                        break
                assert (model.score("\n".join(parts)) >= queries.TOXIC_FROM) == bool(toxic), (lang, toxic, start)
    for t in (None, "", "a" * 5000, "?" * 5000, "a b " * 3000, "one two. " * 700 + "İé\n"):
        assert "".join(toxicity.windows(t)) == (t or "")
    assert len(toxicity.windows("a b " * 3000)) == 12 and len(toxicity.windows("one " * 999)) == 1


def test_urls_odd(spark):
    rows = [(1, None), (2, "no scheme"), (3, "://"), (4, "HTTP://WWW.Example.COM/en/x?y://z"), (5, "a://b.net/es/"), (6, "x://com"), (6, "x://com"), (7, "h://ü.org:80/p#q")]
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id int, url string").withColumn("host", F.lit(1))).collect()}
    assert out[1][:3] == out[2][:3] == out[3][:3] == ("", "", None)
    assert out[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert out[5] == ("b.net", "/es/", "net/es/", "block") and out[6][:3] == ("com", "", None) and out[7][:2] == ("ü.org:80", "/p")
    assert urls.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_urls_places(spark):
    want = {
        "www.shop.co.uk:80": ("co.uk", "shop.co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.example.com": ("com", "example.com"), "com": ("com", "com"), "": ("", ""),
        "10.1.2.3:8080": ("10.1.2.3", "10.1.2.3"), "1.2.3.999": ("999", "3.999"), "[2001:db8::1]:443": ("[2001:db8::1]", "[2001:db8::1]"), "x.y.own.test": ("own.test", "y.own.test"),
    }
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    got = hosts.select("host", *urls.place(F.col("host"), (*urls.SUFFIXES, "own.test"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 16)).round(2)
    v[100:160] = v[7]  # ties
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(1000, None), (1001, [None] * 16), (1002, [float("nan")] * 16), (1003, []), (None, v[0].tolist()), (3, v[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(df.filter("vec_id % 50 = 0"), df).collect())
    ids = np.array([*range(700), 3])
    ints = np.floor(1024 * v[ids]).astype(np.int64)
    want = []
    for q in range(0, 700, 50):
        s = ints @ ints[q]
        best = sorted((-int(x), int(i)) for x, i in zip(s, ids) if i != q)[:10]
        want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(best)]
    assert got == sorted(want)


def test_extract():
    page = ('<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>'
            "<article><h1>Big &amp; news</h1><p>First  part\nhere.<p>Second <b>bo</b>ld.<br>line<aside>Related stuff</aside><script>var a='</p>';</script>"
            '<div class="comments"><p>I disagree a lot with all of this</p></div></article><footer>(c) me</footer></body></html>')
    assert extract.main_text(page, extract.Weights()) == "Big & news First part here. Second bold. line"
    assert [extract.main_text(x, extract.Weights()) for x in (None, "", "<p>", "<!-- x", "<nav>a</nav>")] == [""] * 5


def test_mixing_targets_and_odd(spark):
    rows = [(k, "w " * (k % 9), f"s{k % 4}" if k % 4 else None) for k in range(400)] + [(5, None, "s1"), (5, "", "s9"), (None, "a b", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.plan(df, per_bucket=20).collect()
    by = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        n = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        n[0] += r["taken"]
    for taken, target, size in by.values():
        assert abs(taken - target) <= 10 and target <= 2 * size + 1e-6
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * sum(s for _, _, s in by.values()))
    assert sorted(map(str, out)) == sorted(map(str, mixing.plan(df, per_bucket=20).collect()))
    assert mixing.materialise(df.withColumn("size", F.lit(1))).columns == [*df.columns, "size"]
    assert mixing.plan(df.limit(0)).count() == 0
