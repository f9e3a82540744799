import gzip
import hashlib
import io
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.llm import bpe, langid, mixing, prefix_tokens, quality, rules, warc
from nearfield.llm.features import Features
from nearfield.llm.samples import bounded
from nearfield.llm.text import Words, blocks, per_text, windows

pt = pytest.importorskip("public_tokenizers")

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n", "a", "one two", "é\x85x\xa0y z", "x" * 3000, ("same line here\n" * 40), "日本語 テキスト 😀", "a b c a b c a b c", "#*$%&|<> ##", "\tq\r\nq\x0bq\x0cq", "line\nline\n\nline", "end\n", "don't I'LL <|endoftext|> 12 3"]


def docs_of(spark, texts, **extra):
    rows = [(i, t, "en", *extra.values()) for i, t in enumerate(texts)]
    names = ", ".join(f"{k} string" for k in extra)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string" + (", " + names if names else ""))


def noise(seed, n, words=60):
    rng = random.Random(seed)
    return ["\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, words))) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def test_words_match_the_pattern():
    texts = [t or "" for t in ODD] + noise(1, 20)
    w = Words(pa.array(texts))
    found = [m.group() for t in texts for m in WORD.finditer(t.encode())]
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end, strict=True)] == found
    assert w.per.tolist() == [len(WORD.findall(t.encode())) for t in texts]
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(found))
    at = {}
    for x, y in zip(found, h.tolist(), strict=True):
        assert at.setdefault(x, y) == y


def test_slices_and_nulls_keep_their_bounds():
    col = pa.array([None, "a b", "c", None, "d e f"])
    batch = pa.RecordBatch.from_arrays([col.slice(1)], ["t"])
    assert [n for b in blocks(iter([batch]), "t", 1) for n in Words(b.column(0)).per.tolist()] == [2, 1, 0, 3]
    assert Words(col.slice(1)).per.tolist() == [2, 1, 0, 3]
    assert per_text(np.array([1, 2, 3, 4]), np.array([1, 0, 3])).tolist() == [1, 0, 9]


def test_windows_stay_within_texts():
    w = Words(pa.array(["a b c d", "a b", "b c d e"]))
    h, at = windows(w.hashes(), w.per, 3)
    assert len(h) == 4 and h[1] == h[2] and at.tolist() == [0, 1, 6, 7]


# --- quality rules -------------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = [m.decode() for m in WORD.findall(text.encode())]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line.encode()):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    marked = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(marked)


def test_base_counts(spark):
    texts = ODD + noise(2, 60, 12) + ["w " * 49, "w " * 50, " ".join(str(i) for i in range(60))]
    got = rules.apply_rules(docs_of(spark, texts, score="x"), np.zeros(64, np.float32)).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        n, chars, symbols, dup, repeat = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), t
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.kept == (not r.base_failed) and (r.ratio is None) == (n == 0)


def test_ratio_is_of_all_documents(spark):
    good, bad = " ".join(f"good{i % 30}" for i in range(80)), " ".join(f"bad{i % 37} x{i}" for i in range(80))
    docs = docs_of(spark, [good] * 3 + [bad] * 9).repartition(5)
    ratio = rules.fit_ratio(docs, docs.where("doc_id < 3").select("text"), 4096)
    w = [Words(pa.array([x])) for x in (good, bad)]
    ids = [rules.ngram_buckets(x, 4096)[0] for x in w]
    raw = 3 * np.bincount(ids[0], minlength=4096) + 9 * np.bincount(ids[1], minlength=4096) + 0.5
    target = 3 * np.bincount(ids[0], minlength=4096) + 0.5
    want = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(ratio, want, atol=1e-6)
    scores = {r.doc_id: r.ratio for r in rules.apply_rules(docs, ratio).collect()}
    assert scores[0] == pytest.approx(float(ratio[ids[0]].mean()), abs=1e-6) and scores[0] > scores[5]


def test_rules_without_rows(spark):
    empty = docs_of(spark, []).select("doc_id", "text")
    assert not rules.fit_ratio(empty, empty.select("text"), 16).any()
    assert rules.apply_rules(empty, np.zeros(16, np.float32)).count() == 0


def test_bounded_sample_follows_keys(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    a = {r[0] for r in bounded(df, "doc_id", 500).collect()}
    assert a == {r[0] for r in bounded(df.repartition(9), "doc_id", 500).collect()} and 350 < len(a) < 650
    assert bounded(df, "doc_id", 9999).count() == 5000


# --- token counts --------------------------------------------------------------------------------------------------


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(pt.path("word_bpe_49k.json"))
    rng = random.Random(3)
    pools = ["abcdefghij ", "éèüßñçÀÉÎ", "ΣσςΑΒ", "日本語한국어", "'stremvlld ", "0123456789", "#$%&*!?.,", "😀́‍ \t\n", "İıſKÅǅ"]
    texts = ODD + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 60))) for _ in range(400)] + ["x" * 5000, "ab " * 3000]
    got = prefix_tokens.token_counts(docs_of(spark, texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        n = len(tk.encode(t or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 2048), t


def test_every_prefix_of_a_word():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(pt.path("word_bpe_49k.json"))
    c = prefix_tokens.counter(pt.path("word_bpe_49k.json"))
    for word in ("internationalization", "überraschung", "thlyingness", "aaaaaaaaaa", "日本語"):
        assert c.word_prefixes(word) == [len(tk.encode(word[: i + 1], add_special_tokens=False).ids) for i in range(len(word))]


def test_every_prefix_of_a_text(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(pt.path("word_bpe_49k.json"))
    texts = ["they're überraschung's 12'll x", "a<|endoftext|>b c", None, "", "日本語 don't"]
    got = {r.doc_id: r for r in prefix_tokens.prefix_tables(docs_of(spark, texts, prefix_tokens="clash")).collect()}
    for d, t in enumerate(texts):
        if d == 1:
            continue  # a part of a special string is no prefix of it
        shown = [i for i, c in enumerate(t or "") if not c.isspace()]
        assert got[d].prefix_tokens == [len(tk.encode(t[: i + 1], add_special_tokens=False).ids) for i in shown]
        assert not got[d].ends or got[d].ends[-1] == len(shown)
    assert got[1].prefix_tokens == [1, 2, 3, 4] and got[1].ends == [1, 2, 3, 4]
    assert prefix_tokens.prefix_tables(docs_of(spark, texts).limit(0)).count() == 0 and prefix_tokens.token_counts(docs_of(spark, texts).limit(0)).count() == 0


def test_truncation_from_the_table(spark):
    text = "the quick brown fox jumps over the lazy dog and thhahaerti"
    docs = docs_of(spark, [text, None, ""], n_tokens="clash")
    table = prefix_tokens.prefix_tables(docs).orderBy("doc_id").first().prefix_tokens
    for budget in range(len(table) + 2):
        rows = prefix_tokens.truncate(docs, budget).orderBy("doc_id").collect() if budget in (0, 7, 12) else None
        total, whole, more, kept = prefix_tokens.counter(pt.path("word_bpe_49k.json")).cut_at(text, budget)
        words = text.split(" ")
        last = max((i for i, x in enumerate(table) if x <= budget), default=-1)
        assert total == table[-1] and sum(map(len, words[:whole])) + more == last + 1 and kept == (table[last] if last >= 0 else 0)
        if rows:
            assert tuple(rows[0]) == (0, total, whole, more, kept) and [r.n_tokens for r in rows[1:]] == [0, 0]


def test_new_code_points_count_as_in_the_library():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(pt.path("word_bpe_49k.json"))
    c = prefix_tokens.counter(pt.path("word_bpe_49k.json"))
    for p in [0x558, 0xA7CB, 0xA7DC, 0x1C89, 0x10D50, 0x16EA0, 0x18D0C, 0x18D92, 0x32808, 0x3D808, 0x3285C, 0xE000, 0xAD, 0x200B, 0x378, 0x10FFFF]:
        for text in (f"a{chr(p)}b", f"x {chr(p)}{chr(p)} A1{chr(p)}", chr(p)):
            assert int(c.cut_at(text, 0)[0]) == len(tk.encode(text, add_special_tokens=False).ids), hex(p)


# --- byte-level BPE ------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library_and_round_trips(spark):
    enc = bpe._encoding(bpe.tokenizer_path(), bpe.pattern())
    texts = ODD + noise(5, 30) + ["tab\there", "  spaces   ", "x" * 20000]
    docs = docs_of(spark, texts, ids="clash").unionByName(docs_of(spark, ["again"], ids="clash").withColumn("doc_id", F.lit(None).cast("long"))).repartition(3)
    out = bpe.encoded(docs, block_bytes=2000).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        t = "again" if r.doc_id is None else texts[r.doc_id] or ""
        ids = np.array(enc.encode_ordinary(t), "<u4")
        assert r.ids == ids.tolist() and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decoded_texts(bpe.encoded(docs)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert bpe.digests(docs.limit(0)).count() == 0


def test_bpe_counts_repeated_rows(spark):
    docs = docs_of(spark, ["one text", "one text"]).withColumn("doc_id", F.lit(4).cast("long"))
    assert [r.doc_id for r in bpe.digests(docs).collect()] == [4, 4]


def test_packed_arrays():
    for a in ([], [0], [1, 256, 70000, 2**32 - 1]):
        x, y = bpe.unpack(bpe.pack(np.array(a, np.uint32), np.array([7], np.uint32)))
        assert x.tolist() == a and y.tolist() == [7]
    with pytest.raises(ValueError):
        bpe.decode(np.array([50256]), bpe.tokenizer_path())


# --- WARC ----------------------------------------------------------------------------------------------------------


def brute_warc(rows):
    top = {}
    for page_id, html in rows:
        if page_id is not None:
            top[html or ""] = max(top.get(html or "", page_id), page_id)
    out = []
    for page_id, html in rows:
        t = top.get(html or "")
        out.append((page_id, len((html or "").encode()), None if t is None or page_id == t else t))
    return sorted(out, key=str)


def test_warc_round_trip(spark, tmp_path):
    html = [(1, "<p>a</p>"), (5, "<p>a</p>"), (3, "<p>a</p>"), (7, None), (8, ""), (9, "é" * 50000), (10, "x\r\n\r\ny"), (11, "WARC/1.1\r\n\r\n"), (None, "<p>a</p>"), (12, "u"), (12, "u")]
    df = spark.createDataFrame([(p, f"http://h/{i}\nX: y", h, "extra") for i, (p, h) in enumerate(html)], "page_id long, url string, html string, payload string")
    out = warc.round_trip(df.repartition(3), f"file://{tmp_path}/w").collect()
    assert sorted([(r.page_id, r.payload_bytes, r.refers_to) for r in out], key=str) == brute_warc(html)
    names = re.findall(rb"WARC-Record-ID: (\S+)", b"".join(gzip.open(tmp_path / "w" / f).read() for f in os.listdir(tmp_path / "w") if f.endswith(".warc.gz")))
    refers = re.findall(rb"WARC-Refers-To: (\S+)", b"".join(gzip.open(tmp_path / "w" / f).read() for f in os.listdir(tmp_path / "w") if f.endswith(".warc.gz")))
    assert len(set(names)) == len(html) and refers and set(refers) <= set(names)
    for r in out:
        assert r.digest_ok and (r.record_type == "revisit") == (r.refers_to is not None)
    by = {r.page_id: r for r in out}
    assert by[9].payload_digest == warc.sha1_base32(("é" * 50000).encode()) and by[1].payload_digest == warc.sha1_base32(b"<p>a</p>")
    files = [f for f in os.listdir(tmp_path / "w") if f.endswith(".warc.gz")]
    assert sum(gzip.open(tmp_path / "w" / f).read().count(b"WARC-Type:") for f in files) == len(html)
    full = warc.read_archives(spark.createDataFrame([(f"{tmp_path}/w/{f}",) for f in files], "path string"), f"file://{tmp_path}/w")
    assert full.where("page_id = 10").first().payload == b"x\r\n\r\ny"
    assert warc.round_trip(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_warc_below_the_least_size(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.round_trip(df, least=3).collect()} == {"response"}


def test_revisits_without_their_response(spark):
    kind = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean"
    rows = [(5, "response", None, 3, "A", True), (1, "revisit", 5, 3, "A", None), (2, "revisit", 5, 3, "B", None), (3, "revisit", 9, 3, "A", None), (4, "revisit", 5, 4, "A", None), (6, "response", None, 3, "C", False), (7, "revisit", 6, 3, "C", None)]
    got = {r.page_id: r.digest_ok for r in warc.verified(spark.createDataFrame(rows, kind)).collect()}
    assert got == {5: True, 1: True, 2: False, 3: False, 4: False, 6: False, 7: False}


def test_damaged_archives_are_refused():
    rec = warc.gzip_member(warc.record(1, None, b"abc", warc.sha1_base32(b"abc"), None, 3))
    two = [warc.read_record(p) for p in warc.members(io.BytesIO(rec + rec))]
    assert [b for _, b in two] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        [warc.read_record(p) for p in warc.members(io.BytesIO(rec[:-12]))]
    short = warc.gzip_member(zlib.decompress(rec, 31).replace(b"Content-Length: 3", b"Content-Length: 9"))
    with pytest.raises(ValueError):
        [warc.read_record(p) for p in warc.members(io.BytesIO(short))]


# --- language ------------------------------------------------------------------------------------------------------


def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    net = langid.BiGru(3, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, mask = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5), np.ones((7, 5))
    mask[5:, 2] = 0
    _, g = net.gradients(x, y, mask)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        at = int(np.abs(g[name]).argmax())
        old, step = flat[at], 2e-2
        flat[at] = old + step
        up = net.gradients(x, y, mask)[0]
        flat[at] = old - step
        down = net.gradients(x, y, mask)[0]
        flat[at] = old
        assert g[name].reshape(-1)[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-4)


def test_probabilities_equal_a_plain_network():
    """Byte by byte in both directions, gates written out, pooled over the text."""
    net = langid.BiGru(3, 5)
    text = np.frombuffer("Zwölf Boxkämpfer, jagt!".encode(), np.uint8)
    data = np.r_[text, np.zeros(langid.SEGMENT - len(text), np.uint8)]  # short segments are filled up, and the filling is not pooled
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(order, d):
        w, u, h = net.p[f"w{d}"].astype(float), net.p[f"u{d}"].astype(float), np.zeros(5)
        out = {}
        for t in order:
            x, a = w[data[t]], h @ u
            z, r = sig(2 * (x + a)[:5]), sig(2 * (x + a)[5:10])
            new = np.tanh(x[10:] + 2 * r * a[10:])
            h = z * h + (1 - z) * new
            out[t] = h
        return out

    fore, back = states(range(len(data)), "f"), states(range(len(data) - 1, -1, -1), "b")
    score = np.array([fore[t] @ net.p["cf"] + back[t] @ net.p["cb"] + net.p["bias"] for t in range(len(data))])
    soft = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
    got = langid.pooled(net, text, np.array([0, len(text), len(text)]))
    assert np.allclose(got[0], soft[: len(text)].mean(axis=0), atol=1e-5) and not got[1].any()


def test_rare_languages_are_learned(spark):
    rows = [(i, f"{'ab' if i % 50 else 'xyzzy'} " * 40, "aa" if i % 50 else "zz", "clash") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    known, net = langid.fit(docs, sample=40, steps=60)
    assert known == ["aa", "zz"]
    new = spark.createDataFrame([(1, "xyzzy xyzzy xyzzy"), (2, "ab ab ab ab ab")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(new, known, net).orderBy("doc_id").collect()] == ["zz", "aa"]
    assert langid.fit(docs.limit(0)) == ([], None) and langid.identify(docs.limit(0), [], None).count() == 0


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(30))
    rows = [(i, make("abcdefg" if i % 2 else "qrstuvé"), "xx" if i % 2 else "yy") for i in range(300)]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 !!", "yy"), (1003, "abc" * 4000, None), (None, "abcd", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known, net = langid.fit(docs, 200, 40)
    got = {r.doc_id: r for r in langid.identify(docs.drop("lang"), known, net).collect()}
    assert known == ["xx", "yy"] and len(got) == len(rows)
    held = [(i, lang) for i, _, lang in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].held_out for i, _ in held)
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "xx"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(docs, [], None).collect()} == {"und"}
    assert langid.fit(docs.limit(0)) == ([], None)


def test_segments_cover_every_byte():
    data = np.arange(300, dtype=np.int64).astype(np.uint8)
    x, n, per = langid.segments(data, np.array([0, 0, 130, 300]), 128)
    assert per.tolist() == [0, 2, 2] and n.tolist() == [128, 2, 128, 42]
    assert np.concatenate([x[:k, i] for i, k in enumerate(n)]).tolist() == data.tolist()


# --- quality classifier --------------------------------------------------------------------------------------------


def rated(spark, n=240):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(n):
        g = i % 3
        body = [word() for _ in range(60)]
        if g == 0:
            body = [w.upper() + "!!" for w in body]
        if g == 1:
            body[::10] = ["nasty"] * 6
        rows.append((i, " ".join(body), "s"))
        labels.append((i, 0 if g == 0 else 1, 1 if g == 1 else 0))
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_ordinal_grades(spark):
    docs, labels = rated(spark)
    known = quality.grades(labels.where("doc_id < 180").unionByName(spark.createDataFrame([(None, 1, 0), (500, None, 1)], labels.schema)))
    model = quality.fit(docs, known)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality.rate(docs, model).collect()}
    new = [got[i] for i in range(180, 240)]
    assert sum(r.kept == (r.doc_id % 3 == 2) for r in new) >= 57
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_ordinal_gradient_matches_likelihood():
    """One step on one batch goes along the differences of the weighted log-likelihood, by brute force."""
    from nearfield.llm.features import SIZE

    rng = np.random.default_rng(4)
    n, width = 12, 6
    y, x = np.arange(n) % 3, rng.standard_normal((n, width)).astype(np.float32)
    rows = (np.tile(np.arange(width, dtype=np.int32), n), x.ravel(), np.arange(n) * width, np.full(n, width))

    def loss(w, first, gap):
        t = first + np.array([0.0, np.exp(gap)])
        up = np.c_[np.ones(n), 1 / (1 + np.exp(-((x @ w)[:, None] - t))), np.zeros(n)]
        return -np.log(up[np.arange(n), y] - up[np.arange(n), y + 1]).mean()

    model = quality.Ordinal(3)
    model.fit(y, rows, epochs=1, batch=n, rate=1e-3, decay=0.0)
    moved = np.r_[model.w[:width], model.first, model.gaps]
    at, e = np.zeros(width + 2), 1e-5
    slope = np.array([(loss(*_split(at + e * d)) - loss(*_split(at - e * d))) / (2 * e) for d in np.eye(width + 2)])
    expected = -1e-3 * slope / np.sqrt(1e-3 + slope**2)
    assert np.allclose(moved, expected, atol=2e-6) and not model.w[width:SIZE].any()


def _split(v):
    return v[:-2], v[-2], v[-1]


def test_rated_ids_count_once(spark):
    docs, labels = rated(spark)
    known = quality.grades(labels)
    twice = docs.union(docs).union(docs.withColumn("text", F.lit("zzz zzz zzz")).where("doc_id < 3"))
    rows = quality.texts_of(twice, known.select("doc_id", "grade"))
    assert rows.count() == known.count() and rows.columns == ["doc_id", "grade", "text"]
    assert rows.where("doc_id = 1").first().text == min("zzz zzz zzz", docs.where("doc_id = 1").first().text)


def test_quality_of_odd_rows(spark):
    docs = docs_of(spark, ODD, kept="clash").withColumn("tail", F.lit(1))
    for model in (None, quality.Ordinal(3)):
        rows = {r.doc_id: r for r in quality.rate(docs, model).collect()}
        assert len(rows) == len(ODD) and not any(rows[i].kept for i in range(4))
    assert quality.keep_good(docs, None).count() == len(ODD) - 4
    assert quality.fit(docs, spark.createDataFrame([], "doc_id long, grade int")) is None
    assert quality.rate(docs.limit(0), None).count() == 0


def test_features_score_like_rows():
    from nearfield.llm.features import SIZE, sparse

    texts = [t or "" for t in ODD]
    w = np.random.default_rng(0).standard_normal((SIZE, 2))
    scores = Features(pa.array(texts)).scores(w)
    for i, t in enumerate(texts):
        ids, vals = sparse(Features(pa.array([t])))
        assert np.allclose(scores[i], vals.astype(np.float64) @ w[ids], atol=1e-4), t


# --- mixing --------------------------------------------------------------------------------------------------------


def table(spark, rows):
    k = len(rows[0]) - 1
    return spark.createDataFrame(rows, "n_tokens long, " + ", ".join(f"p{i} double" for i in range(k)))


def replay(rows, steps):
    r = np.ones(len(rows))
    p = np.array([x[1:] for x in rows])
    for v in steps:
        r = np.maximum(0, r - p @ v)
    return r


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    rows = [(int(n), *map(float, x)) for n, x in zip(rng.integers(10, 900, 200), p, strict=True)]
    t = table(spark, rows)
    steps, gaps, wanted, reached = mixing.fit_rates(t, mixing.shares({"a": 0.6, "b": 0.3, "c": 0.1}, ("a", "b", "c")), 3)
    r = replay(rows, steps)
    n = np.array([x[0] for x in rows])
    s = (r * n) @ np.array([x[1:] for x in rows])
    assert (r >= 0).all() and gaps[-1] <= 1e-4 and np.abs(s / n.sum() - [0.6, 0.3, 0.1]).sum() < 2e-4
    assert np.allclose(wanted, n.sum() * np.array([0.6, 0.3, 0.1])) and np.allclose(reached, s)


def test_rates_are_least_squares(spark):
    """Rates of one at least come as near to targets as coordinate descent over all such rates does."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.5, 0.5, 0.5], 40)
    rows = [(int(n), *map(float, x)) for n, x in zip(rng.integers(10, 900, 40), p, strict=True)]
    n, p = np.array([float(x[0]) for x in rows]), np.array([x[1:] for x in rows])
    a = n[:, None] * p
    goal = (1 + p @ [0.1, 0.6, 1.2] * rng.random(40)) @ a  # within reach
    fit = mixing.fit_rates(table(spark, rows), lambda s: goal, 3, passes=60, least=1.0)
    r, best = np.ones(40), np.ones(40)
    for v in fit.steps:
        r = np.maximum(1.0, r - p @ v)
    for _ in range(3000):
        for k in range(40):
            best[k] = max(1.0, best[k] - ((best @ a - goal) @ a[k]) / (a[k] @ a[k]))
    assert (r >= 1).all() and np.abs(r @ a - fit.reached).max() < 1e-6 * n.sum()
    assert np.abs(r @ a - goal).sum() <= np.abs(best @ a - goal).sum() + 2e-3 * n.sum()


def test_tempered_targets_thin_nothing():
    s = np.array([600.0, 300.0, 100.0, 0.0])
    t = mixing.tempered(0.5)(s)
    assert (t >= s - 1e-9).all() and t[3] == 0 and t[0] == pytest.approx(600)


def test_mixing_rows(spark):
    docs, labels = rated(spark)
    found = mixing.rates(docs, mixing.domains_of(labels), mixing.shares(mixing.TARGETS))
    rows = found.collect()
    assert len(rows) == 240 and all(r.rate >= 0 for r in rows)
    tokens = {d: sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS}
    total = sum(r.n_tokens for r in rows)
    assert tokens["clean"] / total == pytest.approx(0.95, abs=0.02)
    langs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "u").otherwise("v")).withColumn("c0", F.lit("clash"))
    names, known = mixing.languages_of(langs)
    assert set(mixing.rates(docs, mixing.domains_of(labels), mixing.shares(mixing.TARGETS)).select("gap").distinct().toPandas().gap) == {rows[0].gap}
    assert [r.n_tokens for r in mixing.rates(docs, mixing.domains_of(labels), mixing.shares(mixing.TARGETS), ranks=bpe.tokenizer_path()).where("doc_id = 3").collect()] == [bpe.token_counts([docs.where("doc_id = 3").first().text], bpe.tokenizer_path())[0]]
    out = mixing.mix(langs, known, mixing.tempered(0.5), names, least=1.0)
    assert out.columns == langs.columns and {r.doc_id for r in out.collect()} == set(range(240)) and out.count() > 240


def test_mixing_odd_rows(spark):
    docs = docs_of(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, domain int")
    assert mixing.rates(docs, none, mixing.shares(mixing.TARGETS)).count() == len(ODD)
    assert mixing.mix(docs.limit(0), none, mixing.tempered(0.7), ()).count() == 0
    assert mixing.fit_rates(table(spark, [(0, 1.0, 0.0)]), mixing.tempered(0.7), 2) == ([], [], [0.0, 0.0], [0.0, 0.0])
    assert mixing.totals(docs, none, mixing.shares(mixing.TARGETS)).count() == 3


def test_workers_give_freed_memory_back(monkeypatch):
    """A worker that idles beside the next stage holds little of what its last task used."""
    import pyarrow as pa

    from nearfield.llm import text

    calls, real = [], text.give_back
    monkeypatch.setattr(text, "give_back", lambda: calls.append(real()))
    batch = pa.RecordBatch.from_pydict({"text": ["a b", None, "c"]})
    got = [b.num_rows for b in text.blocks([batch, batch], "text", 1)]
    assert sum(got) == 6 and calls == [None]
