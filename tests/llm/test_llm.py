"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def split(t):
    return [w for w in re.split("[ \t-\r]+", (t or "").translate(LOW)) if w]


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    out = []
    for i in range(60):
        out.append((i, prose(rng, rng.randint(1, 160), words), "en" if i % 2 else "de", "s", 1))
    base = prose(rng, 200, words)
    for i in range(60, 72):  # near copies, links of different lengths
        w = base.split()
        for _ in range(i - 60):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(99))
        out.append((i, " ".join(w), "en", "s", 1))
    out += [(80, base, "en", None, None), (81, base.upper(), None, "s", 1), (82, None, "en", "s", 0), (83, "", "en", "s", 0), (84, "one", "en", "s", 3), (85, "  \n ", "en", "s", 4), (86, "12 34 !!", "de", "s", 8), (87, prose(rng, 30_000, words), "de", "s", 1), (80, base, "en", None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def shingles(t, n):
    w = split(t)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_links(docs, rows, n):
    from ampliflow.llm.minhash import near_duplicates

    sets = {r[0]: shingles(r[1], n) for r in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = near_duplicates(docs.withColumn("n_shingles", docs.n_chars), ngram=n).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(d, len(s), root(d), root(d) == d) for d, s in sets.items()}


def test_minhash_ids_of_several_texts(spark):
    from ampliflow.llm.minhash import near_duplicates

    text = lambda c, n=30: " ".join(f"{c}{k}" for k in range(n))
    data = [(1, text("a")), (1, text("b")), (2, text("b") + " x"), (5, text("c")), (6, text("c")), (6, text("d")), (7, text("d") + " y"), (8, text("e")), (None, text("a"))]
    out = near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out if r.doc_id) == [(1, 1), (1, 1), (2, 1), (5, 5), (6, 5), (6, 5), (7, 5), (8, 8)]


def test_minhash_empty(docs):
    from ampliflow.llm.minhash import near_duplicates

    assert near_duplicates(docs.limit(0)).collect() == []


def test_components_by_contraction(spark, tmp_path):
    from ampliflow.llm.common import Scratch, components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(50, 50), (3, 5)], "a long, b long")
    got = {r.id: r.component for r in components(edges, Scratch(spark), "t", most=0).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(40) if i in got) and len(got) == 40


def test_passages_small_and_hot(docs, rows):
    from ampliflow.llm.passages import shared_passages

    grams, want = Counter(), {}
    texts = dict((r[0], split(r[1])) for r in rows)
    for w in texts.values():
        grams.update({tuple(w[i : i + 50]) for i in range(len(w) - 49)})
    for d, w in texts.items():
        hit = sorted({j for i in range(len(w) - 49) if grams[tuple(w[i : i + 50])] > 1 for j in range(i, i + 50)})
        if hit:
            want[d] = len(hit)
    for hot in (100_000, 3):
        assert {r.doc_id: r.n_shared for r in shared_passages(docs, hot=hot).collect()} == want


def test_passages_edges(spark):
    from ampliflow.llm.passages import shared_passages

    long = " ".join(f"{'x' * 40}{k}" for k in range(60))
    names = [f"n{k}" for k in range(200)]
    data = [(1, long, 5), (2, "Other " + long, 5), (3, " ".join(names[:55]), 5), (3, " ".join(names[:55]), 5), (4, " ".join(names[100:]), 5), (None, long, 5), (5, None, 5), (6, "", 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, key int")
    for hot in (100_000, 1):
        assert {(r.doc_id, r.n_shared, r.passages) for r in shared_passages(docs, hot=hot).collect()} == {(1, 60, "0:60"), (2, 60, "1:61")}
    assert shared_passages(docs.limit(0)).collect() == []
    assert shared_passages(docs.filter("doc_id IN (3, 4)")).collect() == []


@pytest.mark.parametrize("hot", [100_000, 1000])
def test_passages_around_a_common_text(spark, hot):
    from ampliflow.llm.passages import shared_passages

    common = " ".join(f"common{k}" for k in range(49))
    docs = spark.range(60_000, numPartitions=4).selectExpr("id AS doc_id", f"concat_ws(' ', {', '.join(f'concat(id, chr({97 + k}))' for k in range(8))}, '{common}', {', '.join(f'concat(id, chr({105 + k}))' for k in range(8))}) AS text")
    assert shared_passages(docs, hot=hot).count() == 0


def test_decontamination_by_windows(spark, docs, rows):
    from ampliflow.llm.decontaminate import decontaminate

    texts = [r[1] for r in rows]
    items = [(1, " ".join(texts[3].split()[:40])), (2, texts[60]), (2, texts[60]), (3, "One"), (4, None), (None, " ".join(texts[5].split()[:20])), (5, "!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    wins = {}
    for i, t in items:
        w = word(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).update(() if i is None else (str(i),))
    want = []
    for r in rows:
        w, hit, got = word(r[1]), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    got |= wins[x]
        want.append((r[0], len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    for sizes in ({}, {"block_bytes": 300}, {"block_bytes": 300, "part_bytes": 900}):
        out = decontaminate(docs, bench, **sizes).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out) == sorted(want)


def test_decontamination_edges(spark):
    from ampliflow.llm.decontaminate import decontaminate

    words = [f"w{k}" for k in range(5000)]
    passage = " ".join(f"q{k}" for k in range(13))
    data = [(1, " ".join([*words[:2500], passage, *words[2500:]]), 9), (2, " ".join(words), 9), (3, None, None), (4, "", 9), (4, "", 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, N_Hit int")
    bench = spark.createDataFrame([(7, passage), (8, "Q5"), (8, "none of it")], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate(docs, bench).collect()}
    assert (out[1].n_hit, out[1].n_whole, out[1].contaminated, out[1].item_ids) == (13, 1, False, ["7", "8"])
    assert [out[k].n_hit for k in (2, 3, 4)] == [0, 0, 0] and out[4].n_words == 0
    assert decontaminate(docs.limit(0), bench).collect() == []
    assert {r.n_items for r in decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_packing_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from ampliflow.llm.pack import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    once = docs.dropDuplicates(["doc_id"])
    got = pack(once, path, group_tokens=30_000).toPandas()
    for d, text in {r[0]: r[1] for r in rows}.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        at = 0
        for r in got[got.doc_id == d].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
        n = int(s.length.sum())
        assert n <= 4096 and n & (n - 1) == 0


def test_tokens_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    from ampliflow.llm.tokens import Bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), Bpe(path)
    points = [f"a{chr(c)}B {chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x33000 or 0xE0000 <= c < 0xE0200)]
    for lo in range(0, len(points), 5000):
        some = points[lo : lo + 5000]
        assert [b.tolist() for b in own.encode(some)] == [e.ids for e in t.encode_batch(some, add_special_tokens=False)]
    odd = ["", "aaaa x'super ''s 'tis we'll,'s 12'd34", "a\xa0b c\x1cd\x85e", "İstanbul ΑΣ.", "<|endoftext|>q", "漢字 デスト é é", None, "'", "q'"]
    for a, b in zip(odd, own.encode(odd), strict=True):
        assert b.tolist() == t.encode(a or "", add_special_tokens=False).ids


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def test_pii_base_spans(spark):
    from ampliflow.llm.pii import find_pii, redact

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1290.+@- ()%é\U0001f600:,") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "1.2.3.4.5.6.7.8.9", "a@b.c_d@e.f.", "x" * 20_000 + " a@b.co", "9" * 20_000, "a@b.c " * 600, "0255.1.01.1 256.1.1.1 4111 1111 1111 1111", 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"', "call +1 (988) 555-2485 now"]
    out = redact(find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    for r in out:
        t = texts[r.doc_id] or ""
        want = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, t) if valid(k, m.group()))
        said = [f"{k}:{a}:{b}" for a, _, b, k in want]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in BASE]
        assert set(said) <= set(filter(None, r.spans.split(",")))
    by = {r.doc_id: r for r in out}
    assert by[len(texts) - 1].text == "call <PHONE> now"
    assert "secret:9:49" in by[len(texts) - 2].spans


def test_pii_keeps_columns_and_long_secrets(spark):
    from ampliflow.llm.pii import find_pii

    key = "a1" * 400
    data = [(1, f'secret = "{key}" end', "t", "c", 7), (2, None, "t", "c", 7), (2, "_" * 5000 + " x", "t", "c", 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, _text string, __cand string, Spans int")
    out = find_pii(docs).orderBy("doc_id").collect()
    assert {(r._text, r["__cand"]) for r in out} == {("t", "c")} and "Spans" not in out[0].asDict()
    assert out[0].spans == "secret:10:810" and out[1].spans == out[2].spans == ""
    assert find_pii(docs.limit(0)).collect() == []


def test_pii_classifier_beats_majority():
    from ampliflow.llm.pii import WORDS, estimate, odds, train

    rng = np.random.default_rng(9)
    n = 6000
    true = rng.random(n) < 0.4
    right = [0.92, 0.6, 0.58, 0.6, 0.57, 0.6]  # two labelers in three are nearly noise
    votes = np.stack([np.where(rng.random(n) < 0.25, 0, np.where((rng.random(n) < r) == true, 1, -1)) for r in right], 1)
    features = np.zeros((n, 11))
    features[:, 1] = np.clip(rng.normal(0.3 + 0.3 * true, 0.15), 0, 1)
    word = np.where(rng.random(n) < 0.5, true * 3, rng.integers(0, WORDS, n))
    seen = Counter(map(tuple, votes.tolist()))
    patterns = [(list(v), c) for v, c in sorted(seen.items())]
    probable, rates, _ = estimate(patterns)
    post = dict(zip(sorted(seen), probable, strict=True))
    each = np.array([post[tuple(v)] for v in votes.tolist()])
    w = train(features, word, np.ones(n), each)
    votes_say = sum(np.where(v > 0, yes, np.where(v < 0, no, 0)) for v, (yes, no) in zip(votes.T, odds(rates), strict=True))
    x = np.concatenate([np.ones((n, 1)), features, np.eye(WORDS)[word]], 1)
    share = lambda said: (said == true).mean()
    assert share(x @ w + votes_say > 0) > share(each > 0.5) + 0.02 and share(each > 0.5) > share(votes.sum(1) > 0) + 0.04


def test_vectors_against_brute_force(spark):
    from ampliflow.llm.vectors import near_vectors

    rng = np.random.default_rng(4)
    seeds = rng.normal(size=(12, 16))
    data = [(i, (seeds[i % 12] + rng.normal(size=16) * (0.12 if i % 3 else 0.3)).tolist(), i % 2 if i % 12 else None) for i in range(150)]
    data += [(200, [0.0] * 16, 1), (201, None, 1), (202, [None] * 16, 1), (203, [float("nan")] * 16, 0), (204, [1.0, 2.0], 0), (205, [2.0, 4.0], 0), (206, data[1][1], 1), (206, data[1][1], 1)]
    out = near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    ok = [k for k, (_, v, lab) in enumerate(data) if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if len(a) == len(b) else 0
    links = {k: [j for j in ok if j != k and data[j][2] == data[k][2] and cos(data[j][1], data[k][1]) >= 0.93] if k in ok else [] for k in range(len(data))}
    label = {k: data[k][0] for k in links}
    for _ in range(len(data)):
        label = {k: min([label[k], *(label[j] for j in links[k])]) for k in links}
    want = sorted((data[k][0], len(links[k]), label[k], data[k][0] == label[k]) for k in links)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == want


def brute_links(units):
    link = units @ units.T >= 0.93
    np.fill_diagonal(link, False)
    return link


def test_vectors_of_two_tight_clusters(spark):
    from ampliflow.llm.vectors import near_vectors

    rng = np.random.default_rng(12)
    centre = np.eye(24)[0], np.array([0.944, math.sqrt(1 - 0.944**2)] + [0] * 22)
    x = np.concatenate([c + 0.004 * rng.normal(size=(30, 24)) for c in centre])
    link = brute_links(x / np.linalg.norm(x, axis=1)[:, None])
    assert link.all(1, where=~np.eye(60, dtype=bool)).all()
    out = near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in out} == {(59, 0)} and sum(r.kept for r in out) == 1


def test_vectors_isolated_pairs_in_many_leaves(spark):
    from ampliflow.llm.vectors import near_vectors

    rng = np.random.default_rng(13)
    x = rng.normal(size=(12_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=(300, 32))
    side -= (side * x[:300]).sum(1)[:, None] * x[:300]
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(0.931, 0.95, 300)[:, None]
    x[300:600] = c * x[:300] + np.sqrt(1 - c * c) * side
    want = brute_links(x).sum(1)
    out = near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    got = np.array([r.n_links for r in sorted(out, key=lambda r: r.vec_id)])
    assert want.sum() >= 600 and (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_urls(spark):
    from ampliflow.llm.urls import filter_urls

    urls = ["https://A.Example.com/en/71?x", "http://example.com/en/8", "ftp://x.net/de/1", "http://example.net/de/8#a", "no url", None, "http://notexample.org", "http://e.org?/es/", "http://evil.org/es/1"] * 4
    out = sorted(filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule) for r in out[:9]] == [("a.example.com", "/en/71", "example.com/en/7"), ("example.com", "/en/8", "com/en/"), ("x.net", "/de/1", "net/de/"), ("example.net", "/de/8", "example.net/de/8"), ("", "", None), ("", "", None), ("notexample.org", "", None), ("e.org", "", None), ("evil.org", "/es/1", "org/es/")]
    assert [r.verdict for r in out[:4]] == ["allow", "block", "allow", "block"]
    assert all(r.verdict in ("allow", "block") for r in out)


def test_trees_learn():
    from ampliflow.llm.urls import boosted, grow

    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    assert ((boosted(x[1000:], grow(x[:1000], y[:1000])) > 0.5) == y[1000:]).mean() > 0.93


def test_recurrent_gradient():
    from ampliflow.llm.language import BiGru

    net = BiGru(["a", "b"], 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.array([[1, 2, 3], [3, 2, 9]], np.uint8), np.array([0, 1])
    _, g = net.gradient(x, y)
    for k in net.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = net.p[k][at]
        loss = []
        for d in (1e-2, -1e-2):
            net.p[k][at] = old + d
            loss.append(net.gradient(x, y)[0])
        net.p[k][at] = old
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(g[k][at], rel=0.02, abs=1e-4)


def test_language_held_out(spark, docs):
    from ampliflow.llm.language import language_of

    rng = random.Random(8)
    word = {"x": ["foo", "bar", "zoo"], "y": ["ist", "ung", "ein"]}
    data = [(i, " ".join(rng.choice(word["xy"[i % 2]]) for _ in range(12)), "xy"[i % 2]) for i in range(200)] + [(300, None, "x"), (301, "12", "y"), (302, "ein ein", None)]
    out = {r.doc_id: r for r in language_of(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert out[300].lang_pred == out[301].lang_pred == "und" and out[302].lang_pred == "y"
    assert all(out[i].lang_pred == "xy"[i % 2] for i in range(200))
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())


def test_language_model_base(spark, docs, rows):
    from pyspark.sql import functions as F

    from ampliflow.llm.lm import score

    token = lambda t: [*split(t), None]
    c = Counter()
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            c.update(token(r[1]))
    n, v = sum(c.values()), len(c)
    for shared in (1 << 20, 50):
        out = score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, shared=shared).collect()
        assert len(out) == len(rows)
        text = {r[0]: r[1] for r in rows}
        for r in out:
            t = token(text[r.doc_id])
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[x] > 0 for x in t), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t))
            assert math.isfinite(r.score) and r.score <= 0


def test_language_model_without_class_words():
    from ampliflow.llm.lm import CLASSES, PER_CLASS, SLOTS, Model, Words

    rng = np.random.default_rng(4)
    token, begin = rng.integers(1 << 40, 1 << 62, 9000).astype(np.uint64), np.array([0, 9000])
    for top in (np.zeros(0, np.uint64), np.arange(1, CLASSES * PER_CLASS + 1, dtype=np.uint64)):
        model, seen = Model(Words(top, np.full(len(top), 9), np.zeros(len(top), int))), (np.zeros(SLOTS), np.zeros(SLOTS))
        model.begin(9 * len(top))
        before = model.inner.copy()
        model.update(token, begin, seen)
        logp = model.log10(token, begin)
        assert np.isfinite(logp).all() and (logp <= 0).all() and np.array_equal(model.inner, before)


@pytest.mark.parametrize("size", [1024, 50])
def test_language_model_sums_to_one(size):
    from ampliflow.llm.lm import SLOTS, Model, Words

    rng = np.random.default_rng(7)
    keys = np.arange(1, size + 9, dtype=np.uint64)
    words = Words(keys, np.append(np.full(size, 50), np.full(8, 2)), np.append(rng.integers(0, 8, size), np.arange(8)))
    model, seen = Model(words), (np.zeros(SLOTS), np.zeros(SLOTS))
    model.begin(50 * size + 16)
    model.update(rng.integers(1, size + 200, 20_000).astype(np.uint64), np.array([0, 20_000]), seen)
    before = np.array([3, 99, 1], np.uint64)
    text = np.concatenate([np.append(before, w) for w in [*keys, np.uint64(10**9)]])  # each word or class once, then that of new words
    logp = model.log10(text, np.arange(0, len(text) + 1, 4))
    assert (10 ** logp[3::4]).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    from pyspark.sql import functions as F

    from ampliflow.llm.lm import score

    rng = random.Random(11)
    words = {k: [f"{k}{''.join(rng.choice('abcdefgh') for _ in range(4))}" for _ in range(700)] for k in "xyz"}
    data = [(i, " ".join(w + (" " + w[::-1] if rng.random() < 0.5 else "") for w in (rng.choice(words["xyz"[i % 3]]) for _ in range(rng.randint(20, 60))))) for i in range(900)]
    out = score(spark.createDataFrame(data, "doc_id long, text string"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2).filter("held_out").collect()
    gain = [(r.score - r.base_score) / r.n_tokens for r in out]
    assert len(out) > 90 and sum(gain) / len(gain) > 0.25 and sum(g > 0 for g in gain) > 0.95 * len(gain)
    assert score(spark.createDataFrame(data[:0], "doc_id long, text string"), F.lit(True)).collect() == []


def test_language_model_learns_topics_from_all_texts(spark):
    from pyspark.sql import functions as F

    from ampliflow.llm.lm import score

    rng = random.Random(12)
    words = {k: [f"{k}{i}" for i in range(2000)] for k in "xy"}
    data = [(i, prose(rng, 14_000, words["xy"[i % 2]])) for i in range(32)]  # all of more than 64 KB
    assert all(len(t) > 1 << 16 for _, t in data)
    out = score(spark.createDataFrame(data, "doc_id long, text string").repartition(3), F.col("doc_id") < 28).filter("held_out").collect()
    assert len(out) == 4 and all((r.score - r.base_score) / r.n_tokens > 0.1 for r in out)  # at most log10(2) if topics are told apart


def test_language_model_counts_words_of_any_length(spark):
    from pyspark.sql import functions as F

    from ampliflow.llm.common import LOWER, NOT_SPACE, word_hashes, words
    from ampliflow.llm.lm import SPAN, hashes, score

    rng = random.Random(17)
    text = " ".join("Ab" * rng.randint(1, 2000) + str(rng.randrange(99)) for _ in range(300)) + "  \n é x"
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = words(data, np.array([0, 9, len(data)]), NOT_SPACE)  # the second text begins inside a word
    assert len(data) > 4 * SPAN and np.array_equal(hashes(data, start, end), word_hashes(LOWER[data], start, end))
    long = "y" * (3 * SPAN)
    rows = [(i, f"one two{i % 5} " + (f"{long} " if i % 3 == 0 else "") + "three") for i in range(24)]
    c = Counter(w for _, t in rows for w in [*split(t), None])
    n, v = sum(c.values()), len(c)
    for r in score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), F.lit(True)).collect():
        t = [*split(rows[r.doc_id][1]), None]
        assert r.n_known == len(t) and r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t))


def test_language_model_of_many_small_partitions_keeps_little_on_disk(spark):
    import os

    from pyspark.sql import functions as F

    from ampliflow.llm.lm import score

    rng = random.Random(18)
    words = [f"w{i}" for i in range(900)]
    docs = spark.createDataFrame([(i, prose(rng, 4000, words)) for i in range(96)], "doc_id long, text string").repartition(96).localCheckpoint()
    kept = lambda: sorted(os.listdir(spark.sparkContext._temp_dir))
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before, files = sent(), kept()
    assert score(docs, F.lit(True)).count() == 96
    assert kept() == files  # copies of broadcasts go as soon as they were used
    assert sent() - before < 60e6


def test_sums_by_slot_equal_brute_force():
    from ampliflow.llm.lm import NEAR, by_slot

    rng = np.random.default_rng(19)
    for top in (1, NEAR, 40, 30_000):  # all in one slot, as many as are added one by one, mostly apart
        slot, grad = np.minimum(rng.geometric(1 / top, (4, 700)), 32_767).astype(np.uint16), rng.normal(size=(700, 5)).astype(np.float32)
        u, c, total = by_slot(slot, grad)
        assert sorted(u.tolist()) == sorted(set(slot.ravel().tolist()))
        for s, n, t in zip(u, c, total, strict=True):
            row = np.nonzero(slot == s)[1]
            assert n == len(row) and t == pytest.approx(grad[row].astype(float).sum(0), abs=1e-4)


def test_topics_of_texts_and_words_equal_brute_force(spark, tmp_path):
    from ampliflow.llm.common import Scratch, text_buffers
    from ampliflow.llm.lm import TOPICS, _entries, _sum, _topic_of_words, _topics, by_topic, tokens

    rng = random.Random(13)
    words = {k: [f"{k}{i}" for i in range(60)] for k in "abcdefgh"}
    data = [("abcdefgh"[i % 8], prose(rng, rng.randint(0, 40), words["abcdefgh"[i % 8]])) for i in range(2600)]
    data += [("a", None), ("a", ""), ("b", prose(rng, 20_000, words["b"]))]
    hashed = lambda t: tokens(*text_buffers(pa.array([t], pa.string())))[0].tolist()
    count = Counter(w for _, t in data for w in hashed(t))
    key = np.array(sorted(count, key=lambda w: (-count[w], w))[:400], np.uint64)
    tables, each = [], []
    for parts in (1, 5):
        docs = spark.createDataFrame(data, "kind string, text string").repartition(parts)
        held = _sum(_entries(docs, np.sort(key)), lambda word, times, begin: by_topic(times, word, begin, np.zeros(len(begin) - 1, int), len(key)))
        assert held[0].tolist() == [count[w] for w in np.sort(key).tolist()] and not held[1:].any()
        table = _topics(docs, key, Scratch(spark))
        tables.append(table)
        each.append(_topic_of_words(docs, table, np.array(sorted(count), np.uint64)))
    assert np.array_equal(tables[0][0], tables[1][0]) and np.array_equal(tables[0][1], tables[1][1]) and np.array_equal(*each)
    at, odds = {w: i for i, w in enumerate(tables[0][0].tolist())}, tables[0][1]
    by_word, of_kind = {w: Counter() for w in count}, Counter()
    for k, t in data:
        topic = int(sum((odds[at[w]] for w in hashed(t) if w in at), np.zeros(TOPICS)).argmax())
        of_kind[k, topic] += 1
        for w in hashed(t):
            by_word[w][topic] += 1
    assert each[0].tolist() == [min(c, key=lambda t: (-c[t], t)) for _, c in sorted(by_word.items())]
    assert sum(max(of_kind[k, t] for t in range(TOPICS)) for k in "abcdefgh") > 0.9 * len(data)  # a kind is in one topic
    assert len({max(range(TOPICS), key=lambda t: of_kind[k, t]) for k in "abcdefgh"}) >= 6  # and kinds in different ones


def test_fixity_audit(spark):
    from pyspark.sql import functions as F

    from ampliflow.llm.warc import archive, audit

    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>" + "z" * 900) for i in range(300)] + [(None, None, None)], "page_id long, url string, html string")
    a = archive(pages)
    b = archive(pages.withColumn("html", F.when(F.col("page_id") == 7, F.concat(F.lit("["), F.substr("html", F.lit(2)))).otherwise(F.col("html")))).filter("page_id <> 100")
    assert {(r.page_id, r.status) for r in audit(a, b).collect()} == {(7, "corrupt"), (100, "missing")}
    assert {(r.page_id, r.status) for r in audit(b, a).collect()} == {(7, "corrupt"), (100, "extra")}
    assert audit(a, a).collect() == []


def test_fixity_of_warc_files(spark, tmp_path):
    import gzip

    from ampliflow.llm.warc import audit, read_warc

    def record(name, body):
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <" + name + b">\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"

    some = [record(b"r%d" % k, b"x%d" % k * 900) for k in range(200)]
    for folder, parts in (("a", some), ("b", [*some[:70], some[70].replace(b"x70", b"y70", 1), *some[71:]])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
        (tmp_path / folder / "two.warc").write_bytes(some[3] + b"junk\r\n" + some[4][:-9])
    a, b = (read_warc(spark, str(tmp_path / x)) for x in "ab")
    assert a.filter("file = 'one.warc.gz'").count() == 200 and a.filter("file = 'two.warc'").count() == 3
    assert [(r.file, r.offset, r.status, r.page_id) for r in audit(a, b).collect()] == [("one.warc.gz", sum(map(len, some[:70])), "corrupt", "<r70>")]
    assert audit(a, a.limit(0)).filter("status = 'missing'").count() == 203


def test_urls_in_any_order_and_held_out_accuracy(spark):
    from ampliflow.llm.urls import filter_urls

    rng = random.Random(17)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    good = lambda h: f"https://{h}/{word(6)}/{word(5)}"
    bad = lambda h: f"http://{h}/{rng.randrange(10**9)}?a={rng.randrange(10**6)}&b={word(3)}&c=%20{rng.randrange(99)}"
    hosts = [f"{word(7)}.{e}" for e in ("aa", "bb") for _ in range(40)]
    rules = [("block" if k % 2 else "allow", h + "/") for k, h in enumerate(hosts[:50])]
    urls = [(bad if k % 2 else good)(h) for k, h in enumerate(hosts) for _ in range(12)] + [None, "x", ""]
    urls += [good(hosts[0])] * 3000  # one URL many times
    data = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, Host string")
    runs = [sorted((r.page_id, r.verdict, r.block_score, r.rule) for r in filter_urls(data.repartition(n), rules).collect()) for n in (2, 7)]
    assert str(runs[0]) == str(runs[1])
    free = [(i, v) for i, v, _, rule in runs[0] if rule is None and i < 80 * 12]
    assert len(free) == 30 * 12 and sum((v == "block") == (i // 12 % 2 == 1) for i, v in free) > 0.95 * len(free)
    assert filter_urls(data.limit(0), rules).collect() == []


def test_empty_tables_and_clashing_columns(spark):
    import public_tokenizers
    from pyspark.sql import functions as F

    from ampliflow.llm.language import language_of
    from ampliflow.llm.lm import score
    from ampliflow.llm.pack import pack
    from ampliflow.llm.vectors import near_vectors
    from ampliflow.llm.warc import archive, audit

    path = public_tokenizers.path("word_bpe_49k.json")
    data = spark.createDataFrame([(1, "Ein Satz.", "de", 5, 5), (1, "Ein Satz.", "de", 5, 5), (2, None, None, None, 5), (None, "漢字" * 40, "zh", 5, 5)], "doc_id long, text string, lang string, score int, offset int")
    made = {"language": lambda d: language_of(d), "score": lambda d: score(d, F.col("doc_id") != 2), "pack": lambda d: pack(d, path)}
    for name, f in made.items():
        assert f(data.limit(0)).collect() == [], name
        assert len(f(data).collect()) >= 4, name
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1, 7)], "vec_id long, embedding array<double>, label int, n_links int")
    assert [(r.n_links, r.kept) for r in near_vectors(vectors).collect()] == [(0, True)] and near_vectors(vectors.limit(0)).collect() == []
    pages = spark.createDataFrame([(None, "u", "h", "z"), (None, None, None, "z"), (1, "u", "h", "z")], "page_id long, url string, html string, digest string")
    assert audit(archive(pages), archive(pages)).collect() == [] and audit(archive(pages.limit(0)), archive(pages.limit(0))).collect() == []


def test_pipeline_drops_long_documents_with_a_passage(spark):
    import corpus_pipeline as c

    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first().text
    long = " ".join(f"wort{k}" for k in range(5000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long}", "en", "s", 1), (2, long, "en", "s", 1)], SCHEMA)
    assert [r.doc_id for r in c.decontamination(spark, docs, "/root/testdata/sf0.001").collect()] == [2]


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as c

    now = docs
    for name, stage in c.STAGES[:-1]:
        now = stage(spark, now, "/root/testdata/sf0.001")
        assert now.columns == docs.columns, name
    ids = [r.doc_id for r in now.collect()]
    assert len(ids) == len(set(ids)) and not {82, 83, 85, 86} & set(ids) and 60 in ids
