"""Operators 11 to 13 against plain Python, with nulls, empties, ties, repeats, long texts and clashing names."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_middle, phrases, url_filters

CLASHING = ["n", "form", "output", "digest", "ends", "copies", "rank", "score", "a", "l", "r", "w1", "range", "host", "path", "rule", "verdict", "label", "length", "features", "probability", "__id", "__url", "__digest", "p_block"]
EXTRA = ", ".join(f"`{c}` long" for c in CLASHING)
PROSE = "the old mill by the river, the old mill by the road. Where the old mill stood; there the River bends!"
TEXTS = [
    PROSE, PROSE, PROSE.upper(), None, "", " ", " \t\n", "word", " word", "word \n", "a  b\tc\r\nd ", "has <P> inside", "<S>", "near <M", "<M><P", "İstanbul K 日本語 🎉🎉  é ", "\x1c\x85 odd\x0bmarks\x0c",
    " ".join(f"w{i * 7919 % 997}" for i in range(60_000)), "x" * 50_000, "no break " * 5_000,
]


def rows():
    out = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 2}") for i, t in enumerate(TEXTS)]
    out += [out[0], (0, "another text of a taken id", "en", None), (None, PROSE, None, None), (None, None, None, None), *[(100 + i, PROSE + " copy", "en", "hot") for i in range(40)]]
    return [(*r, *range(len(CLASHING))) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, " + EXTRA).repartition(5)


# --- 13 -----------------------------------------------------------------------------------------------------------
def _cut(doc_id, text):
    text = text or ""
    tokens = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    assert "".join(tokens) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("broadcast", [1 << 26, 0])
def test_fill_middle(docs, monkeypatch, broadcast):
    monkeypatch.setattr(fill_middle, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(fill_middle, "HOT", 0.1)
    df = docs.unionByName(docs.select((F.col("doc_id") + 1_000).alias("doc_id"), *docs.columns[1:]))
    every = [r[:2] for r in rows()] + [(None if r[0] is None else r[0] + 1_000, r[1]) for r in rows()]
    found = fill_middle.transform(df)
    got = found.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got))) == sorted(map(str, ((i, *_cut(i, t)) for i, t in every)))
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in every)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    sums = fill_middle.digests(found).where("doc_id = 1017").first()
    assert sums["restored_sha256"] == hashlib.sha256(TEXTS[17].encode()).hexdigest() and sums["output_sha256"] == hashlib.sha256(_cut(1017, TEXTS[17])[-1].encode()).hexdigest()
    assert fill_middle.digests(fill_middle.transform(docs.limit(0))).count() == 0


def test_index_of_distinct_texts(spark, docs):
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    index = {bytes(r["__digest"]): r for r in fill_middle.index(keyed).collect()}
    counts = Counter(r[1] or "" for r in rows())
    assert {k: r["copies"] for k, r in index.items()} == {hashlib.sha256(t.encode()).digest(): n for t, n in counts.items() if n > 1}
    for t in counts:
        if counts[t] > 1:
            ends = fill_middle.boundaries(t.encode())
            packed = bytes(index[hashlib.sha256(t.encode()).digest()]["ends"])
            assert [fill_middle.select(packed, i) for i in range(1, len(ends) + 1)] == ends.tolist()


def test_elias_fano_lists():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 0), (0, 9), (1, 1), (1, 1 << 40), (5, 5), (900, 1_000), (900, 10_000_000)):
        ends = np.sort(rng.choice(min(universe, 1 << 20), n, replace=False)) + 1 if n else np.zeros(0, dtype=np.int64)
        packed = fill_middle.pack(ends, universe)
        assert fill_middle.length(packed) == n and [fill_middle.select(packed, i) for i in range(n + 1)] == [0, *ends.tolist()]
        assert len(packed) <= 17 + (n * (2 + math.log2(max(universe / max(n, 1), 1))) + 24) / 8 + 1


# --- 12 -----------------------------------------------------------------------------------------------------------
def _collocations(docs, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in found.items():
            for q in ((p[:2], p[1:]) if len(p) == 3 else ()):
                inside[q] = max(inside[q], a)
        ranked = []
        for p, a in found.items():
            if 100 * inside[p] < 50 * a or p not in inside:
                score, _, le, ri = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), le, ri))
        out += [(lang, i, p.decode(), -a, le, ri, n[lang], -s) for i, (s, a, p, le, ri) in enumerate(sorted(ranked)[:top], 1)]
    return out


@pytest.mark.parametrize("size", [400, 1 << 20])
def test_phrases(spark, docs, monkeypatch, size):
    monkeypatch.setattr(phrases, "TRIE_BYTES", size)
    monkeypatch.setattr(phrases, "HELD_BYTES", 3 * size)
    monkeypatch.setattr(phrases, "RANGE_BYTES", 30_000)
    monkeypatch.setattr(phrases, "PARTS", 3)
    rng = np.random.default_rng(2)
    words = ["the", "of", "Hot", "pair", "é", "日本", "K", *[f"w{i}" for i in range(12)]]
    texts = [(int(i), "".join(f"{'hot pair ' if rng.random() < 0.1 else ''}{rng.choice(words, p=np.r_[0.3, [0.7 / 18] * 18])}{rng.choice([' ', '  ', chr(9), ', ', '. ', chr(10), chr(13), chr(11), chr(28)], p=[0.6] + [0.05] * 8)}" for _ in range(rng.integers(0, 120)))) for i in range(150)]
    made = spark.createDataFrame([(i, t, ("en", "de", None, "und")[i % 4]) for i, t in texts], "doc_id long, text string, lang string")
    every = [(r[2], r[1]) for r in rows()] + [(("en", "de", None, "und")[i % 4], t) for i, t in texts]
    df = docs.unionByName(made, allowMissingColumns=True)
    got = phrases.collocations(df, 3, 40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(_collocations(every, 3, 40))
    assert phrases.collocations(df.limit(0)).count() == 0


def test_parts_of_long_texts_count_each_phrase_once():
    rng = np.random.default_rng(3)
    text = "".join(f"{rng.choice(['a', 'bb', 'ccc', 'é'])}{rng.choice([' ', '. ', '  ', ','])}" for _ in range(3_000)).encode()
    whole = phrases.Trie.of([(text, len(text))])
    for size in (1, 7, 100, 2_999):
        parts = list(phrases._parts(text, size))
        cut = phrases.Trie.of(parts)
        assert len(parts) > 2
        for a, b in zip(_counts(whole), _counts(cut), strict=True):
            assert a == b
    for shards in (1, 3):
        packed = [(w, n) for t in [whole] * shards for r, w, n in t.cut(4) if r == 2]
        _, levels, total = phrases._merged(packed, 1)
        single = phrases._merged(packed[:1], 1)
        assert total == shards * single[2] and [n.tolist() for _, n in levels] == [(shards * n).tolist() for _, n in single[1]]


def _counts(trie):
    words = trie.words.to_pylist()
    paths = [(words[w],) for w in trie.levels[0][1]]
    yield dict(zip(paths, trie.levels[0][2].tolist(), strict=True))
    for parent, word, n in trie.levels[1:]:
        paths = [(*paths[p], words[w]) for p, w in zip(parent, word, strict=True)]
        yield dict(zip(paths, n.tolist(), strict=True))


# --- 11 -----------------------------------------------------------------------------------------------------------
URLS = [
    None, "", "no scheme.net/x", "http://net", "http://net/", "HTTP://WWW.Example.NET/en/a?b=c&d=e&&f#g", "https://example.net/en", "https://example.net/en/", "https://notexample.net/en/1", "ftp://a.example.com/de/1#x?y", "https://example.com/de?x",
    "https://x.org/fr/é", "https://x.org?/fr/", "https://xorg/fr/", "a://b://c.net/d", "://net/fr/", "http:///path", "http://u@h.NET:80/p", "http://h.net/" + "9" * 5_000, "http://İ.K.net/\n/x", "http://a-b-c.org/fr/-", "http://x.net\n/y", "http://nEt/%20",
]


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def _rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def pages(spark):
    made = [f"http{'s' * (i % 2)}://{('www', 'm', 'blog')[i % 3]}.site{i % 37}.{('net', 'com', 'org')[i % 3]}/{('en', 'de', 'fr')[i // 3 % 3]}/{i}{('', '?page=2&ref=x', '.html')[i % 3]}" for i in range(600)]
    made += [u.replace("site", "example.") for u in made[:200]] + [f"http://x.example.{t}/{p}/{i}" for i in range(30) for t in ("net", "com") for p in ("en", "de", "fr")]
    data = [(i, u) for i, u in enumerate(URLS + made)] + [(0, URLS[5]), (None, URLS[5]), (None, None)]
    return spark.createDataFrame([(*r, *range(len(CLASHING))) for r in data], "page_id long, url string, " + EXTRA)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_url_filters(pages, monkeypatch, limit):
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(url_filters, "HOT", 0.05)
    model = url_filters.fit(url_filters.labelled_by(pages))
    got, data = url_filters.judge(pages, model).collect(), pages.select("page_id", "url").collect()
    want = [(i, *_split(u), *_rule(*_split(u))) for i, u in data]
    assert sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"]) for r in got))) == sorted(map(str, (w[:4] for w in want)))
    ruled = {(w[1], w[2]): w[4] for w in want if w[4]}
    assert all(r["verdict"] == ruled[r["host"], r["path"]] for r in got if r["rule"])
    assert all(r["verdict"] == ("block" if r["p_block"] >= 0.5 else "allow") for r in got if not r["rule"])
    assert {r["verdict"] for r in got if not r["rule"]} == {"allow", "block"}
    again = url_filters.judge(pages.repartition(3), model).collect()
    assert sorted(map(str, map(tuple, again))) == sorted(map(str, map(tuple, got)))


def test_url_features(spark, pages):
    for r in url_filters.featured(pages.select(F.col("url").alias("__url"))).collect():
        url = r["__url"] or ""
        host, path = _split(r["__url"])
        entropy = lambda s: -sum(k / len(s) * math.log2(k / len(s)) for k in Counter(s).values()) if s else 0.0
        query = re.match(r"[^?#]*\?([^#]*)", url)
        want = (len(url), len(host), len(host.split(".")), len([s for s in path.split("/") if s]), sum(c in "0123456789" for c in url) / max(len(url), 1), len([q for q in query.group(1).split("&") if q]) if query else 0, url.count("-"))
        assert (r["length"], r["host_length"], r["labels"], r["depth"], r["digit_ratio"], r["parameters"], r["hyphens"]) == want, url
        assert r["entropy"] == pytest.approx(entropy(url), abs=1e-9) and r["host_entropy"] == pytest.approx(entropy(host), abs=1e-9)
        assert (r["tld"], r["domain"]) == ("t:" + host.split(".")[-1], "d:" + ".".join(host.split(".")[-2:]))


def test_trees_learn_from_lexical_features(spark):
    """Held-out accuracy on labels that follow from digits and parameters of hosts never seen."""
    def url(i):
        bad = zlib.crc32(str(i).encode()) % 3 == 0
        return f"http://host{i}.example/{'p' + '9' * (i % 7 + 6) + '/x?a=1&b=2&c=3' if bad else 'articles/' + 'name' * (i % 4 + 1)}", int(bad)

    labelled = spark.createDataFrame([url(i) for i in range(900)] + [(None, 1), ("http://x.example/", None)], "url string, label int")
    model = url_filters.fit(labelled, fit_urls=500)
    held = [url(i) for i in range(900, 1300)]
    judged = url_filters.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string"), model, rules=[]).collect()
    assert sum((r["verdict"] == "block") == bool(held[r["page_id"]][1]) for r in judged) / len(held) > 0.95
    assert model.urls == 900


def test_url_models_without_labels(spark, pages):
    none = url_filters.fit(spark.createDataFrame([], "url string, label int"))
    one = url_filters.fit(spark.createDataFrame([("http://a.net/", 1), ("http://b.net/", 1)], "url string, label int"))
    for model, verdict in ((none, "allow"), (one, "block")):
        assert {r["verdict"] for r in url_filters.judge(pages, model).where("rule IS NULL").select("verdict").distinct().collect()} == {verdict}
    assert url_filters.judge(pages.limit(0), none).count() == 0


def test_rules_of_equal_length(spark):
    rules = [("b.c", "/x", "allow"), ("c", "/xyz", "block"), ("c", "/", "allow")]
    rows_ = spark.createDataFrame([(h, p) for h, p in itertools.product(("c", "b.c", "a.b.c", "bc"), ("/", "/x", "/xyz", ""))], "h string, p string")
    got = {(r["h"], r["p"]): (r["rule"], r["verdict"]) for r in rows_.select("h", "p", *[c.alias(n) for c, n in zip(url_filters.ruled(F.col("h"), F.col("p"), rules), ("rule", "verdict"), strict=True)]).collect()}
    assert got["b.c", "/xyz"] == ("b.c/x", "allow") and got["c", "/xyz"] == ("c/xyz", "block") and got["a.b.c", "/x"] == ("b.c/x", "allow")
    assert got["bc", "/"] == (None, None) and got["c", ""] == (None, None) and got["b.c", "/"] == ("c/", "allow")
