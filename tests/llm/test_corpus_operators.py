"""Each numbered operator against a brute-force version or the library, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import itertools
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe_trie, language_id, license_scan, mixing, near_dedup, quality_rules, queries, sharding, token_counts, token_files, vector_topk
from tidemark.llm.cluster import new_folder
from tidemark.llm.graph import components
from tidemark.llm.vocabulary import default_path, tokenizer
from tidemark.llm.words import shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, __rank long, shard int"
BASE = "the quick brown fox jumps over the lazy dog and runs far away from the old farm house near a river bank with seven geese"


def rows():
    words = BASE.split()
    near = " ".join(words[:-1] + ["ducks"])
    texts = [
        BASE, BASE.upper(), near, None, "", "   \n\t ", "one two three", "one two three", "ça va où l'été <|endoftext|> it's fine ok don't",
        "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.\nAll rights reserved. CC BY", "a b c d e f g h " * 40, "naïve İstanbul Kelvin ΑΣ é 日本語 🎉🎉",
        "\x1c\x1f odd \x85 marks\r\nend  ", "x" * 300, "12345 67,89 #tag $$$ %%",
    ]
    out = [(i, t, "en" if i % 3 else "fr", f"s{i % 3}" if i % 5 else None, 7, 8) for i, t in enumerate(texts)]
    return [*out, (0, BASE, "en", "s0", 7, 8), (3, None, None, None, 7, 8), (None, "no id here but enough words to count", None, "s1", 7, 8)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_files_round_trip(spark, docs, empty):
    path, library = default_path("word_bpe_49k.json"), tokenizer(default_path("word_bpe_49k.json"))
    at = new_folder(spark, "test-tokens")
    token_files.write_token_files(docs, at, path, 2)
    found = token_files.read_token_files(spark, at).orderBy("start").collect()
    assert len(found) == len(rows())
    assert [r["doc_id"] for r in found] == sorted([r[0] for r in rows()], key=lambda i: (i is not None, i))
    want, start = {}, 0
    for i, t, *_ in rows():
        want.setdefault(i, []).append(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    for r in found:
        want[r["doc_id"]].remove(bytes(r["ids"]))
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) // 4
        start += r["n_tokens"]
    digest = token_files.digests(token_files.read_token_files(spark, at)).where("doc_id = 14").first()
    assert digest["ids_crc32"] == zlib.crc32(np.array(library.encode("x" * 300, add_special_tokens=False).ids + [2], "<u4").tobytes())
    at = new_folder(spark, "test-tokens")
    token_files.write_token_files(empty, at, path, 2)
    assert token_files.read_token_files(spark, at).count() == 0


def test_pack_widths():
    ranks = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 3], dtype=np.uint32)
    assert (token_files.unpack(*token_files.pack(ranks), len(ranks)) == ranks).all()
    assert len(token_files.unpack(*token_files.pack(ranks[:0]), 0)) == 0


def test_token_counts(spark, docs, empty, monkeypatch):
    library = tokenizer(default_path("word_bpe_49k.json"))
    found = {(r["doc_id"], r["n_bytes"]): r for r in token_counts.count_tokens(docs, default_path("word_bpe_49k.json"), limit=10).collect()}
    for i, t, *_ in rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        r = found[i, len((t or "").encode())]
        assert r["n_tokens"] == n and r["over_limit"] == (n > 10)
    assert token_counts.count_tokens(empty, default_path("word_bpe_49k.json")).count() == 0
    monkeypatch.setattr(token_counts, "HUGE", 2_000)
    long = ["word " * 2_000, "x" * 9_000, "日本語テキスト" * 2_500, "héllo <|endoftext|> 'tis " * 900]
    monkeypatch.setattr(token_counts, "CHUNK", 1_024)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), default_path("word_bpe_49k.json")).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(long)}


def test_trie_bpe(docs, empty):
    path = default_path("byte_bpe_50k.json")
    library = tokenizer(path)
    found = bpe_trie.recode_digests(docs, path).collect()
    want = []
    for i, t, *_ in rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert bpe_trie.recode_digests(empty, path).count() == 0


def test_trie_words_of_all_characters():
    path = default_path("byte_bpe_50k.json")
    encoder, library = bpe_trie.TrieEncoder(path), tokenizer(path)
    text = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    samples = ["".join(text[i : i + 64]) for i in range(0, len(text), 64)] + [f"a{c}b {c} {c}{c}1" for c in text[::7]]
    bad = [s for s, c in zip(samples, encoder.encode(samples)) if library.encode(s, add_special_tokens=False).ids != np.frombuffer(c, "<u4").tolist()]
    assert not bad


def test_shards(spark, docs, empty):
    found = sharding.interleave(docs, n_shards=4).collect()
    sizes = [sum(r["shard"] == s for r in found) for s in range(4)]
    assert len(found) == len(rows()) and max(sizes) - min(sizes) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in found} == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows()}
    assert sharding.interleave(empty).count() == 0
    many = spark.createDataFrame([(i, str(i), "hot" if i % 3 else f"s{i % 4}") for i in range(1200)], "doc_id long, text string, source string")
    by = sharding.interleave(many, n_shards=8).join(many, "doc_id").groupBy("shard", "source").count().collect()
    for source in {r["source"] for r in by}:
        of = [r["count"] for r in by if r["source"] == source]
        assert max(of) - min(of) <= 2  # each shard has the mixture


def test_mix(spark, docs, empty):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows()) and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    assert mixing.mix(empty).count() == 0
    many = [(i, "w " * (1 + i * 7919 % 400), f"s{i % 3}" if i % 7 else None) for i in range(2_000)]
    df = spark.createDataFrame(many, "doc_id long, text string, source string")
    result = mixing.mix(df, keep=["doc_id", "source"]).collect()
    sizes = {s: sum(1 + i * 7919 % 400 for i, _, x in many if x == s) for s in ("s0", "s1", "s2", None)}
    weights, total = {"s0": 3, "s1": 1, "s2": 2, None: 3}, sum(sizes.values())
    targets, open_ = {}, set(sizes)
    while open_:  # share by weight, stop the sources above their cap, and share again
        left = 1.5 * total - sum(targets.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        targets |= {s: 2.0 * sizes[s] for s in over} if over else share
        open_ = open_ - over if over else set()
    for s in sizes:
        mine = [r for r in result if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(targets[s]) and sum(r["taken"] for r in mine) == pytest.approx(targets[s], rel=0.02)
    again = mixing.mix(df.repartition(7), keep=["doc_id", "source"]).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in result}
    assert mixing.mixed_rows(df).count() == sum(r["copies"] for r in result)


def test_near_duplicates(spark, docs, empty):
    words = BASE.split() * 4
    texts = {100: " ".join(words)}
    for k in range(1, 40):  # near copies of one text, and copies changed too much
        changed = list(words)
        for j in range(k // 4 if k < 30 else 12):
            changed[(j * 11 + k) % len(words)] = f"edit{k}x{j}"
        texts[100 + k] = " ".join(changed)
    df = docs.unionByName(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), allowMissingColumns=True)
    every = [(i, t) for i, t, *_ in rows()] + list(texts.items())
    sets = [frozenset(s.tolist()) for s in shingle_sets([(t or "").encode() for _, t in every])]
    component = list(range(len(every)))
    for a, b in itertools.combinations(range(len(every)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and component[a] != component[b]:
            old, new = component[b], component[a]
            component = [new if c == old else c for c in component]
    want = []
    for a, (i, _) in enumerate(every):
        ids = [every[b][0] for b in range(len(every)) if component[b] == component[a] and every[b][0] is not None]
        first = min(ids) if ids and sets[a] else i
        want.append((i, len(sets[a]), first, i == first))
    found = near_dedup.near_duplicates(df).drop("uid").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == len({(i, every[a][1]) for a, (i, _) in enumerate(every) if want[a][3]})


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Many different texts that share buckets, in hot buckets and blocks, against all pairs."""
    monkeypatch.setattr(near_dedup, "HOT", 16)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(90)]
    texts = []
    for k in range(120):  # most are linked with few others, if any, though nearly all share buckets
        words = list(base)
        for j in rng.choice(90, rng.integers(1, 9), replace=False):
            words[j] = f"e{rng.integers(0, 60)}"
        texts.append(" ".join(words))
    sets = [frozenset(s.tolist()) for s in shingle_sets(t.encode() for t in texts)]
    component = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and component[a] != component[b]:
            old, new = component[b], component[a]
            component = [new if c == old else c for c in component]
    want = {a: min(b for b in range(len(texts)) if component[b] == component[a]) for a in range(len(texts))}
    assert len(set(want.values())) > 8 and len(set(want.values())) < 110
    found = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want


def test_members_that_can_link_with_nobody_are_not_paired(spark, monkeypatch):
    """In a crowded bucket, texts whose own shingles are too many for any link stay out of the join of pairs."""
    tables, saved = {}, near_dedup.saved
    monkeypatch.setattr(near_dedup, "saved", lambda df, name, *rest: tables.setdefault(name, saved(df, name, *rest)))
    rng = np.random.default_rng(10)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for k in range(120):  # the first 40 are near copies, the others changed in 14 places
        words = list(base)
        for j in rng.choice(40, 1 if k < 40 else 14, replace=False):
            words[5 * j] = f"new{k}x{j}"
        texts.append(" ".join(words))
    found = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {k: 0 if k < 40 else k for k in range(120)}
    crowded = {r["cid"] for r in tables["dedup-mixed"].where("crowded").select("cid").collect()}
    assert len(crowded) > 60
    assert {r["cid"] for r in tables["dedup-open"].collect()} <= set(range(40))


def test_pairs_of_crowded_buckets_are_made_once(spark):
    """Signatures that share none, one or all buckets of a chunk, of several chunks at once: each pair that meets is made in one bucket."""
    rng = np.random.default_rng(12)
    base, table = rng.integers(0, 1 << 16, (near_dedup.CHUNKS, near_dedup.SLOTS)), []
    for cid in range(60):
        values = base.copy()
        for at in rng.choice(base.size, rng.integers(0, 40), replace=False):
            values.flat[at] = rng.integers(0, 1 << 16)
        table.append((cid, *[int(np.uint64(sum(int(v) << 16 * k for k, v in enumerate(row))).astype(np.int64)) for row in values]))
    columns = near_dedup._CHUNK_COLUMNS
    side = spark.createDataFrame(table, "cid long, " + ", ".join(f"{c} long" for c in columns))
    keys = side.mapInArrow(near_dedup._chunk_keys, "key long, cid long, way byte")
    met = keys.join(side.select("cid", F.array(*columns).alias("sign")), "cid")
    pairs = met.alias("x").join(met.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.cid") < F.col("y.cid")))
    every = pairs.select(F.col("x.cid"), F.col("y.cid")).toDF("a", "b")
    once = pairs.where(near_dedup._first_shared("x", "y")).select(F.col("x.cid"), F.col("y.cid")).toDF("a", "b")
    made = sorted(map(tuple, once.collect()))
    assert made == sorted(map(tuple, every.distinct().collect())) and len(made) * 5 < every.count()


def test_signatures_of_pairs_at_the_limit():
    """Of pairs with a similarity of just 0.75 hardly one is beyond the distance (4.9e-5 by the formula)."""
    rng = np.random.default_rng(9)
    far, distances = 0, []
    for _ in range(4_000):
        x = rng.integers(0, 1 << 63, 160, dtype=np.uint64)  # 120 of 160 in common
        a, b = (near_dedup.signature(np.sort(s)).view(np.uint16) for s in (x[:140], x[20:]))
        distances.append(int((a != b).sum()))
        far += distances[-1] > near_dedup.DISTANCE
    assert abs(np.mean(distances) - 14) < 0.3 and far <= 3


def test_bit_maps_bound_what_sets_share():
    rng = np.random.default_rng(10)
    for n in (1, 50, 400, 5_000):
        x = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
        a, b = x[:n], x[n // 4 :]
        p, q = (near_dedup.shingle_map(s).view(np.uint64) for s in (a, b))
        common = len(np.intersect1d(a, b))
        assert common <= min(n - sum(int(w).bit_count() for w in p & ~q), n - sum(int(w).bit_count() for w in q & ~p))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100)]
    found = dict(map(tuple, components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_languages(spark, docs, empty):
    en = [(i, " ".join(BASE.split()[i % 9 :]), "en") for i in range(80)]
    fr = [(i + 100, " ".join("le petit chat noir dort sous la table pendant que les enfants jouent dehors avec leurs amis".split()[i % 7 :]), "fr") for i in range(80)]
    df = spark.createDataFrame(en + fr + [(300, None, "en"), (301, "123 !!", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in en + fr)
    assert (found[300]["lang_pred"], found[300]["score"]) == ("und", 0.0) and found[301]["lang_pred"] == "und"
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert language_id.identify(docs).count() == len(rows()) and language_id.identify(empty).count() == 0
    assert language_id.accepted(df).count() == 160


def test_quality(spark, docs, empty):
    found = {r["doc_id"]: r for r in quality_rules.rate(docs).collect()}
    assert found[11]["n_repeat_words"] == 320 and found[11]["base_failed"] and found[0]["kept"]
    assert found[15]["n_symbols"] == 6 and found[3]["n_words"] == 0 and not found[3]["kept"]
    assert quality_rules.rate(empty).count() == 0
    menu = "home about contact products services careers press legal imprint help"
    same = [(i, f"{menu}\n{menu} more menu words that every page has here today\nunique{i} line", "h") for i in range(30)]
    other = [(i, "\n".join([" ".join(f"w{i}x{j}" for j in range(40)), menu]), "h") for i in range(100, 160)]
    copies = [(i, BASE + "\n" + BASE[::-1], "k") for i in range(200, 260)]
    rated = {r["doc_id"]: r["kept"] for r in quality_rules.rate(spark.createDataFrame(same + other + copies, "doc_id long, text string, source string")).collect()}
    assert not any(rated[i] for i in range(30)) and all(rated[i] for i in range(100, 160)) and all(rated[i] for i in range(200, 260))


def test_repeated_windows_by_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3, rng.integers(0, 60)))) for i in range(60)]
    found = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.rate(spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id long, text string, source string")).collect()}
    for i, t in texts:
        w = t.split()
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        assert found[i] == len({j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(k, k + 8)})


def test_licences(docs, empty):
    found = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert (found[9]["base_labels"], found[9]["labels"], found[9]["n_base"], found[9]["first_word"]) == ("gpl", "gpl,gpl-3", 1, 7)
    assert (found[10]["base_labels"], found[10]["labels"], found[10]["first_word"], found[10]["last_word"]) == ("cc-by,reserved", "cc-by,mit,reserved", 5, 8)
    assert found[0]["labels"] == "" and found[0]["first_word"] is None and found[0]["score"] == 0 and found[3]["n_words"] == 0
    assert license_scan.scan(docs).count() == len(rows()) and license_scan.scan(empty).count() == 0


def test_licences_of_many_notices_by_brute_force(spark):
    notices, full = ([text for _, text, _ in part] for part in ([(a, " ".join(b.split()), c) for a, b, c in x] for x in (license_scan.NOTICES, license_scan.TEXTS)))
    files = [" foo ".join(notices), " foo ".join(notices[::-1]), *(" bar ".join(x) for x in itertools.combinations(notices, 3))]
    files += [" ".join(full), " x ".join(full[::-1] + notices), *full, *(t.replace(" the ", " a ") for t in full), *(t.replace("damages", "harm") for t in full), *(t[: len(t) // 2] for t in full)]
    common = [f"{n} baz" for n in notices[:2] + notices[9:10] for _ in range(40)]
    texts = files + common + [n.replace("license", "licence") for n in notices]
    found = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        words, labels, score = text.split(), set(), 0.0
        for label, template, keys in license_scan.TEMPLATES:
            want = template.split()
            indexed, needed = [k for k, w in enumerate(want) if w not in license_scan.FILLERS], license_scan._key_places(template, keys)
            for shift in range(-len(want), len(words)):
                here = {k for k in indexed if 0 <= shift + k < len(words) and words[shift + k] == want[k]}
                if here.issuperset(needed):
                    labels.add(label)
                    score = max(score, len(here) / len(indexed))
        assert set(filter(None, found[i]["labels"].split(","))) - set(license_scan.PHRASES.values()) == labels and found[i]["score"] == score, text
    assert set(found[0]["labels"].split(",")) == {label for label, _, _ in license_scan.NOTICES} | {"cc-by", "gpl"}


def test_licence_sql_agrees_on_joined_templates(spark):
    """The query's SQL on files of many notices, 200 of them random joins of templates, cut, repeated and changed."""
    rng = np.random.default_rng(13)
    templates = [t for _, t, _ in license_scan.TEMPLATES]
    texts = [" foo ".join(templates), " ".join(templates[::-1])]
    for _ in range(200):
        picked = [templates[i] for i in rng.integers(0, len(templates), rng.integers(1, 7))]
        text = f" {rng.choice(['bar', 'the license', 'software', ''])} ".join(picked).split()
        for _ in range(rng.integers(0, 3)):
            text[rng.integers(0, len(text))] = "changed"
        texts.append(" ".join(text[rng.integers(0, 5) : len(text) - rng.integers(0, 20)]))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    want = con.execute(f"SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score FROM ({queries.SQL['op3_license_scan']})").fetchall()
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len({r["labels"] for r in got}) > 100


def test_boilerplate_of_large_hosts_by_its_ceiling(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "CEILING", 15)
    menu = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty menu"
    docs = [(i, f"{menu}\n{i}", "h") for i in range(20)] + [(i, " ".join(f"w{i}x{j}" for j in range(25)), "h") for i in range(20, 2_000)]
    docs += [(i, f"{menu}\n{i}", "k") for i in range(3_000, 3_012)] + [(i, " ".join(f"w{i}x{j}" for j in range(25)), "k") for i in range(3_012, 5_000)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.rate(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert not any(kept[i] for i in range(20)) and all(kept[i] for i in range(20, 2_000)) and all(kept[i] for i in range(3_000, 5_000))


def test_top_products(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=8).round(2).tolist()) for i in range(700)]
    vectors += [(700, vectors[0][1]), (701, vectors[0][1]), (750, vectors[3][1]), (100, vectors[7][1]), (100, vectors[100][1]), (101, vectors[100][1]), (102, []), (850, [])]
    out = [(800, None), (850, [float("nan")] * 8), (900, [1.0, None] * 4), (950, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in vectors + out], "vec_id long, embedding array<double>, score double, cell string")
    good = [(i, np.floor(256 * np.array(v + [0.0] * (8 - len(v)))).astype(np.int64)) for i, v in vectors]
    want = []
    for a, (q, x) in enumerate(good):
        if q % 50 == 0:
            best = sorted((-int(x @ v), i) for b, (i, v) in enumerate(good) if a != b)[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in vector_topk.top_products(df).collect()) == sorted(want)
    few = vector_topk.top_products(df.where("vec_id IN (0, 1, 2)")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]
    assert vector_topk.top_products(df.limit(0)).count() == 0


def test_pivots_leave_out_far_clusters(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    points = centres[rng.integers(0, 30, 3_000)] + 0.02 * rng.normal(size=(3_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    ints = np.floor(256 * points).astype(np.int64)
    scores = ints[::50] @ ints.T
    want = [(q * 50, rank, i, int(scores[q, i])) for q in range(60) for rank, i in enumerate(sorted((i for i in range(3_000) if i != q * 50), key=lambda i: (-scores[q, i], i))[:5], 1)]
    assert sorted(tuple(r) for r in vector_topk.top_products(df).collect()) == sorted(want)
    assert vector_topk.visited_share(df) < 0.2  # random directions, as in the test tables, leave nearly all of it


def test_requests_of_vectors_grow_with_the_queries(spark, monkeypatch):
    monkeypatch.setattr(vector_topk, "BLOCK", 8)  # 60 queries and over 400 blocks
    monkeypatch.setattr(vector_topk, "TOGETHER", 16)
    monkeypatch.setattr(vector_topk, "SHELVES", 4, raising=False)
    rng = np.random.default_rng(8)
    points = rng.normal(size=(3_000, 32)) * 2.0 ** rng.integers(0, 18, 3_000)[:, None]  # products within and beyond what floats hold exactly
    points[2_000:2_040] = points[50]
    ints = np.floor(256 * points).astype(np.int64)
    scores = ints[::50] @ ints.T
    want = [(q * 50, rank, i, int(scores[q, i])) for q in range(60) for rank, i in enumerate(sorted((i for i in range(3_000) if i != q * 50), key=lambda i: (-scores[q, i], i))[:5], 1)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # more than the queries take, less than the blocks
    try:
        index = vector_topk.Index(df, 50, "vec_id", "embedding")
        found = index.search(index.bounded(5), 5)
        assert 60 * 5 <= len(found.collect()) <= 60 * 5 * 4
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        for i, line in enumerate(plan):
            if "BroadcastExchange" in line:  # of no requests, whose size Spark can't tell
                below = itertools.takewhile(lambda x, depth=line.index("BroadcastExchange"): len(x) - len(x.lstrip(" :+-*()0123456789")) > depth, plan[i + 1 :])
                assert not any("InPandas" in x for x in below)
        assert sorted(tuple(r) for r in vector_topk.top_products(df).collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_trie_bpe_within_its_budget(monkeypatch):
    path = default_path("byte_bpe_50k.json")
    library = tokenizer(path)
    rng = np.random.default_rng(11)
    syllables = ["en", "ach", "ü", "ung", "keit", "tz", "pf", "9", "é", "ß.", "日本", "\n", "'s", "<|endoftext|>"]
    texts = [" ".join("".join(rng.choice(syllables, rng.integers(1, 6))) for _ in range(400)) for _ in range(60)]
    texts += ["x" * 5_000, "word  " * 3_000, " " * 3_000 + "end", "", "日" * 2_000 + " " + "a" * 300]
    monkeypatch.setattr(bpe_trie, "BUDGET", 120_000)
    monkeypatch.setattr(bpe_trie, "PIECE", 1_500)  # so that long texts are cut
    encoder = bpe_trie.TrieEncoder(path)
    for text in texts:
        (coded,) = encoder.encode([text])
        assert np.frombuffer(coded, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert encoder.decode(np.frombuffer(coded, "<u4")) == text
        assert encoder.held() <= 120_000 + 6_000


def test_trie_levels_are_worked_on_together(monkeypatch):
    """Thousands of words take a few calls for each level of their trie, also in several parts, with long words between them and a table of few pairs."""
    path = default_path("byte_bpe_50k.json")
    encoder, library, calls = bpe_trie.TrieEncoder(path), tokenizer(path), []
    rng = np.random.default_rng(13)
    words = sorted({"".join(rng.choice(["en", "ach", "ü", "ung", "th", "日", "é", "x"], rng.integers(1, 8))) for _ in range(6_000)})
    below = encoder.below
    monkeypatch.setattr(encoder, "below", lambda *x: calls.append(0) or below(*x))
    first = encoder.encode_words([w.encode() for w in words])
    assert len(calls) <= max(len(w.encode()) for w in words)
    want = [library.model.tokenize("".join(bpe_trie.byte_letters()[b] for b in w.encode())) for w in words]
    assert [np.frombuffer(c, "<u4").tolist() for c in first] == [[t.id for t in x] for x in want]
    monkeypatch.setattr(bpe_trie, "WORDS", 500)
    encoder.place_bits, encoder.apart = 4, np.full(16, -1, dtype=np.int64)
    mixed = sorted([w.encode() for w in words[:1_200]] + [b"en" * 200, b"ach" * 90, b"x" * 129])
    got = encoder.encode_words(mixed)
    assert [np.frombuffer(c, "<u4").tolist() for c in got] == [[t.id for t in library.model.tokenize("".join(bpe_trie.byte_letters()[b] for b in w))] for w in mixed]
    assert encoder.encode_words([]) == []


def test_word_encoder_learns_on_the_way(monkeypatch):
    """Plain, other and long words, repeated within and across calls and with a cache of few words, as the library encodes them; each word is looked up once."""
    from tidemark.llm import vocabulary

    encoder = vocabulary.WordEncoder(default_path("word_bpe_49k.json"))
    monkeypatch.setattr(vocabulary, "CACHED_WORDS", 8)
    texts = ["", "Plain words, plain WORDS; it's", "naïve Straße 12345 <s> don't", "Ω ωμέγα 漢字 漢字 plain", "x" * 70 + " " + "ж" * 70 + " it's Ω", "Ω " * 3 + "new" + "y" * 70]
    for _ in range(2):
        coded = encoder.ids([t.encode().split() for t in texts])
        assert [np.frombuffer(c, dtype="<u4").tolist() for c in coded] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert not encoder.known.waiting and max(map(len, encoder.known)) <= vocabulary.LONG_WORD
