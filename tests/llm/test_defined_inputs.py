"""Every numbered operator and pipeline stage on nulls, empties, a very long text, ties, repeats, an empty table and clashing names."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import bpe_trie, language_id, license_scan, mixing, near_dedup, quality_rules, sharding, token_counts, token_files, vector_topk
from tidemark.llm.cluster import new_folder
from tidemark.llm.vocabulary import default_path, tokenizer
from tidemark.llm.words import PIECE, shingle_sets

CLASHING = ["score", "lang_pred", "held_out", "size", "uid", "n", "row", "own", "id", "hash", "host", "key", "cid", "copies", "taken", "target", "label", "n_words", "kept", "shard", "gram", "__row", "__i", "__t", "__o", "__own", "__uid", "__copy", "__key", "__class", "__g", "__text", "__id", "__hash", "a b.c"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` long" for c in CLASHING)
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from the old farm house near a river bank with seven geese"
LONG = " ".join(f"w{i * 7919 % 99991}" for i in range(620_000))  # over two pieces of words.PIECE


def rows():
    texts = [PROSE, PROSE, None, "", " \n\t", PROSE + " today", "one two", "!!! 123", LONG, "le petit chat noir dort sous la table pendant que les enfants jouent dehors avec leurs amis et leurs parents"]
    out = [(i, t, ("en", "fr")[i == 9] if t else None, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    out += [out[0], (0, "another text under an id that is taken, long enough to be kept by every rule that asks for twenty words of it at least", "en", "s1"), (None, PROSE[::-1], None, None), (None, None, None, None)]
    return [(*r, *range(1, len(CLASHING) + 1)) for r in out]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def test_pieces_of_words_keep_their_hashes():
    assert len(LONG) > 2 * PIECE
    words = LONG.split()
    (whole,) = shingle_sets([LONG.encode()])
    assert len(whole) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    (short,) = shingle_sets([" ".join(words[200_000:200_300]).encode()])
    assert np.isin(short, whole).all()
    unbroken = b"x" * (5 * PIECE // 2)
    assert len(next(shingle_sets([unbroken]))) == 1
    assert len(next(shingle_sets([unbroken + b" a b c d " + unbroken]))) == 2


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    found = stage(spark, docs, "")
    if name != "bpe":
        assert found.columns == docs.columns
    got = found.collect()
    assert stage(spark, docs.limit(0), "").count() == 0
    if name == "bpe":
        library = tokenizer(default_path("byte_bpe_50k.json"))
        want = {r[1]: library.encode(r[1] or "", add_special_tokens=False).ids for r in rows()}
        assert sorted(r["n_tokens"] for r in got) == sorted(len(want[r[1]]) for r in rows()) and all(r["intact"] for r in got)
        return
    plain = [tuple(r) for r in got]
    assert set(plain) <= set(rows())  # all columns pass unchanged
    ids = sorted(str(r[0]) for r in plain)
    if name == "quality":
        assert ids == sorted(map(str, [0, 0, 0, 1, 5, 9, None]))  # of 20 words or more; the long one's words come round again after 99,991
    if name == "near-dedup":
        assert ids == sorted(map(str, [0, 0, 2, 3, 4, 6, 7, 8, 9, None, None]))
    if name == "language":
        assert not {2, 3, 4, 7} & {r[0] for r in plain} and {0, 1, 5} <= {r[0] for r in plain}
    if name == "mix":
        assert all(plain.count(r) <= 2 * rows().count(r) for r in set(plain))


def test_operators(spark, docs):
    n, path = len(rows()), default_path("word_bpe_49k.json")
    library, by_text = tokenizer(path), {}
    for r in rows():
        by_text.setdefault(r[1], len(library.encode(r[1] or "", add_special_tokens=False).ids))
    at = new_folder(spark, "test-tokens")
    token_files.write_token_files(docs, at, path, 2)
    digests = token_files.digests(token_files.read_token_files(spark, at)).orderBy("start").collect()
    assert [r["n_tokens"] for r in digests if r["doc_id"] == 8] == [by_text[LONG] + 1] and len(digests) == n
    counted = token_counts.count_tokens(docs, path).collect()
    assert sorted(r["n_tokens"] for r in counted) == sorted(by_text[r[1]] for r in rows())
    found = {
        "language": language_id.identify(docs), "licence": license_scan.scan(docs), "quality": quality_rules.rate(docs), "shards": sharding.interleave(docs),
        "mix": mixing.mix(docs), "dedup": near_dedup.near_duplicates(docs), "bpe": bpe_trie.recode_digests(docs, default_path("byte_bpe_50k.json")),
    }
    for name, df in found.items():
        assert len(df.collect()) == n, name
    long = found["quality"].where("doc_id = 8").first()
    assert long["n_words"] == 620_000 and long["word_chars"] == len(LONG.replace(" ", ""))
    shards = found["shards"].where("doc_id = 8").first()
    assert shards["size"] == len(LONG) + 8 and shards["text_crc32"] == zlib.crc32(LONG.encode())
    byte = tokenizer(default_path("byte_bpe_50k.json")).encode(LONG, add_special_tokens=False).ids
    assert found["bpe"].where("doc_id = 8").first()["ids_sha256"] == hashlib.sha256(np.array(byte, "<u4").tobytes()).hexdigest()


def test_vectors(spark):
    extra = {"cell": 1, "salt": 2, "uid": 3, "near": 4, "query": 5, "rank": 6, "score": 7, "ints": 8}
    data = [(i, [float((i or 0) % 3), 1.0], *extra.values()) for i in [0, 50, 50, 51, None]] + [(52, None, *extra.values())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, " + ", ".join(f"{c} long" for c in extra))
    assert sorted(r["query_id"] for r in vector_topk.top_products(df).collect()) == [0] * 3 + [50] * 6
    assert vector_topk.top_products(df.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
