"""The language filters against plain Python sets, at piece edges, with many languages, and by held-out accuracy."""

import os
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import language_id
from tidemark.llm.words import U

SF = "/root/testdata/sf0.01"


def plain_grams(text: str) -> Counter:
    spaced = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in spaced:
        spaced = spaced.replace("  ", " ")
    return Counter(spaced[i : i + n] for n in language_id.GRAMS for i in range(len(spaced) - n + 1)) if spaced.strip() else Counter()


@pytest.mark.parametrize("piece", [1 << 18, 1, 2, 5, 64])
def test_grams_at_any_piece_edge(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", 1 << 18)
    texts = ["", "a", "  ", "ab", "The quick, brown fox!", "1 2 3", "ÀÉÎ ß ΑΣ. İstanbul", "x  y\n\nz" * 20, " lead and trail "]
    want = [Counter(np.concatenate([*language_id.grams(t), np.zeros(0, dtype=U)]).tolist()) for t in texts]
    assert [sorted(w.values()) for w in want] == [sorted(plain_grams(t).values()) for t in texts]
    monkeypatch.setattr(language_id, "PIECE", piece)
    assert [Counter(np.concatenate([*language_id.grams(t), np.zeros(0, dtype=U)]).tolist()) for t in texts] == want


def test_filters_hold_all_their_ngrams_and_few_others():
    rng = np.random.default_rng(4)
    languages = [f"l{i:03}" for i in range(130)]  # more than two mask words of 64 bits
    sets = [set(rng.integers(0, 1 << 62, rng.integers(50, 400)).tolist()) for _ in languages]
    of = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)])
    codes = np.concatenate([np.array(sorted(s), dtype=np.int64).view(U) for s in sets])
    filters = language_id.built(languages, of, codes)

    def held(codes: np.ndarray) -> np.ndarray:
        first, second = language_id._positions(codes, len(filters.masks))
        return np.unpackbits(filters.masks[first] & filters.masks[second], axis=1, bitorder="little")[:, : len(languages)]

    for i, s in enumerate(sets):
        assert held(np.array(sorted(s), dtype=np.int64).view(U))[:, i].all()
    foreign = held(rng.integers(0, 1 << 62, 20_000).view(U)).mean(axis=0)
    assert np.abs(foreign - filters.false_rate).max() < 0.01 and filters.false_rate.max() < 0.07


def test_over_64_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{letters[k % 26]}{letters[k // 26]}q{letters[k % 26]} " * 8, f"l{k:02}") for i, k in enumerate([k for k in range(70) for _ in range(6)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df).collect()}
    assert sum(found[i] == lang for i, _, lang in rows) >= 0.98 * len(rows)
    assert language_id.accepted(df).count() == len(rows)


def test_scores_against_sets(spark):
    """Scores are the parts of the n-grams in each language's set, up to what the filters' false rate lets through."""
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat with a hat", "en"), ("der hund lief in den wald und bellte", "de"), ("le chat dort sur la table", "fr")] * 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    filters = language_id.fit(df)
    counts = {lang: sum((plain_grams(t) for _, t, x in docs if x == lang), Counter()) for lang in ("de", "en", "fr")}
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    sets = {lang: {g for g, x in s.items() if x >= language_id.SPECIFIC * top[g]} for lang, s in share.items()}
    for text in ("the hat on the table", "und der wald", "xyz the", "la table der cat"):
        grams = plain_grams(text)
        want = [sum(n for g, n in grams.items() if g in sets[lang]) / sum(grams.values()) for lang in filters.languages]
        assert language_id.scores(text, filters) == pytest.approx(want, abs=0.1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    assert len(found) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.98
    assert language_id.accepted(docs).count() >= 0.98 * docs.count()
