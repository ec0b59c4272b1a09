"""The whole pipeline over a small table, stage by stage against plain Python."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import mixing, quality_rules
from tidemark.llm.vocabulary import default_path, tokenizer

EN = "the a of and to in is was for on with as by at from that this river house garden city people water morning evening window winter summer story teacher market bridge letter music kitchen village forest mountain".split()
DE = "der die das und zu in ist war für auf mit als von bei aus dass dieser fluss haus garten stadt leute wasser morgen abend fenster winter sommer geschichte lehrer markt brücke brief musik küche dorf wald berg".split()
MENU = "home about contact products services careers press legal imprint help"


def documents():
    rng = random.Random(21)
    rows = []
    for i in range(160):
        lang, words = (("en", EN), ("de", DE))[i % 2]
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(60, 90)))
        rows.append([i, text, lang if i % 5 else None, ("news", "web", None)[i % 3], 0])
    for i in range(160, 170):  # near copies: two words of 60 or more differ
        words = rows[i - 160][1].split()
        words[10] = words[11] = "changed"
        rows.append([i, " ".join(words), None, "web", 0])
    rows += [[i, rows[7][1], None, f"s{i}", 0] for i in range(170, 176)]  # exact copies in small sources
    rows += [[i, " ".join("".join(rng.choice("qxzvkj") for _ in range(6)) for _ in range(40)), None, "web", 0] for i in range(176, 186)]  # no language
    rows += [[i, "too short to keep", "en", "web", 0] for i in range(186, 190)]
    rows += [[i, "the river and the house by the water in the evening " * 8, "en", "web", 0] for i in range(190, 193)]  # repeats itself
    rows += [[i, "\n".join([MENU] * 3 + [" ".join(rng.choice(EN) for _ in range(3))]), "en", "shop", 0] for i in range(193, 213)]  # mostly boilerplate
    rows += [[213, None, None, "web", 0], [214, "", "en", "web", 0], [0, rows[0][1], None, "news", 0]]
    return [(*r[:4], len(r[1] or "")) for r in rows]


def plain_good(rows):
    hosts, of = {}, {}
    lines = lambda t: [" ".join(x.split()).lower() for x in t.split("\n") if x.split()]
    for _, text, _, source, _ in rows:
        of.setdefault(source, set()).add(text)
        for line in lines(text):
            hosts.setdefault((source, line), set()).add(text)
    out = []
    for r in rows:
        words = r[1].split()
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        twice = Counter(windows)
        repeated = len({j for k, w in enumerate(windows) if twice[w] > 1 for j in range(k, k + 8)})
        gone = sum(len(x.split()) for x in lines(r[1]) if len(hosts[r[3], x]) > max(quality_rules.MAX_DOCUMENTS, quality_rules.MAX_SHARE * len(of[r[3]])))
        if len(words) >= 20 and 100 * repeated <= 30 * len(words) and 1 - gone / len(words) >= quality_rules.MIN_LEFT:
            out.append(r)
    return out


def plain_deduplicated(rows):
    rows = list({(r[0], r[1]): r for r in rows}.values())
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (r[1].lower().split() for r in rows)]
    least = [r[0] for r in rows]
    changed = True
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return [r for r, first in zip(rows, least, strict=True) if r[0] == first]


def plain_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    targets, open_ = {}, set(sources)
    while open_:
        left = mixing.SHARE * sum(sizes.values()) - sum(targets.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > mixing.CAP * sizes[s]}
        targets |= {s: mixing.CAP * sizes[s] for s in over} if over else share
        open_ = open_ - over if over else set()
    number = lambda *parts: int(hashlib.md5("|".join(map(str, (mixing.SEED, *parts))).encode()).hexdigest()[:15], 16)
    out = []
    for s in sources:
        expected = int(targets[s] / sizes[s] * mixing.ONE)
        upto = int(number("offset", "null" if s is None else f"={s}") / (1 << 60) * mixing.ONE)
        size_class = lambda n: n if n < 64 else 1000 + 100 * len(str(n)) + int(str(n)[:2])
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (size_class(len(r[1].split())), number(r[0], hashlib.md5(r[1].encode()).hexdigest()))):
            out += [r] * (((upto + expected) >> 24) - (upto >> 24))
            upto += expected
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_pipeline(spark, folder):
    stages, library = dict(corpus_pipeline.STAGES), tokenizer(default_path("byte_bpe_50k.json"))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    rows = documents()
    recognised = [r for r in rows if r[1] and not 176 <= r[0] < 186]
    assert key(stages["language"](spark, frame(rows), folder).collect()) == key(recognised)
    good = plain_good(recognised)
    assert {r[0] for r in good} == set(range(176))
    assert key(stages["quality"](spark, frame(recognised), folder).collect()) == key(good)
    single = plain_deduplicated(good)
    found = stages["near-dedup"](spark, frame(good), folder).collect()
    assert [r[:2] for r in sorted(map(tuple, found))] == [r[:2] for r in sorted(single)] and len(single) == 160
    mixed = plain_mix(single)
    assert key(stages["mix"](spark, frame(single), folder).collect()) == key(mixed)
    want = sorted((r[0], np.array(library.encode(r[1], add_special_tokens=False).ids, "<u4").tobytes()) for r in mixed)
    ended = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in ended) == want and all(r["intact"] for r in ended)
