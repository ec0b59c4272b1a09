"""BPE encoding by prefix-sharing trie traversal, and decoding by table (operator 9)."""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import in_python, kept
from tidemark.llm.vocabulary import byte_letters

#: How byte-level vocabularies cut texts into words; fixed by the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space before a character that isn't white space always begins a word of PATTERN.
_SPACE = re.compile(r" (?=\S)")
#: Bytes that a worker's caches of segments and of words (two generations each) and its table of pairs may take: a half, a third and a sixth.
BUDGET = 64 << 20
#: What an entry takes besides its strings: a slot of the table.
ENTRY_BYTES = 100
#: Longer words and segments aren't cached.
LONG_WORD = 128
#: Words that go through their trie together.
WORDS = 1 << 14
#: Characters worked on at once; a longer text is cut at a space before a word.
PIECE = 1 << 19
_MARKS = (".", ",", ";", ":", "!", "?")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Cache:
    """Ids of words or segments. When the young entries fill half of the limit the old ones are dropped as a whole; used ones stay young."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old, self.size = limit, {}, {}, 0

    def found(self, keys: set[str]) -> tuple[dict[str, bytes | None], list[str]]:
        """All keys with what is known of them, and those that aren't known."""
        found, old, used, fresh = dict(zip(keys, map(self.young.get, keys))), self.old, {}, []
        for key in [k for k, coded in found.items() if coded is None]:
            if (coded := old.get(key)) is None:
                fresh.append(key)
            else:
                found[key] = used[key] = coded
        self.add(used)
        return found, fresh

    def add(self, entries: dict[str, bytes]) -> None:
        if entries and max(map(len, entries)) > LONG_WORD:
            entries = {k: coded for k, coded in entries.items() if len(k) <= LONG_WORD}
        size = sum(map(sys.getsizeof, entries)) + sum(map(sys.getsizeof, entries.values())) + ENTRY_BYTES * len(entries)
        if self.size + size <= self.limit // 2:
            self.young.update(entries)
            self.size += size
            return
        for key, coded in entries.items():
            self.young[key] = coded
            self.size += sys.getsizeof(key) + sys.getsizeof(coded) + ENTRY_BYTES
            if self.size > self.limit // 2:
                self.young, self.old, self.size = {}, self.young, 0

    def held(self) -> int:
        return sum(sys.getsizeof(k) + sys.getsizeof(c) + ENTRY_BYTES for known in (self.young, self.old) for k, c in known.items())


class TrieEncoder:
    """Byte-pair encoding where each prefix of a word knows its last token.

    Pair merges rank every token after its parts, so a boundary of a word's encoding is one of each prefix's that
    reaches it: a prefix's encoding is that of a shorter prefix and one last token, the only one that is a suffix of
    it and doesn't merge with the token before. The distinct words of a piece of texts are sorted, so that words with a
    common prefix are neighbours, and their trie is visited level by level: a node takes its last token from the states
    on the path to it, what words begin with is encoded once, and the nodes of a level are worked on together.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = {letter: byte for byte, letter in byte_letters().items()}
        vocab: dict[str, int] = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            pair = (vocab[left], vocab[right])
            self.merged[pair] = rank
            self.parts[vocab[left + right]] = (*pair, rank)
        self.tokens_by_end()
        self.edges: tuple[dict, dict] = ({}, {})
        self.place_bits = (BUDGET // 6 // 8).bit_length() - 1
        self.apart = np.full(1 << self.place_bits, -1, dtype=np.int64)  # (left << 32 | right) << 1 | whether the two stay apart
        size = max(self.bytes) + 1
        self.lengths = np.array([len(self.bytes.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.words = regex.compile(PATTERN)
        self.coded_words, self.segments = Cache(BUDGET // 3), Cache(BUDGET // 2)  # segments: those after a space

    def tokens_by_end(self) -> None:
        """The automaton that follows a word byte by byte and knows the tokens that end there, the longest first."""
        special = set(self.special.values())
        goes: dict[int, int] = {}  # spot * 256 + byte: the spot below
        ends_here: list[tuple[int, ...]] = [()]
        falls = [0]  # the spot of the longest proper suffix that is one

        def follow(spot: int, byte: int) -> int:
            while (after := goes.get(spot << 8 | byte)) is None:
                if not spot:
                    return 0
                spot = falls[spot]
            return after

        level = [(b, i) for i, b in sorted(self.bytes.items()) if i not in special]
        own: dict[int, tuple[int, int]] = {}
        spots = {b"": 0}
        for depth in range(1, max(len(b) for b, _ in level) + 1):  # shorter suffixes are complete before they are needed
            below: dict[bytes, int] = {}
            for b, i in level:
                if len(b) < depth:
                    continue
                head = b[:depth]
                spot = below.get(head)
                if spot is None:
                    spot = below[head] = len(falls)
                    above = spots[head[:-1]]
                    goes[above << 8 | head[-1]] = spot
                    falls.append(follow(falls[above], head[-1]) if above else 0)
                    ends_here.append(())
                if len(b) == depth:
                    own[spot] = i
            for spot in below.values():
                shorter = ends_here[falls[spot]]
                ends_here[spot] = (own[spot], *shorter) if spot in own else shorter
            spots, level = below, [x for x in level if len(x[0]) > depth]
        steps = sorted(goes)
        self.steps = np.array([*steps, np.iinfo(np.int64).max], dtype=np.int64)
        self.step_ends = np.array([goes[k] for k in steps], dtype=np.int64)
        self.falls = np.array(falls, dtype=np.int64)
        self.ends = np.array([i for here in ends_here for i in here], dtype=np.int64)
        self.ends_at = np.cumsum([0, *map(len, ends_here)])

    def held(self) -> int:
        """Bytes, as estimated, of what grows with the texts."""
        return self.apart.nbytes + self.coded_words.held() + self.segments.held()

    def edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The pieces at the left (0) or right (1) end of a token as it is built: piece, rank made at, rank used at."""
        known = self.edges[side].get(token)
        if known is None:
            chain, used = [], float("inf")
            while token in self.parts:
                made = self.parts[token][2]
                chain.append((token, made, used))
                token, used = self.parts[token][side], made
            known = self.edges[side][chain[0][0] if chain else token] = [*chain, (token, -1, used)]
        return known

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are their own encoding: no pair across the gap ever merges."""
        for x, x_made, x_used in self.edge(left, 1):
            for y, y_made, y_used in self.edge(right, 0):
                rank = self.merged.get((x, y))
                if rank is not None and x_made < rank < x_used and y_made < rank <= y_used:  # of equal pairs the left one merges first
                    return False
        return True

    def are_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """stay_apart() of pairs, by the table of pairs: each has one place there, which the latest takes."""
        key = left.astype(np.int64) << 32 | right
        place = (key.view(np.uint64) * _SPREAD >> np.uint64(64 - self.place_bits)).view(np.int64)
        found = self.apart[place]
        unknown = np.flatnonzero(found >> 1 != key)
        if len(unknown):
            fresh, back = np.unique(key[unknown], return_inverse=True)
            kept = np.array([self.stay_apart(k >> 32, k & 0xFFFFFFFF) for k in fresh.tolist()], dtype=np.int64)
            found[unknown] = self.apart[place[unknown]] = (fresh << 1 | kept)[back]
        return found & 1 == 1

    def below(self, spots: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The automaton's spots after one more byte each."""
        spots, out, open_ = spots.copy(), np.zeros(len(spots), dtype=np.int64), np.arange(len(spots))
        while len(open_):
            key = spots[open_] << 8 | letters[open_]
            at = np.searchsorted(self.steps, key)
            there = self.steps[at] == key
            out[open_[there]] = self.step_ends[at[there]]
            open_ = open_[~there & (spots[open_] > 0)]
            spots[open_] = self.falls[spots[open_]]
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of sorted words, as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(words):
            size = 1 if len(words[at]) > LONG_WORD else WORDS
            part = words[at : at + size]
            if size > 1 and max(map(len, part)) > LONG_WORD:
                part = part[: next(i for i, w in enumerate(part) if len(w) > LONG_WORD)]
            out += self._encode_words(part)
            at += len(part)
        return out

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """One level of the words' trie after the other; a level's nodes are worked on together."""
        n, flat = len(words), np.frombuffer(b"".join(words), dtype=np.uint8)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        starts, most = np.cumsum(lengths) - lengths, int(lengths.max(initial=0))
        # For each depth and word: the last token of that prefix and where it begins. For each word: its node and the automaton's spot.
        last, begins = np.empty((most + 1, n), dtype=np.int32), np.empty((most + 1, n), dtype=np.int32)
        node, spots = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        rows = np.arange(n)
        for depth in range(1, most + 1):
            rows = rows[lengths[rows] >= depth]
            letters = flat[starts[rows] + depth - 1].astype(np.int64)
            branch = node[rows] << 8 | letters
            new = np.append(True, branch[1:] != branch[:-1])  # sorted words that share a prefix are neighbours
            of, first = np.cumsum(new) - 1, rows[new]
            spot = self.below(spots[first], letters[new])
            token, begin = np.empty(len(first), dtype=np.int32), np.empty(len(first), dtype=np.int32)
            open_, at, stop = np.arange(len(first)), self.ends_at[spot], self.ends_at[spot + 1]
            while len(open_):
                if (at[open_] == stop[open_]).any():
                    raise ValueError("the vocabulary lacks a byte")
                tried = self.ends[at[open_]]
                start = depth - self.lengths[tried]
                free = start == 0
                inner = np.flatnonzero(~free)
                free[inner] = self.are_apart(last[start[inner], first[open_[inner]]], tried[inner])
                token[open_[free]], begin[open_[free]] = tried[free], start[free]
                open_ = open_[~free]
                at[open_] += 1
            last[depth, rows], begins[depth, rows], node[rows], spots[rows] = token[of], begin[of], of, spot[of]
        steps, counts, at, rows = [], np.zeros(n, dtype=np.int64), lengths.copy(), np.flatnonzero(lengths)
        while len(rows):
            steps.append((rows, last[at[rows], rows]))
            counts[rows] += 1
            at[rows] = begins[at[rows], rows]
            rows = rows[at[rows] > 0]
        ends = np.cumsum(counts)
        ids = np.empty(int(counts.sum()), dtype="<u4")
        for back, (rows, tokens) in enumerate(steps, 1):
            ids[ends[rows] - back] = tokens
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def cut(self, segment: str) -> list[str]:
        """The words of a segment after a space; most are letters and a mark at most, which PATTERN leaves whole."""
        if segment.isalpha():
            return [" " + segment]
        if segment[-1:] in _MARKS and segment[:-1].isalpha():
            return [" " + segment[:-1], segment[-1]]
        return self.words.findall(" " + segment)

    def learn(self, begun: set[str], spaced: set[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids of segments at a text's start and after a space; the distinct words that no cache knows go through the trie."""
        later, fresh = self.segments.found(spaced)
        first = {s: self.words.findall(s) for s in begun}
        made = {s: self.cut(s) for s in fresh}
        coded, new = self.coded_words.found({*chain.from_iterable(first.values()), *chain.from_iterable(made.values())})
        new.sort()  # as their bytes
        learnt = dict(zip(new, self.encode_words([w.encode() for w in new]), strict=True))
        self.coded_words.add(learnt)
        coded |= learnt
        made = {s: coded[words[0]] if len(words) == 1 else b"".join([coded[w] for w in words]) for s, words in made.items()}
        self.segments.add(made)
        return {s: b"".join([coded[w] for w in words]) for s, words in first.items()}, later | made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if sum(map(len, texts)) <= 2 * PIECE:
            return self._encode([(t, False) for t in texts])
        return [b"".join([self._encode([(part, at > 0)])[0] for at, part in enumerate(_cut(t))]) for t in texts]

    def _encode(self, pieces: list[tuple[str, bool]]) -> list[bytes]:
        """Ids of texts, or of the rest of a text after a space that isn't in it (True)."""
        texts = []
        for text, spaced in pieces:
            runs = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
            runs = [r if i % 2 else _SPACE.split(r) for i, r in enumerate(runs)]
            texts.append((runs, spaced))
        begun = {run[0] for runs, spaced in texts for run in runs[2 if spaced else 0 :: 2]}
        later = {s for runs, spaced in texts for i, run in enumerate(runs[::2]) for s in (run if spaced and not i else run[1:])}
        first, later = self.learn(begun, later)
        out = []
        for runs, spaced in texts:
            coded = []
            for i, run in enumerate(runs):
                if i % 2:
                    coded.append(np.uint32(self.special[run]).tobytes())
                else:
                    coded.append((later if spaced and not i else first)[run[0]])
                    coded += [later[s] for s in run[1:]]
            out.append(b"".join(coded))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their bytes from a table, malformed UTF-8 replaced as the library does."""
        parts = []
        for at in range(0, len(ids), PIECE // 8):
            part = ids[at : at + PIECE // 8]
            lengths = self.lengths[part]
            places = np.repeat(self.begins[part] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            parts.append(self.flat[places].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


def _cut(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters that end before a space that begins a word; the space is in neither."""
    at = 0
    while True:
        gap = _SPACE.search(text, at + PIECE)
        yield text[at : gap.start() if gap else len(text)]
        if not gap:
            return
        at = gap.end()


def _in_turn(path: str, make, names: list[str]):
    """Passes all columns but text through and adds n_tokens and what `make` makes of text, ids and decoded text."""

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("trie", path), lambda: TrieEncoder(path))
        for batch in batches:
            column, at = batch.column("text"), 0
            sizes = pc.coalesce(pc.binary_length(column), 0).to_pylist()
            others = [n for n in batch.schema.names if n != "text"]
            while at < len(sizes):
                end, size = at, 0
                while end < len(sizes) and (end == at or size + sizes[end] <= PIECE):
                    size += sizes[end]
                    end += 1
                texts = [t or "" for t in column.slice(at, end - at).to_pylist()]
                coded = encoder.encode(texts)
                decoded = [encoder.decode(np.frombuffer(c, dtype="<u4")) for c in coded]
                arrays = [batch.column(n).slice(at, end - at) for n in others] + [pa.array([len(c) // 4 for c in coded], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + make(texts, coded, decoded), names=[*others, "n_tokens", *names])
                at = end

    return recode


def _digests(texts: list[str], coded: list[bytes], decoded: list[str]) -> list[pa.Array]:
    return [pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]


def _ids(texts: list[str], coded: list[bytes], decoded: list[str]) -> list[pa.Array]:
    return [pa.array(coded, pa.binary()), pa.array([t == d for t, d in zip(texts, decoded, strict=True)], pa.bool_())]


def _run(docs: DataFrame, path: str, text_col: str, keep: list[str], make, columns: str) -> DataFrame:
    texts = docs.select(*keep, F.col(text_col).alias("text")) if "text" not in keep else docs.select(*keep)
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "text")
    return in_python(texts, _in_turn(path, make, [c.split()[0] for c in columns.split(", ")]), f"{others}, n_tokens long, {columns}")


def encoded(docs: DataFrame, tokenizer_path: str, keep: list[str] = ["doc_id"], text_col: str = "text") -> DataFrame:  # noqa: B006
    """Columns `keep`, n_tokens, ids (little-endian unsigned 32-bit) and intact: the ids decode to the text.

    For byte-level vocabularies. Strings of special tokens inside texts become their ids, as the library's default
    is. Null text: empty, no ids, intact. Null ids and repeated rows are rows like others. Empty table: no rows.
    Other columns are ignored. Each row is worked on where it lies: no shuffle. A worker keeps a bounded trie and
    cache between batches.
    """
    return _run(docs, tokenizer_path, text_col, keep, _ids, "ids binary, intact boolean")


def recode_digests(docs: DataFrame, tokenizer_path: str, keep: list[str] = ["doc_id"], text_col: str = "text") -> DataFrame:  # noqa: B006
    """As encoded(), with SHA-256 digests of the ids and of the decoded text."""
    return _run(docs, tokenizer_path, text_col, keep, _digests, "ids_sha256 string, decoded_sha256 string")
