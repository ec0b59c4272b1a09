"""Tokenizers of public vocabularies inside tasks, and a word-wise encoder for those that drop white space."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism

from tokenizers import Tokenizer  # noqa: E402

#: Words kept encoded in one Python worker; beyond that the cache starts anew.
CACHED_WORDS = 600_000
#: Longer words are encoded each time.
LONG_WORD = 64


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """The library's tokenizer without truncation and padding."""
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


#: Words of printable ASCII but the apostrophe and < (of special strings) and of Latin-1 letters, and their parts once they are lower-cased.
_PLAIN = re.compile(r"[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_PARTS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall
# The normaliser and the pattern of vocabularies for which that cut is right.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Ids of words: a plain word that is asked for is learnt on the way, others are listed in `waiting` and count as none."""

    def __init__(self, plain):
        self.plain, self.waiting = plain, []

    def __missing__(self, word: bytes) -> bytes:
        coded = self.plain(word)
        if coded is None:
            self.waiting.append(word)
            return b""
        if len(word) <= LONG_WORD:
            self[word] = coded
        return coded


class WordEncoder:
    """Encodes texts word by word for a tokenizer whose tokens never hold white space and ignore it.

    Such a tokenizer splits at white space whatever stands around it, no token or special string holds any, and
    its normaliser (NFC, lower case) doesn't reach across ASCII white space. So a text's ids are those of its
    words (split at space and \\t-\\r), each encoded by the library, one after the other. Plain words of a known
    normaliser and pattern are cut into their parts here and go straight to the library's BPE model.
    """

    def __init__(self, path: str):
        self.library, self.known, self.parts = tokenizer(path), _Known(self.plain), {}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.direct = kinds == _NORMALIZER and splits == [_SPLIT, None] and all("<" in t["content"] for t in spec["added_tokens"])
        self.model = self.library.model
        self.letters = byte_letters()

    def plain(self, word: bytes) -> bytes | None:
        """Ids of a plain word, as little-endian unsigned 32-bit integers; None for any other word."""
        text = word.decode()
        if not self.direct or not _PLAIN(text):
            return None
        text, parts = text.lower(), self.parts
        if text in parts:
            return parts[text]
        if text.isalpha():
            return self.part(text)
        return b"".join([parts[x] if x in parts else self.part(x) for x in _PARTS(text)])

    def part(self, text: str) -> bytes:
        """Ids of a part of a plain word."""
        coded = self.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(self.letters))
        self.parts[text] = out = array("I", [t.id for t in coded]).tobytes()
        return out

    def ids(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids of each text, given as its words, as little-endian unsigned 32-bit integers."""
        known, out, open_ = self.known, [], []
        if len(known) > CACHED_WORDS:
            known.clear()
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()
        for words in texts:
            waiting = len(known.waiting)
            out.append(b"".join(map(known.__getitem__, words)))
            if len(known.waiting) > waiting:
                open_.append(len(out) - 1)
        if open_:
            fresh = list(dict.fromkeys(known.waiting))
            known.waiting.clear()
            coded = self.library.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False)
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(fresh, coded, strict=True))
            for i in open_:
                out[i] = b"".join(map(known.__getitem__, texts[i]))
            for w in fresh:
                if len(w) > LONG_WORD:
                    del known[w]
        return out


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def in_pieces(texts: list[bytes | None], size: int = 1 << 21):
    """Lists of consecutive texts of about `size` bytes together; null counts as empty."""
    part, total = [], 0
    for t in texts:
        part.append(t or b"")
        total += len(part[-1])
        if total >= size:
            yield part
            part, total = [], 0
    if part:
        yield part
