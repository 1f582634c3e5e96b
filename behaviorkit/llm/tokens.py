"""Whole-text encoding with a public tokenizer file, word by word through a bounded cache.

Byte-pair encoders never merge across the boundaries at which they first split a text.  A text is
therefore cut at such boundaries, and the ids of a distinct word are asked from the ``tokenizers``
library once; they are those of encoding the text in one call (tests compare both).
"""

from __future__ import annotations

import re
import sys

_ADJACENT = re.compile(r"\s\s")
# Marks after or before these letters and digits are pieces of their own for every pattern in use.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_MARK, _END = r"[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]", "[0-9A-Za-zÀ-ÖØ-öø-ÿ]"
_TAIL = re.compile(rf"{_MARK}(?<={_END}{_MARK}){_MARK}*(?=[ \n]|$)")     # marks come first, so the search skips to them
_ENDS = frozenset(c for c in map(chr, range(0x30, 0x100)) if c.isalnum() and (c.isascii() or c.isalpha()) and c not in "ªº")
# Letters, then marks: two pieces for every pattern in use (an apostrophe could start a contraction).
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)?([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+)?")


def _adjacent(text: str) -> bool:
    """Whether white space touches white space."""
    flat = text.replace("\n", " ")
    return "  " in flat if flat.isprintable() else bool(_ADJACENT.search(text))     # printable: no other white space


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write a byte: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Encoder:
    """``encode(text)`` -> little-endian unsigned 32-bit ids as bytes; a null text has none.

    ``words="leading_space"`` (byte-level BPE): a word carries the one space before it and a lone
    line feed stands alone.  Texts where white space touches white space, or that hold a zero
    character, are encoded in one call, as such runs are split by their context.
    ``words="white_space"``: the tokenizer lower-cases and drops white space; words stand alone.
    Plain words go straight to the byte-pair model, any other through the whole tokenizer.
    A special token written out in a text has the library's id, and the text is cut there, as the library does.
    Marks at the ends of a word are looked up apart from it, so "word", "word," and "(word)" share an entry.
    Two generations of at most ``cached`` words are kept, so that frequent words stay.
    """

    def __init__(self, path: str, words: str = "leading_space", cached: int = 200_000, longest: int = 64):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder()
        self._special = {t.content: i.to_bytes(4, "little") for i, t in added.items()}
        # tokens that take white space with them or need a word border: such texts are encoded in one call
        self._simple = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if added else None
        self.size = self._tokenizer.get_vocab_size()
        self._model = self._tokenizer.model
        self._lower, self._cached, self._longest = words == "white_space", cached, longest
        self._letters = _byte_letters()
        self._space = self._letters[32]
        self._written = [i.to_bytes(4, "little") for i in range(self.size)]
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if len(word) > self._longest:
            return self._whole(word)
        body = word[1:] if word[:1] == " " else word
        if not word:
            return b""
        if plain := _PLAIN.fullmatch(word):
            letters, marks = plain.groups()
            if letters and marks:
                return self._fetch(letters) + self._fetch(marks)
            raw = (word.lower() if self._lower else word).encode("utf-8").decode("latin-1").translate(self._letters)
        else:
            return self._whole(word)
        written = self._written
        return b"".join([written[token.id] for token in self._model.tokenize(raw)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self._special):
            if not self._simple:
                return self._whole(text)
            return b"".join([self._special.get(part) or self._encode(part) for part in self._cut.split(text) if part])
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        if "\0" in text or not self._lower and _adjacent(text):
            return self._whole(text)
        text = _TAIL.sub("\0\\g<0>", text)
        if self._lower:         # only A-Z: what becomes of other letters may depend on their neighbours
            text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            words = text.replace("\n", "\0").replace(" ", "\0").split("\0")
        else:
            words = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        out = list(map(self._new.get, words))
        at = -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            out[at] = self._fetch(words[at])
        return b"".join(out)

    def _part(self, word: str) -> bytes:
        ids = self._new.get(word)
        return self._fetch(word) if ids is None else ids

    def _fetch(self, word: str) -> bytes:
        ids = self._old.get(word)
        if ids is None:
            body = word[1:] if word[:1] == " " else word
            if body.isalpha() and body.isascii() and len(word) <= self._longest:     # written as itself
                raw, written = word.lower() if self._lower else word.replace(" ", self._space), self._written
                ids = b"".join([written[token.id] for token in self._model.tokenize(raw)])
            else:
                core = word.rstrip(_MARKS)
                at = len(core)
                if at == len(word):
                    core = word.lstrip(" ").lstrip(_MARKS)
                    at = len(word) - len(core)
                    if at and core and core[0] in _ENDS and word[at - 1] != " ":
                        return self._part(word[:at]) + self._part(core)
                elif core and core[-1] in _ENDS:
                    return self._part(core) + self._part(word[at:])
                ids = self._word(word)
                if len(word) > self._longest:
                    return ids
        if len(self._new) >= self._cached:
            self._old, self._new = self._new, {}
        self._new[word] = ids
        return ids


def encoder(path: str, words: str) -> Encoder:
    """The worker process's encoder: loaded once and kept, with its cache, for all tasks.

    Functions of this package travel by value, so module globals would start anew in every task.
    """
    kept = sys.__dict__.setdefault("_behaviorkit_encoders", {})
    if (path, words) not in kept:
        kept[path, words] = Encoder(path, words)
    return kept[path, words]


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer file; a parameter of the operators that encode."""
    import public_tokenizers

    return public_tokenizers.path(name)
