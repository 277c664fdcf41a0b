"""Token ids by the tokenizers library, with every distinct word encoded once per worker.

A text is cut where the tokenizer's own pre-tokenizer always cuts (at white space), so the ids of a text are the
ids of its words one after the other. Words repeat far more often than texts do. A word of letters up to U+00FF is one
piece to every pre-tokenizer known here, so it goes to the library's model alone; anything else goes through the whole
library.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from collections.abc import Callable

from .common import forget_others

#: White space as the tokenizer files mean it (Unicode White_Space) apart from the space and \n; fixed values.
OTHER_SPACE = "\t\x0b\x0c\r\x85\xa0                　"
#: What str.split() takes for white space and the tokenizer files don't; fixed values.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: Bytes that a worker gives to the words that it remembers.
REMEMBERED_BYTES = 96_000_000
#: Bytes of an entry besides its word and ids: its place in the table.
ENTRY_BYTES = 110
#: Bits that tell which words were asked for before.
SEEN_BITS = 1 << 24
#: The last letter of the Latin blocks, in which no letter is changed or taken apart by normalisation.
LATIN = "\u024f"
#: ASCII marks that no pre-tokenizer known here takes together with a letter; the apostrophe is not among them.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters of a word beyond which it is encoded each time.
LONGEST = 64


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable in Latin-1 and
    no space, else the next one from U+0100 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


#: For str.translate: characters of bytes read as Latin-1.
AS_CHARACTERS = dict(enumerate(byte_characters()))


SPACE = AS_CHARACTERS[ord(" ")]


class _Known(dict):
    """ids of words; a new word is encoded when it is first asked for.

    Words are held in two generations, each of half the bytes: a full young one becomes the old one, whose words come
    back as they are asked for. So common words stay, and the bytes are bounded. A word is held from the second time on
    that it is asked for, told by a bit of its hash; most words that come once leave nothing but that bit.
    """

    def __init__(self, encode: Callable[[str], bytes], alone: Callable[[str], bytes], lower: bool, most: int = REMEMBERED_BYTES):
        self.encode, self.alone, self.lower, self.most = encode, alone, lower, most
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.bytes = 0
        self.seen = bytearray(SEEN_BITS // 8)

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            head = word.rstrip(MARKS)
            if len(head) < len(word) and head and head[-1] <= LATIN and head[-1].lower()[-1].isalpha():
                ids = self[head] + self.mark(word[len(head) :])  # marks after a letter are a word of their own
            elif self.lower and plain(word) and (small := word.lower()) != word:
                ids = self[small]
            else:
                ids = self.encode(word)
            h = hash(word) % SEEN_BITS
            at, bit = h >> 3, 1 << (h & 7)
            if not self.seen[at] & bit:
                self.seen[at] |= bit
                return ids
        if len(word) <= LONGEST:
            self.bytes += sys.getsizeof(word) + sys.getsizeof(ids) + ENTRY_BYTES
            if self.bytes > self.most // 2:
                self.old = dict(self)
                self.clear()
                self.bytes, self.seen = 0, bytearray(SEEN_BITS // 8)
            self[word] = ids
        return ids

    def mark(self, marks: str) -> bytes:
        if len(marks) > 8:
            return self.alone(marks)
        if marks not in self.marks:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            self.marks[marks] = self.alone(marks)
        return self.marks[marks]


def plain(word: str) -> bool:
    """Letters up to U+00FF, which no normalisation changes and whose lower case is one letter."""
    return word.isalpha() and (word.isascii() or max(word) <= "\xff")


class WordTokenizer:
    """ids of whole texts as bytes of little-endian unsigned 32-bit integers; `spec` is a tokenizer file's content."""

    def __init__(self, spec: str, most: int = REMEMBERED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.model = self.library.model
        rules = json.loads(spec)
        self.special = [t["content"] for t in rules.get("added_tokens", [])]
        before, normal = json.dumps(rules.get("pre_tokenizer")), json.dumps(rules.get("normalizer"))
        byte_level = '"ByteLevel"' in before and '"add_prefix_space": false' in before
        if byte_level and '"Split"' in before and r"[^\\s\\p{L}\\p{N}]+" in before and '"invert": true' in before:
            self.encode_one = self._spaceless  # white space is dropped
            self.known = _Known(lambda w: self._letters(w) if plain(w) else self._whole(w), self._whole, "Lowercase" in normal, most)
        elif byte_level and normal == "null" and ('"use_regex": true' in before or r"?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+" in before):
            self.encode_one = self._spaced
            self.known = _Known(self._after_space, self._whole, False, most)
        else:
            self.encode_one = self._whole  # unknown rules

    def _after_space(self, word: str) -> bytes:
        """A word after a space, which belongs to it, or after a line feed, which does not."""
        if plain(word):
            return self._letters(word, SPACE)
        if word[:1] != "\n":
            return self._whole(" " + word)
        return self.known.mark("\n") + self._letters(word[1:]) if plain(word[1:]) else self._whole(word)

    def _letters(self, word: str, before: str = "") -> bytes:
        as_characters = word if word.isascii() else word.encode().decode("latin-1").translate(AS_CHARACTERS)
        return array("I", [t.id for t in self.model.tokenize(before + as_characters)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _spaceless(self, text: str) -> bytes:
        if any(s in text for s in self.special) or any(c in text for c in NOT_SPACE):
            return self._whole(text)
        return b"".join(map(self.known.__getitem__, text.split()))

    def _spaced(self, text: str) -> bytes:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in OTHER_SPACE) or any(s in text for s in self.special):
            return self._whole(text)  # runs of white space
        words = text.replace("\n", " \n").split(" ")
        return (self._letters if plain(words[0]) else self._whole)(words[0]) + b"".join(map(self.known.__getitem__, words[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]


_loaded: dict[str, WordTokenizer] = {}


def kept_tokenizer(name: str, spec: Callable[[], str]) -> WordTokenizer:
    """The worker's tokenizer of that name; made from spec() when it is first asked for."""
    forget_others(name, _loaded.clear)
    if name not in _loaded:
        _loaded[name] = WordTokenizer(spec())
    return _loaded[name]


def tokenizer(path: str) -> WordTokenizer:
    def spec() -> str:
        with open(path, encoding="utf-8") as f:
            return f.read()

    return kept_tokenizer(path, spec)
