"""Token ids by the tokenizers library, encoded once per piece of text between spaces."""

from __future__ import annotations

import re
import sys
from array import array

END = 0  # appended to each document
CACHED = 349_000  # parts in each of the two generations a worker keeps
SEEN = 1 << 22  # places in which parts that came once are marked

# ASCII that is neither letter, digit nor white space; behind a word a run of it is one piece.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# The pieces that the byte-level pattern makes of ASCII without white space.
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 ]+")

# Bytes that the byte-level alphabet shows as themselves; the others follow from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_ALPHABET = {b: chr(256 + n) for n, b in enumerate(_HIDDEN)}

_SWAPPED = sys.byteorder == "big"

# A space is cut off safely unless white space stands both before and after it.
_UNSAFE = re.compile(r" (?=\s|\Z)(?<=\s )")

# Frequent marks are cut off the word before them, if a letter or digit stands before each that ends a part,
# and line ends are cut out, if no white space stands beside one. A part behind such a cut begins with its sign.
_ENDS = ".,"
_NO_WORD = re.compile(r"[.,](?=[ \n])(?<![^\W_].)")
_NO_LINE = re.compile(r"\n(?:(?=\s|\Z)|(?<=\s\n)|(?<!.\n))", re.DOTALL)
_CUT = "\0"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if _SWAPPED:
        found.byteswap()
    return found.tobytes()


class _Shown(dict):
    """Characters as the byte-level alphabet shows their bytes."""

    def __missing__(self, char: str) -> str:
        found = char.encode("utf-8", "surrogatepass").decode("latin-1").translate(_ALPHABET)
        if len(self) < 5000:
            self[char] = found
        return found


_shown = _Shown().__getitem__


class _Parts(dict):
    """Ids of parts, each with ``before`` in front of it; bounded, in two generations.

    Those used since the older generation was filled are kept, so frequent parts stay. Beyond an eighth of
    the places a new part is kept only when it comes again, as most parts of a large table come once.
    """

    def __init__(self, encoder: Encoder, before: str) -> None:
        super().__init__()
        self.encoder, self.before, self.older = encoder, before, {}
        self.shown, self.tokenize = before.replace(" ", _ALPHABET[0x20]), encoder.tokenize
        self.seen, self.marked = bytearray(SEEN), 0

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part) if self.older else None
        if found is None:
            if len(part) > 200 or not self.encoder.plain:
                found = self.encoder.whole(self.before + part)
                if len(part) > 200:
                    return found
            elif part.isalpha():
                shown = part if part.isascii() else "".join(map(_shown, part))
                found = _packed([t.id for t in self.tokenize(self.shown + shown)])
            elif part[:1] == _CUT and self.before:
                found = self.encoder.bare[part[1:]]
            elif (word := part.rstrip(_MARKS)).isalpha():
                # A word and the marks behind it are two pieces; kept apart, rare ones take one place.
                known = word in self
                found = self[word] + self.encoder.bare[part[len(word) :]]
                if not known:
                    return found
            else:
                found = self.found(part)
            if self.new(part):
                return found
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        self[part] = found
        return found

    def new(self, part: str) -> bool:
        """Whether a part needn't be kept as it comes for the first time, and most places are taken."""
        if not self.older and len(self) <= CACHED // 8:
            return False
        place = hash(part) % SEEN
        if self.seen[place]:
            return False
        if self.marked >= SEEN // 4:
            self.seen, self.marked = bytearray(SEEN), 0
        self.seen[place] = 1
        self.marked += 1
        return True

    def found(self, part: str) -> bytes:
        encoder, words = self.encoder, part.split()
        if words == [part] and part.isascii() and part.isprintable():
            pieces = _PIECES.findall(self.before + part)
            return b"".join(map(encoder.piece, pieces))
        if "\n" in part:
            lines = part.split("\n")
            if words == lines:
                # A single line end between words is a piece of its own, and no space follows it.
                words = [self[lines[0]], *[encoder.bare[x] for x in lines[1:]]]
                return encoder.line_end.join(words)
        return encoder.whole(self.before + part)


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit), equal to encoding the whole text at once.

    A byte-level BPE encodes the pieces of its pattern one by one, and a piece holds a space only in
    front or within white space. So a text may be cut before every single space that follows or
    precedes a word, and most parts are then found in the cache. Marks and line ends between words are cut
    off first where that is as safe. A part that is one piece, or ASCII
    whose pieces are known, goes to the library's model itself, which spares it the offsets of each
    character. Texts where that is not certain, or with a special token in them, are encoded whole, and
    so are all parts if the file has another pattern or a step before it.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        steps = f"{self.library.normalizer} {self.library.pre_tokenizer} {self.library.post_processor}"
        self.plain = re.fullmatch(r"None ByteLevel\(add_prefix_space=False, .*use_regex=True\) None", steps) is not None
        self.tokenize = self.library.model.tokenize
        self.line_end = self.whole("\n")
        self.spaced, self.bare = _Parts(self, " "), _Parts(self, "")

    def whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        """The ids of one piece of the pattern, by the model. It is printable ASCII."""
        return _packed([t.id for t in self.tokenize(piece.replace(" ", _ALPHABET[0x20]))])

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text (a null is empty), without the end id."""
        if not text:
            return b""
        if _CUT in text or _UNSAFE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        if self.plain:
            marks = "" if _NO_WORD.search(text) else _ENDS
            if "\n" in text and not _NO_LINE.search(text):
                text = text.replace("\n", f" {_CUT}\n {_CUT}")
            for mark in marks:
                text = text.replace(f"{mark} ", f" {_CUT}{mark} ")
        head, *rest = text.split(" ")
        return self.bare[head] + b"".join(map(self.spaced.__getitem__, rest))

    def document(self, text: str | None) -> bytes:
        return self.encode(text) + END.to_bytes(4, "little")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a file; its cache outlives a task where Spark keeps the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
