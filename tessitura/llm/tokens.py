"""Whole-text encoding with a tokenizer file, remembered by piece: invented or rare words dominate the cost of BPE."""

from __future__ import annotations

import json
import re

import regex
from tokenizers import Tokenizer

#: The pre-tokenizer patterns of the two public files.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same on printable ASCII in lower case, and such texts in any case.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: BYTE_LEVEL on ASCII from the space to the tilde.
_ASCII_BYTES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+| +(?!\S)| +")
_SPACED = re.compile(r"[\x20-\x7E]+\Z")
_PRINTABLE = re.compile(r"[\x21-\x7E]+\Z")
#: Normalizers that only lower the case of printable ASCII, in any order and with Lowercase among them.
_LOWERING = {"NFC", "Lowercase"}
_LATIN = re.compile(r"[\x00-ɏ]*\Z")


def _byte_characters() -> dict[int, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_CHARACTERS = _byte_characters()


def _only_lowers(normalizer: dict) -> bool:
    steps = normalizer["normalizers"] if normalizer["type"] == "Sequence" else [normalizer]
    spaces = lambda x: x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"}
    return any(x["type"] == "Lowercase" for x in steps) and all(x["type"] in _LOWERING or spaces(x) for x in steps)


class PieceEncoder:
    """Ids of whole texts as little-endian bytes of `width`, equal to Tokenizer.encode(text, add_special_tokens=False).

    A space between two characters that are not white space always starts a pre-token, so a text may be cut there and
    the parts be encoded one by one. Parts of Latin letters are cut once more with the file's own pre-tokenizer pattern.
    Both levels are remembered, up to `limit` entries each. A text with other spacing, or with the name of a special
    token in it, is encoded as it stands.
    """

    def __init__(self, path: str, limit: int = 400_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.spelled = [i.to_bytes(self.width, "little") for i in range(size)]
        self.limit = limit
        self.lowers = self.tokenizer.normalizer is not None
        self.only_lowers = self.lowers and _only_lowers(json.loads(self.tokenizer.to_str())["normalizer"])
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.specials = re.compile("|".join(map(re.escape, names)) or r"(?!)")
        self.whole_only = any(re.search(r"\s", x) for x in names)
        #: A word of ASCII letters is one pre-token then, with its space.
        self.words = not self.lowers and not any(re.fullmatch(r"[A-Za-z]+", x) for x in names)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(self.width, "little") for i in ids)

    def _part(self, part: str) -> bytes | None:
        """None: the text can't be cut beside this part."""
        word = part if self.lowers else part[1:]
        if not word or word[0].isspace() or word[-1].isspace() or self.specials.search(word):
            return None
        if self.only_lowers and _PRINTABLE.match(part):
            known, out = self.pieces, []
            for piece in _ASCII_WORDS.findall(part.lower()):
                out.append(known.get(piece) or self._piece(piece, piece))
            return b"".join(out)
        return self._pieces(part)

    def _piece(self, piece: str, spelled: str) -> bytes:
        spell = self.spelled
        got = b"".join([spell[t.id] for t in self.model.tokenize(spelled)])
        if len(self.pieces) < self.limit:
            self.pieces[piece] = got
        return got

    def _pieces(self, part: str) -> bytes:
        if not _LATIN.match(part):
            return self._plain(part)
        if self.lowers:
            found = WORD_LEVEL.findall(self.tokenizer.normalizer.normalize_str(part))
        else:
            found = (_ASCII_BYTES if _SPACED.match(part) else BYTE_LEVEL).findall(part)
        known, out = self.pieces, []
        for piece in found:
            got = known.get(piece)
            if got is None:
                got = self._piece(piece, piece.encode().decode("latin-1").translate(_BYTE_CHARACTERS))
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.whole_only:
            return self._plain(text)
        first, *parts = text.split(" ")
        if self.lowers:
            parts.insert(0, first)
        head = b""
        if not self.lowers:
            if not first or first[0].isspace() or first[-1].isspace() or self.specials.search(first):
                return self._plain(text)
            head = self._pieces(first)
        known = self.parts
        out = list(map(known.get, parts))
        at = -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            word = parts[at]
            got = known.get(word)
            if got is None and self.words and word.isascii() and word.isalpha():
                spaced = " " + word
                got = self.pieces.get(spaced) or self._piece(spaced, chr(_BYTE_CHARACTERS[0x20]) + word)
            got = got or self._part(word if self.lowers else " " + word)
            if got is None:
                return self._plain(text)
            if len(known) < self.limit:
                known[word] = got
            out[at] = got
        return head + b"".join(out)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str, limit: int = 400_000) -> PieceEncoder:
    """One encoder for each file and Python worker; it remembers as many entries as any caller allows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path, limit)
    _ENCODERS[path].limit = max(limit, _ENCODERS[path].limit)
    return _ENCODERS[path]
