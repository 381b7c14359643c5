"""Exact token ids by the tokenizers library's models, with a cache of the words already merged.

Both kinds of vocabulary read here split a text by a pattern before merging, and never across the end of a run of
non-blank characters. So a text's ids are those of its pieces (a run, with the blanks before it) put together, and
the library's merge model sees each distinct word once. Where the pattern is WORD_PATTERN or BYTE_PATTERN, whole batches of texts are
split by the kinds of their bytes, and the words of a batch are looked up once each. Texts for which that is not certain (rare blanks, special
tokens, characters from U+0800 on or of disputed kinds, text that normalisation would change) and files of any other layout are encoded
whole by the library; the ids are the same either way.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Pieces and words kept at most; then the cache of either begins anew. Words cost more to make, so they have one of their own.
CACHE, WORD_CACHE = 500_000, 600_000
#: The pattern that byte-level vocabularies of this kind split by, and the bytes that stand for themselves.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VISIBLE = [(33, 126), (161, 172), (174, 255)]
#: The pattern of lower-casing vocabularies that is also found by the kinds of bytes: blank, letter, digit, other.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLANK, LETTER, DIGIT, OTHER, END = range(5)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[ord("a") : ord("z") + 1], _KIND[ord("0") : ord("9") + 1] = BLANK, LETTER, DIGIT
#: Kinds of bytes for BYTE_PATTERN; a byte that UTF-8 never has ends each text.
_END = b"\xff"
_BYTE_KIND = _KIND.copy()
_BYTE_KIND[ord("A") : ord("Z") + 1], _BYTE_KIND[_END[0]] = LETTER, END


def _wide_kinds() -> np.ndarray:
    """The kinds of the characters up to U+07FF, those of one or two bytes, as the library has them: its letters go on after a, its digits after 1."""
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    return np.array([LETTER if len(split(f"a{c}")) == 1 else DIGIT if len(split(f"1{c}")) == 1 else OTHER for c in map(chr, range(1 << 11))], np.uint8)


_WIDE_KIND = _wide_kinds()
#: Characters that are letters or digits for one of regex and the library only: their Unicode versions differ.
_DISPUTED = "".join(c for c, k in zip(map(chr, range(128, 1 << 11)), _WIDE_KIND[128:], strict=True) if (LETTER if regex.match(r"\p{L}", c) else DIGIT if regex.match(r"\p{N}", c) else OTHER) != k)
_UNSURE = re.compile(rf"[\x1c-\x1f\x85\xa0İΣࠀ-\U0010ffff{_DISPUTED}]")
_PIECE = re.compile(r"\s*\S+|\s+")
_HELD: dict[tuple[str, int, int], Encoder] = {}


def _byte_letters() -> dict[int, int]:
    """Each byte's letter in the vocabulary: itself if visible, else the next code point from 256 on."""
    table, more = {b: b for lo, hi in VISIBLE for b in range(lo, hi + 1)}, 256
    for b in range(256):
        if b not in table:
            table[b], more = more, more + 1
    return table


class _Learned(dict):
    """Ids by text, made when a text is first met; begins anew once it holds `most`."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        if len(self) >= self.most:
            self.clear()
        self[text] = ids
        return ids


class _Batches(dict):
    """As _Learned, for the distinct texts of a batch, of which those that are new are made together."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], most: int):
        super().__init__()
        self.make, self.most = make, most

    def of(self, texts: list[bytes]) -> list[bytes]:
        ids = list(map(self.get, texts))
        new = [t for t, i in zip(texts, ids, strict=True) if i is None]
        if new:
            made = self.make(new)
            own = iter(made)
            ids = [next(own) if i is None else i for i in ids]
            if len(self) + len(new) > self.most:  # what this batch has, frequent words among it, is kept
                self.clear()
                new, made = texts, ids
            self.update(islice(zip(new, made, strict=True), self.most))
        return ids


def _contractions(data: np.ndarray, kind: np.ndarray, new: np.ndarray) -> None:
    """Where a span begins with 's, 't, 're, 've, 'm, 'll or 'd, that is a span of its own; data goes on for two bytes after a quote and a letter."""
    quote = np.flatnonzero((data[:-1] == ord("'")) & new[:-1] & (kind[1:] == LETTER))
    next_two = data[quote + 1].astype(np.uint16) << np.uint16(8) | data[quote + 2]
    one = np.isin(next_two >> np.uint16(8), list(b"stmd"))
    two = np.isin(next_two, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
    new[quote[one | two] + 1] = False
    new[quote[one] + 2] = True
    new[quote[two] + 3] = True


def byte_spans(data: np.ndarray) -> np.ndarray:
    """Where the words of BYTE_PATTERN begin in UTF-8 bytes without characters from U+0800 on; each text ends with _END, which is one too."""
    kind = _BYTE_KIND[data]
    lead = np.flatnonzero((data >= 0xC0) & (kind != END))
    kind[lead] = kind[lead + 1] = _WIDE_KIND[(data[lead] & 31).astype(np.uint16) << np.uint16(6) | data[lead + 1] & 63]
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    # The last blank before anything else in a text stands alone, or is the first character of what follows if it is a space.
    last = np.flatnonzero((kind[:-1] == BLANK) & new[1:] & (kind[1:] != END))
    new[last] = True
    new[last[data[last] == ord(" ")] + 1] = False
    _contractions(data, kind, new)
    return np.flatnonzero(new)


def spans(data: np.ndarray) -> np.ndarray:
    """Where the spans of lower-cased UTF-8 bytes begin: words of WORD_PATTERN, blanks between them, and runs of non-blank characters with others than ASCII, whole.

    data ends with two blanks.
    """
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    _contractions(data, kind, new)
    if (data >= 128).any():
        blank = kind == BLANK
        runs = np.flatnonzero(np.concatenate([[True], blank[1:] != blank[:-1]]))
        inside = np.repeat(np.bitwise_or.reduceat(data, runs) >= 128, np.diff(runs, append=len(data)))
        inside[runs] = False
        new &= ~inside
    return np.flatnonzero(new)


class Encoder:
    """Little-endian unsigned 32-bit ids of whole texts, as Tokenizer.encode(text, add_special_tokens=False) has them."""

    def __init__(self, path: str, pieces: int = CACHE, words: int = WORD_CACHE):
        self.lib = Tokenizer.from_file(path)
        self.merge = self.lib.model.tokenize
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        with open(path) as f:
            held = json.load(f)
        pre, norm = held["pre_tokenizer"] or {}, held["normalizer"] or {}
        steps = pre.get("pretokenizers", [])
        lower = [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.split, self.pattern, self.lower = None, None, lower
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.split, self.pattern = _PIECE.findall, regex.compile(BYTE_PATTERN)
        elif lower and len(steps) == 2 and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and not steps[1].get("use_regex"):
            self.split, self.pattern = str.split, regex.compile(steps[0]["pattern"]["Regex"])
        self.by_kinds = self.split is not None and self.pattern.pattern == (WORD_PATTERN if lower else BYTE_PATTERN)
        self.spans = _Learned(self._span, words)
        self.byte_words = _Batches(self._byte_words, pieces + words)
        self.letters = _byte_letters()
        self.code_points = np.array([self.letters[b] for b in range(256)], "<u4")
        self.words = _Learned(self._word, words)
        self.pieces = _Learned(self._piece, pieces)

        self.sizes = _Learned(self._size, pieces)
        added = self.lib.get_added_tokens_decoder().values()
        self.splits = self.split is not None and not any(t.lstrip or t.rstrip or " " in t.content for t in added)

    def _plain(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _whole(self, text: str) -> bool:
        if text.isascii():
            unsure = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        else:
            unsure = _UNSURE.search(text) is not None
        return self.split is None or unsure or any(s in text for s in self.special) or self.lower and not text.isascii() and not unicodedata.is_normalized("NFC", text)

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def _byte_words(self, words: list[bytes]) -> list[bytes]:
        end = chr(self.code_points[_END[0]])
        letters = self.code_points[np.frombuffer(_END.join(words), np.uint8)].tobytes().decode("utf-32-le").split(end)
        return [array("I", [t.id for t in self.merge(x)]).tobytes() for x in letters]

    def _piece(self, piece: str) -> bytes:
        text = piece.lower() if self.lower else piece
        if text.isalpha() or text[0] == " " and text[1:].isalpha():  # the pattern takes it whole
            return self.words[text]
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def _span(self, span: str) -> bytes:
        return b"" if span.isspace() else self._word(span) if span.isascii() else self._piece(span)

    def _size(self, piece: str) -> int:
        text = piece.lower() if self.lower else piece
        if text.isalpha() or text[0] == " " and text[1:].isalpha():
            return len(self.words[text]) // 4
        return sum(len(self.words[w]) for w in self.pattern.findall(text)) // 4

    def lengths(self, texts: list[str]) -> list[int]:
        """The numbers of ids of whole texts; those that go to the library go there at once."""
        known, out = self.sizes.__getitem__, [-1] * len(texts)
        whole = [i for i, t in enumerate(texts) if self._whole(t)]
        for i, e in zip(whole, self.lib.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False) if whole else [], strict=True):
            out[i] = len(e)
        return [sum(map(known, self.split(t))) if n < 0 else n for n, t in zip(out, texts, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.by_kinds and texts:
            return self._encode_by_kinds(texts)
        known = self.pieces.__getitem__
        return [self._plain(t) if self._whole(t) else b"".join(map(known, self.split(t))) for t in texts]

    def _encode_by_kinds(self, texts: list[str]) -> list[bytes]:
        whole = [self._whole(t) for t in texts]
        held = [b"" if w else t.encode() for t, w in zip(texts, whole, strict=True)]
        if self.lower:
            data = np.frombuffer(b"\n".join([*held, b"", b"\n"]).lower(), np.uint8)
            at = spans(data)
            found = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)).dictionary_encode()
            made = list(map(self.spans.__getitem__, found.dictionary.to_numpy(zero_copy_only=False)))
        else:
            data = np.frombuffer(_END.join([*held, b""]), np.uint8)
            at = byte_spans(data)
            found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
            words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
            ends_at = words.index(_END)
            made = self.byte_words.of(words[:ends_at] + words[ends_at + 1 :])
            made.insert(ends_at, b"")
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        begin, which = np.cumsum(sizes) - sizes, found.indices.to_numpy()
        counts = sizes[which]
        ends = np.cumsum(counts)
        ids = np.frombuffer(b"".join(made), "<u4")[np.arange(ends[-1]) + np.repeat(begin[which] - ends + counts, counts)].tobytes()
        # Blanks have no ids, so that it does not matter whose the blanks at a text's ends are.
        first = np.searchsorted(at, np.cumsum([0, *[len(x) + 1 for x in held]]))
        cuts = (4 * np.concatenate([[0], ends])[first]).tolist()
        return [self._plain(t) if w else ids[a:e] for t, w, a, e in zip(texts, whole, cuts[:-1], cuts[1:], strict=True)]


def encoder(path: str, pieces: int = CACHE, words: int = WORD_CACHE) -> Encoder:
    """This worker's encoder of the tokenizer file at path, whose caches hold so many pieces and words at most."""
    key = path, pieces, words
    if key not in _HELD:
        _HELD[key] = Encoder(*key)
    return _HELD[key]
