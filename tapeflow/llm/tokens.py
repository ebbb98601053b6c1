"""Token ids by the tokenizers library, each distinct part of a batch encoded once.

Both tokenizers used here cut a text at white space before they merge, so a
text's ids are the ids of its space-separated parts one after the other. A batch
is cut to parts and its distinct parts are found by Arrow; the tokenizer's own
normaliser, its split pattern and its merge model are applied to the parts that
are not remembered, and the ids are gathered by numpy.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .shared import ranges, slices

#: Distinct words that a Python worker remembers for a tokenizer (beyond that the more frequent half stays), the ids
#: that they may have in all, and bytes of text whose parts are told apart, and whose ids are laid out, together.
WORDS_KEPT, IDS_KEPT, TEXT_BYTES, LAID_BYTES = 1 << 18, 1 << 22, 4 << 20, 1 << 20
#: Texts that go to the library whole: white space next to white space, and characters on which Unicode
#: versions may differ. RE2 syntax; the first class is Unicode's white space.
_WHOLE = r"[\s\x0b\x85\p{Z}][\s\x0b\x85\p{Z}]|[\x1c-\x1f]|[\x{10000}-\x{10ffff}]"
#: The split pattern of byte-level BPE tokenizers that name none of their own. Fixed value.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Latin letters as ranges (not U+0130, whose lower case is two characters), ASCII signs that may follow a word (no
#: apostrophe), and the parts that consist of both, after a line break or not. All that the normaliser can do to the
#: letters is lower-casing, and the split pattern parts them from the signs.
_LATIN = "AZ az ÀÖ Øö øį ıɏ".split()
_LETTERS = "".join(chr(c) for r in _LATIN for c in range(ord(r[0]), ord(r[1]) + 1))
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
_PLAIN = rf"^\n?[{''.join(f'{r[0]}-{r[1]}' for r in _LATIN)}]+[{re.escape(_SIGNS)}]*$"

_LOADED: dict[tuple[str, bool], TokenCache] = {}


def byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: printable bytes stand for themselves,
    the others in order for the code points from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


class TokenCache:
    def __init__(self, path: str, spaces: bool):
        """spaces: a space belongs to the word after it and a line break is a token of
        its own (byte-level BPE); else white space is dropped."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        split = given["pre_tokenizer"]
        own = [x["pattern"]["Regex"] for x in split.get("pretokenizers", []) if x["type"] == "Split"]
        self.split = regex.compile(own[0] if own else BYTE_LEVEL_SPLIT)
        self.normalise = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else None
        #: Whether the normaliser lower-cases; what it does to plain words is known then.
        self.lower = self.normalise is not None and self.normalise("AÉ") == "aé"
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.blank = chr(self.letters[32])
        self.spaces = spaces
        #: A text with one of the file's added tokens goes to the library whole, which recognises them.
        self.whole = "|".join([_WHOLE, *(re.escape(x["content"]) for x in given.get("added_tokens", []))])
        self.line_break = self._library("\n") if spaces else []
        self.signs: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        #: Remembered words, how often each was met, and where its ids begin in ``ids``.
        self.known, self.met = pa.array([], pa.string()), np.zeros(0)
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> list[int]:
        """Ids of what the split pattern leaves whole."""
        letters = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.merge(letters)]

    def part(self, part: str, plain: bool = False) -> list[int]:
        """Ids of a part; ``plain`` says that it is a word of Latin letters. With ``spaces`` a part
        stands for itself after a space, or after a line break where it begins with one."""
        if plain and part.isascii() and part.isalnum():
            return [t.id for t in self.merge(self.blank + part if self.spaces else part.lower() if self.lower else part)]
        lead, text = [], part
        if self.spaces:
            lead, text = (self.line_break, part[1:]) if part[:1] == "\n" else (lead, " " + part)
        if plain:
            return lead + self._piece(text.lower() if self.lower else text)
        pieces = self.split.findall(self.normalise(text) if self.normalise else text)
        return lead + [x for piece in pieces for x in self._piece(piece)]

    def _signs(self, signs: str) -> list[int]:
        return [x for piece in self.split.findall(signs) for x in self._piece(piece)]

    def _parts(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The parts of the texts, and where each text's parts begin."""
        if self.spaces:
            # The line break in front of a word stays with it; a first one is put before every text.
            lines = pc.replace_substring(texts, "\n", " \n")
            found = pc.split_pattern(pc.binary_join_element_wise("\n", lines, ""), " ")
        else:
            found = pc.utf8_split_whitespace(texts)
        return found.flatten().dictionary_encode(), found.offsets.to_numpy()

    def _numbers(self, parts: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in a row, and of each distinct part where its ids begin there and how many it has.
        A plain part's ids are those of its word and those of the signs behind it."""
        plain = pc.match_substring_regex(parts, _PLAIN)
        word = pc.if_else(plain, pc.utf8_rtrim(parts, _SIGNS), parts).dictionary_encode()
        sign = pc.if_else(plain, pc.utf8_ltrim(parts, "\n" + _LETTERS), "").dictionary_encode()
        of_word, of_sign = word.indices.to_numpy(), sign.indices.to_numpy()
        is_plain = np.zeros(len(word.dictionary), bool)
        is_plain[of_word] = plain.to_numpy(zero_copy_only=False)
        ids, starts, sizes = self._words(word.dictionary, is_plain, np.bincount(of_word, often, len(is_plain)))
        signs = [self._signs(x) if x else [] for x in sign.dictionary.to_pylist()]
        more = np.fromiter(map(len, signs), np.int64, len(signs))
        starts, sizes, more_starts, more = starts[of_word], sizes[of_word], (np.cumsum(more) - more)[of_sign], more[of_sign]
        at = np.cumsum(sizes + more) - sizes - more
        out = np.empty(int((sizes + more).sum()), np.uint32)
        flat = np.fromiter(itertools.chain.from_iterable(signs), np.uint32)
        for source, start, size, to in ((ids, starts, sizes, at), (flat, more_starts, more, at + sizes)):
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(to, size) + step] = source[np.repeat(start, size) + step]
        return out, at, sizes + more

    def _words(self, words: pa.Array, plain: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`_numbers`, for distinct words; those not remembered are encoded now."""
        numbers = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(numbers < 0)
        added = words.take(pa.array(new))
        made = list(map(self.part, added.to_pylist(), plain[new].tolist()))
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        numbers[new] = len(self.met) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, added])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(sizes.sum()))])
        self.met = np.concatenate([self.met, np.zeros(len(new))])
        self.met[numbers] += often
        out = self.ids, self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        if len(self.met) > WORDS_KEPT:
            half = np.sort(np.argpartition(-self.met, WORDS_KEPT // 2)[: WORDS_KEPT // 2])
            sizes = np.diff(self.starts)[half]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            self.ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[half] - ends[:-1], sizes)]
            self.known, self.met, self.starts = self.known.take(pa.array(half)), self.met[half] / 2, ends
        if len(self.ids) > IDS_KEPT:
            self._forget()
        return out

    def _cut(self, texts: pa.Array):
        """What :meth:`encode` and :meth:`counts` share: the ids of the texts that go to the library whole,
        ids, each part's place there and number of ids, and where each text's parts begin."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.whole)
        library = {int(i): self._library(texts[i].as_py()) for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False))}
        coded, offsets = self._parts(pc.if_else(whole, "", texts))
        codes = coded.indices.to_numpy()
        ids, starts, sizes = self._numbers(coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary)))
        return library, ids, starts[codes], sizes[codes], offsets

    def encode(self, texts: pa.Array):
        """The ids (unsigned 32-bit) of each text of a string array, one text after the other; null counts as empty."""
        first = len(self.line_break)
        for some in slices(texts, TEXT_BYTES):
            library, ids, starts, sizes, offsets = self._cut(some)
            for at, n in ranges(some, LAID_BYTES):
                a, b = int(offsets[at]), int(offsets[at + n])
                ends = np.concatenate([[0], np.cumsum(sizes[a:b])])
                flat = ids[np.arange(ends[-1]) + np.repeat(starts[a:b] - ends[:-1], sizes[a:b])]
                own = ends[offsets[at : at + n + 1] - a].tolist()
                for i in range(n):
                    yield np.array(library[at + i], np.uint32) if at + i in library else flat[own[i] + first : own[i + 1]]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text of a string array has."""
        out = [np.zeros(0, np.int64)]
        for some in slices(texts, TEXT_BYTES):
            library, _, _, sizes, offsets = self._cut(some)
            n = np.diff(np.concatenate([[0], np.cumsum(sizes)])[offsets]) - len(self.line_break)
            for i, x in library.items():
                n[i] = len(x)
            out.append(n)
        return np.concatenate(out)


def tokenizer(path: str, spaces: bool) -> TokenCache:
    """The worker's tokenizer for a file, loaded once."""
    if (path, spaces) not in _LOADED:
        _LOADED[path, spaces] = TokenCache(path, spaces)
    return _LOADED[path, spaces]
