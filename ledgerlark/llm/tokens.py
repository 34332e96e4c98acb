"""Token ids of whole texts by the ``tokenizers`` library, with a memory of words.

A text is cut where every pre-tokenizer in use cuts it anyway (single spaces and line breaks), so each piece's ids are
those it has inside the text. Arrow cuts all texts of a batch and finds their distinct pieces; one that was seen before
isn't encoded again, and numpy lays the pieces' ids out in the texts' order. A plain word goes straight to the
vocabulary's BPE model, as it is one pre-token; any other piece goes through the whole tokenizer, and so does a text
whose runs of white space matter to the vocabulary or that holds a control string. The memory is emptied at ``MOST``
entries, or as many as its user allows, and never changes a result.
"""

from __future__ import annotations

import gc
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of the memory, texts encoded at a time.
MOST, TEXTS = 1_200_000, 2500
_MEMORY: dict[str, "WordMemory"] = {}
#: Texts that are encoded whole: control strings and the mark that pieces are cut at; where white space matters also
#: runs of it and other kinds of it.
_CONTROL = "<\\||\\x00"
_ODD = "<\\||  |\n\n| \n|\n |[\\t\\r\\x00\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: A word and ASCII marks after it, which are separate pre-tokens.
_MARKED = re.compile(r"( ?[^\W\d_]+)([!-/:-@\[-`{-~]+)")
#: Letters up to here have no composed form, and their lower case is one letter by itself (but for U+0130).
_LAST = "\u024f"


def _byte_letters() -> dict[int, str]:
    """For each code point up to ``_LAST`` its UTF-8 bytes as the letters that byte-level vocabularies write: printable
    bytes stand for themselves, the others for the letters from U+0100 on, in order."""
    shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    hidden = (b for b in range(256) if b not in shown)
    shown |= {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(ord(_LAST) + 1)}


def vocabulary(name: str) -> str:
    """A public vocabulary file's place."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordMemory(dict):
    """Pieces of texts to their ids (little-endian unsigned 32-bit). ``spaced``: white space matters to the vocabulary."""

    def __init__(self, path: str, spaced: bool, most: int | None = None) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.letters = Tokenizer.from_file(path), spaced, _byte_letters()
        self.model, self.most, self[""] = self.tokenizer.model, most, b""

    def whole(self, text: str) -> bytes:
        """By the tokenizer alone."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if not self.spaced and piece.isascii() and (low := piece.lower()) != piece:
            ids = self[low]
        else:
            ids = self._new(piece)
        self[piece] = ids
        return ids

    def _new(self, piece: str) -> bytes:
        space = self.spaced and piece[0] == " "
        word = piece[1:] if space else piece
        if word.isalpha():
            if word.isascii():  # such letters stand for themselves
                return self._modelled(self.letters[32] + word if space else word if self.spaced else word.lower())
            if max(word) <= _LAST and "\u0130" not in word:
                return self._modelled((piece if self.spaced else piece.lower()).translate(self.letters))
        elif (marked := _MARKED.fullmatch(piece)) and (piece.isascii() or (max(piece) <= _LAST and "\u0130" not in piece)):
            return self[marked[1]] + self[marked[2]]
        return self.whole(piece)

    def _modelled(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _pieces(self, texts: pa.Array) -> pa.Array:
        """The pieces of each text, as lists."""
        if self.spaced:
            return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00"), "\x00")
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, each text's followed by ``end``, and how many ids each has with it. Null texts are empty."""
        if len(self) > (self.most or MOST):
            self.clear()
            self[""] = b""
        gc.disable()  # the memory holds no cycles, but many objects to look at
        try:
            texts = pc.fill_null(texts.cast(pa.large_string()), "")
            odd = pc.match_substring_regex(texts, _ODD if self.spaced else _CONTROL)
            lists = self._pieces(pc.if_else(odd, "", texts))
            named = lists.flatten().dictionary_encode()
            known = [self[p] for p in named.dictionary.to_numpy(zero_copy_only=False)]
            whole = {i: np.frombuffer(self.whole(texts[i].as_py()), dtype="<u4") for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        finally:
            gc.enable()
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        start, piece = np.cumsum(size) - size, named.indices.to_numpy()
        n = size[piece]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(known), dtype="<u4")[np.repeat(start[piece] - upto[:-1], n) + np.arange(upto[-1])]
        bounds = upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        counts = np.diff(bounds)
        where = np.repeat(bounds[1:], [len(whole.get(i, ())) + 1 for i in range(len(texts))]) if whole else bounds[1:]
        if whole:
            put = np.concatenate([x for i in range(len(texts)) for x in (whole.get(i, ids[:0]), [end])]).astype("<u4")
            counts = counts + [len(whole.get(i, ())) for i in range(len(texts))]
        else:
            put = end
        return np.insert(ids, where, put), counts + 1


def memory(path: str, spaced: bool, most: int | None = None) -> WordMemory:
    """This process's encoder for a file, kept from task to task."""
    if path not in _MEMORY:
        _MEMORY[path] = WordMemory(path, spaced, most)
    _MEMORY[path].most = most
    return _MEMORY[path]
