"""Token ids by the tokenizers library, exact for whole texts, with a bounded memo of words.

A text is cut at spaces between two characters that are not white space: no pre-token of the supported files spans such a
cut, so the ids of the parts, joined, are the ids of the text. Parts repeat a lot, so each worker keeps the ids of the
parts it has met, up to `limit`. Parts that are empty or have white space at an end send their piece of text to the
tokenizer as it is, and so does a text that may hold an added token such as <|endoftext|>: the library takes those before it
looks for pre-tokens, and what stands around them is encoded on its own.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20  # characters split at a time
LONGEST = 48  # characters of a part that is worth keeping
#: A word of Latin-1 letters, which is one pre-token in the supported files, and one mark after it, which is another.
PLAIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)").fullmatch


def _space(c: str) -> bool:
    return c.isspace()


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """Parts of about `limit` characters or more, cut before a space that stands between two other characters."""
    at = 0
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        while cut >= 0 and (cut + 1 >= len(text) or _space(text[cut - 1]) or _space(text[cut + 1])):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Encoder:
    """encode(texts): the ids of each text as little-endian bytes of `dtype`."""

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if hasattr(self.tok.model, "_resize_cache"):
            self.tok.model._resize_cache(0)  # the memo below stands for it
        # A text that holds an added token holds its first two characters (no normaliser of the supported files makes these).
        self.hints = tuple({t.content[:2] for t in self.tok.get_added_tokens_decoder().values()})
        if any(any(c.isalnum() for c in h) or h.isspace() for h in self.hints):
            raise ValueError("an added token begins like a word")
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.limit, self.memo = limit, {}
        # Files with word ends drop white space, so a mark between parts stands alone; in the others it ends the part.
        self.words_end = getattr(self.tok.model, "end_of_word_suffix", None) is not None
        self.mark, self.mark_id = self._mark()
        self.marks = {"": b""} | {c: self._plain(c).tobytes() for c in ".,;:!?"}
        # Byte-level files show a byte as itself where it is printable, else as one of the characters from U+0100 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in own)}

    def _mark(self) -> tuple[str, int]:
        """A control character that is one token of its own and part of no other."""
        vocab = self.tok.get_vocab()
        for code in range(1, 9):
            shown = chr(0x100 + code)  # how byte-level files show that byte
            own = {shown, shown + "</w>"}
            ids = self._plain(f" {chr(code)} " if self.words_end else chr(code))
            if len(ids) == 1 and not any(shown in word and word not in own for word in vocab):
                return chr(code), int(ids[0])
        raise ValueError("no byte is free to mark the ends of words")

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _learn(self, parts: list[str], into: dict[str, bytes]) -> None:
        """The ids of parts that follow a space; plain words skip the search for pre-tokens."""
        rest, model, kind, lower = [], self.tok.model.tokenize, self.dtype.char, self.words_end
        space, marks = "" if lower else "\u0120", self.marks
        for x in parts:
            if m := PLAIN_WORD(x):
                word = m[1].lower() if lower else m[1]
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(self.shown)
                into[x] = array(kind, [t.id for t in model(space + word)]).tobytes() + marks[m[2]]
            else:
                rest.append(x)
        self._learn_rest(rest, into)

    def _learn_rest(self, parts: list[str], into: dict[str, bytes]) -> None:
        between = f" {self.mark} " if self.words_end else self.mark
        for i in range(0, len(parts), 512):
            some = parts[i : i + 512]
            safe = [x for x in some if self.mark not in x]
            ids = self._plain("".join(f" {x}{between}" for x in safe)) if safe else np.zeros(0, self.dtype)
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) != len(safe):
                raise ValueError("the marks of words were not found again")
            begin = 0
            for x, end in zip(safe, ends.tolist()):
                into[x] = ids[begin:end].tobytes()
                begin = end + 1
            if len(safe) < len(some):
                for x in set(some) - set(safe):
                    into[x] = self._plain(" " + x).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        whole = {k: self._plain(text).tobytes() for k, text in enumerate(texts) if any(h in text for h in self.hints)}
        cut = [[] if at in whole else [(k, piece, (piece[1:] if k else piece).split(" ")) for k, piece in enumerate(pieces(text))] for at, text in enumerate(texts)]
        new = set().union(*(words for parts in cut for _, _, words in parts)).difference(memo)
        unfit = {w for w in new if not w or _space(w[0]) or _space(w[-1])}
        new -= unfit
        self._learn([w for w in new if len(w) <= LONGEST], memo)
        long: dict[str, bytes] = {}
        self._learn([w for w in new if len(w) > LONGEST], long)
        known = memo | long if long else memo
        out = []
        for at, parts in enumerate(cut):
            got = [whole[at]] if at in whole else []
            for k, piece, words in parts:
                if unfit and not unfit.isdisjoint(words):
                    got.append(self._plain(piece).tobytes())
                elif k:
                    got.extend(map(known.__getitem__, words))
                else:  # the first word of a text follows no space
                    got.append(self._plain(words[0]).tobytes())
                    got.extend(map(known.__getitem__, words[1:]))
            out.append(b"".join(got))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def batches(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together, so that memory is bounded by the longest text."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
