"""Token ids as the tokenizers library gives them, word by word: a word that a space begins is encoded once and remembered.

A space before a visible character always begins a token of a byte-level vocabulary, whatever stands before it, so the
ids of a text are those of what comes before its first such space, then those of each word after one.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain

import numpy as np

from gridloom.llm.token_counts import SPECIAL

CUT = re.compile(r" (?=\S)")
#: Where a blank follows a space or a space ends a text: then not every space is a cut.
UNUSUAL = re.compile(r" \s| \Z")
#: Words, and characters of them, that a worker remembers; beyond, it starts anew.
MEMO, MEMO_CHARS = 600_000, 32 << 20
#: New words encoded at a time, in lines of so many.
AT_ONCE, LINE = 8192, 64


class WordIds:
    """Packed ids: 16 bits each where the vocabulary allows it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        special = self.library.token_to_id(SPECIAL)
        self.special = None if special is None else np.array([special], self.kind).tobytes()
        #: Bytes of each token: the vocabulary writes a byte as a letter.
        self.width = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.width[i] = len(token)
        self.reset()

    def reset(self) -> None:
        #: By word with the space that begins it; what begins a text has no space.
        self.memo: dict[str, bytes] = {"": b""}
        self.chars = 0

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.memo)
        self.chars += sum(map(len, new))
        spaced = [w for w in new if w[0] == " "]
        for at in range(0, len(spaced), AT_ONCE):
            self._in_lines(spaced[at : at + AT_ONCE])
        others = list(new.difference(spaced))
        for w, e in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.memo[w] = np.array(e.ids, self.kind).tobytes()

    def _in_lines(self, words: list[str]) -> None:
        """Words one after the other: each begins a token, and its ids are those that cover its bytes."""
        lines = ["".join(words[at : at + LINE]) for at in range(0, len(words), LINE)]
        ids = np.array(list(chain.from_iterable(e.ids for e in self.library.encode_batch_fast(lines, add_special_tokens=False))), self.kind)
        ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in words])
        cuts = (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1) * ids.itemsize
        raw, at = ids.tobytes(), 0
        for w, to in zip(words, cuts.tolist(), strict=True):
            self.memo[w] = raw[at:to]
            at = to

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the special token's string is its id, as the library does by default."""
        if len(self.memo) > MEMO or self.chars > MEMO_CHARS:
            self.reset()
        flat = [p for t in texts for p in t.split(SPECIAL)] if self.special else texts
        split = []
        for t in flat:
            words = CUT.split(t) if UNUSUAL.search(t) else t.split(" ")
            split.append([words[0], *[" " + w for w in words[1:]]])
        self.learn(set(chain.from_iterable(split)))
        get = self.memo.__getitem__
        packed = [b"".join(map(get, w)) for w in split]
        if flat is texts or len(flat) == len(texts):
            return packed
        parts = iter(packed)
        return [self.special.join(next(parts) for _ in range(t.count(SPECIAL) + 1)) for t in texts]


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)
