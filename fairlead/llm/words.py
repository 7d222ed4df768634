"""Token ids of whole texts by the tokenizers library, one library call per distinct word of a task.

The tokenizer file used here (word BPE) drops white space before its merges run, so the ids
of a text are the ids of its space-separated words in a row.  A word of plain letters,
digits and signs is cut as the file's own pattern cuts it and its parts go to the library's
BPE model; any other word (other scripts, combining marks, special tokens) goes through the
library's whole pipeline.  Both tables are bounded and start anew when they are full.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

# Entries of the two tables of a worker process (about 200 bytes each).
TABLE_WORDS, TABLE_PARTS = 700_000, 400_000
# Longer words are encoded but not remembered.
LONGEST_KEPT = 64

_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
# Fixed value: the file's split pattern, for plain lower-case words.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class _Parts(dict):
    """Part of a plain word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model = tokenizer.model
        self.number = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
        self.visible = _byte_signs()

    def __missing__(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join(map(self.visible.__getitem__, part.encode("utf-8")))
        found = b"".join([self.number[t.id] for t in self.model.tokenize(shown)])
        if len(part) <= LONGEST_KEPT:
            if len(self) >= TABLE_PARTS:
                self.clear()
            self[part] = found
        return found


def _byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in signs:
            signs[b] = chr(spare)
            spare += 1
    return [signs[b] for b in range(256)]


class WordIds(dict):
    """Word (UTF-8) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = _Parts(self.tokenizer)

    def __missing__(self, word: bytes) -> bytes:
        shown = word.decode("utf-8")
        if word.isalpha():  # ASCII letters only
            found = self.parts[shown.lower()]
        elif _PLAIN.fullmatch(shown) and "<|" not in shown:
            found = b"".join(map(self.parts.__getitem__, _PARTS.findall(shown.lower())))
        else:
            ids = self.tokenizer.encode(shown, add_special_tokens=False).ids
            found = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(word) <= LONGEST_KEPT:
            if len(self) >= TABLE_WORDS:
                self.clear()
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, as bytes."""
        return b"".join(map(self.__getitem__, text.encode("utf-8").split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The table of this worker process."""
    return WordIds(path)
