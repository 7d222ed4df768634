"""SentencePiece ids of notices by a prefix table, and their decoding.

For merge-type (BPE) models the last token of every prefix is unique: it is the one token
that ends there and is compatible with the last token of the prefix before it.  An
automaton finds the tokens that end at each character, a test on the pair decides, and the
ids are read off backwards.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, types as T

from fairlead.llm.common import column, field, key_type, keyed, per_row

# Entries of a worker's tables of words and of tested pairs before they start anew.
TABLE_WORDS, TABLE_PAIRS = 500_000, 1_000_000
LONGEST_KEPT = 64
SPACE = "▁"


class PrefixTable(dict):
    """Word (white-space mark first) -> its ids in decimal, joined by commas."""

    def __init__(self, path: str):
        super().__init__()
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)]
        skipped = set(special)
        self.ids = {sp.id_to_piece(i): i for i in range(n) if i not in skipped}
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in special if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("a model without unused pieces is needed")
        # Merge order: the better the score, the earlier; equal scores go from left to right.
        # Single characters are there from the start.
        order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-sp.get_score(self.ids[p]), p))
        steps = {s: i for i, s in enumerate(sorted({sp.get_score(self.ids[p]) for p in order}, reverse=True))}
        self.rank = {p: steps[sp.get_score(self.ids[p])] for p in order}
        self.halves: dict[str, tuple[str, str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known = frozenset(c for p in self.ids for c in p)
        self.outside = re.compile("([^" + "".join(map(re.escape, sorted(self.known))) + "])")
        self.automaton = ahocorasick.Automaton()
        for p in sorted(self.known):
            self.automaton.add_word(p, p)
        for p in order:
            halves = self._last_merge(p)
            if halves:  # else the merges never make this piece, and it never matches
                self.halves[p] = halves
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        # Words are encoded apart only where no piece reaches over the start of a word.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.decimal = {p: str(i).encode() for p, i in self.ids.items()}

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge completes a piece when its own characters are merged; None if they never do."""
        parts = list(piece)
        while len(parts) > 2:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _compatible(self, left: str, right: str) -> bool:
        """Whether the merges leave the border between two neighbouring tokens as it is.

        The younger of the two is taken apart step by step.  At each step the tokens at the
        border must not form a piece that the merges would have made before.
        """
        rank, halves, first, second = self.rank, self.halves, left, right
        limit = len(rank) + 1
        while True:
            across = rank.get(first + second)
            if across is not None and across < limit:
                return False
            a, b = rank.get(first, -1), rank.get(second, -1)
            if a == b == -1:
                return True
            if a > b:
                limit, first = a, halves[first][1]
            else:  # equal merges go from left to right: one across the border would have come first
                limit, second = b + 1, halves[second][0]

    def _tokens(self, run: str) -> list[bytes]:
        """Tokens of a run of known characters."""
        last: list[str | None] = [None] * (len(run) + 1)
        pairs = self.pairs
        for end, token in self.automaton.iter(run):
            end += 1
            if last[end] is None:
                start = end - len(token)
                if start:
                    pair = (last[start], token)
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= TABLE_PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self._compatible(*pair)
                    if not fits:
                        continue
                last[end] = token
        found, end = [], len(run)
        while end:
            token = last[end]
            found.append(self.decimal.get(token) or self._fallback(token))
            end -= len(token)
        found.reverse()
        return found

    def _fallback(self, character: str) -> bytes:
        if not self.byte_ids:
            return str(self.unknown).encode()
        return b",".join(str(self.byte_ids[b]).encode() for b in character.encode("utf-8"))

    def __missing__(self, word: str) -> bytes:
        if self.known.issuperset(word):
            found = b",".join(self._tokens(word))
        else:
            parts = [self._fallback(p) if self.outside.fullmatch(p) else b",".join(self._tokens(p)) for p in self.outside.split(word) if p]
            found = b",".join(parts)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= TABLE_WORDS:
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str) -> str:
        """The decimal ids of a whole text, joined by commas."""
        normal = self.library.normalize(text)
        if not normal:
            return ""
        if not self.by_word:
            return self.__missing__(normal).decode("ascii")
        head, *words = normal.split(SPACE)
        if "" in words:
            words, runs = [], re.findall(f"{SPACE}*[^{SPACE}]*", normal[len(head):])
            words = [r for r in runs if r]
        else:
            words = [SPACE + w for w in words]
        if head:
            words.insert(0, head)
        return b",".join(map(self.__getitem__, words)).decode("ascii")


@lru_cache(maxsize=1)
def prefix_table(path: str) -> PrefixTable:
    """The table of this worker process."""
    return PrefixTable(path)


@lru_cache(maxsize=1)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode_notices(readings: DataFrame, model: str, key: str = "metric_id", text: str = "construction_notice") -> DataFrame:
    """SentencePiece ids of every whole notice: ``<key>``, n_tokens, token_ids (decimal, joined by commas).

    ``model``: path of a merge-type model, readable on every worker; the model's own
    normalization is applied, without begin or end ids and without sampling.  A row is
    encoded by itself; words are remembered by a worker in a bounded table.  A null or empty
    notice has no ids (an empty string); null and repeated keys are kept, an empty table
    gives an empty result, other columns are ignored.
    """
    rows = keyed(readings, key, text=text)
    schema = T.StructType([T.StructField("key", key_type(rows)), field("n_tokens", "bigint"), field("token_ids", "string")])

    def begin():
        table = prefix_table(model)

        def encode(k, t):
            ids = table.encode(t)
            yield k, ids.count(",") + 1 if ids else 0, ids

        return encode

    return per_row(rows, begin, schema, lambda r: len(r[2])).withColumnRenamed("key", key)


def decode_notices(encoded: DataFrame, model: str, key: str = "metric_id", ids: str = "token_ids") -> DataFrame:
    """The text of encoded notices: ``<key>``, n_tokens, ``<ids>``, decoded_text, by the library's decoder.

    Null ids are read as none: an empty text.
    """
    rows = keyed(encoded, key, ids=ids)
    schema = T.StructType([
        T.StructField("key", key_type(rows)), field("n_tokens", "bigint"), field("ids", "string"), field("decoded_text", "string"),
    ])

    def begin():
        library = _library(model)

        def decode(k, t):
            numbers = list(map(int, t.split(","))) if t else []
            yield k, len(numbers), t, library.decode(numbers) if numbers else ""

        return decode

    return per_row(rows, begin, schema, lambda r: 2 * len(r[2])).select(
        column("key").alias(key), "n_tokens", column("ids").alias(ids), "decoded_text"
    )
