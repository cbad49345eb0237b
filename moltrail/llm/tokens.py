"""Operator 6, token counts of every prefix.

A byte-level BPE first cuts a text into pieces; no token crosses a piece. Inside a piece the
encoding of each prefix is known from dynamic programming: the encoding of the first i bytes is
that of the first j bytes and one token over bytes j..i, for the only such token that can stand
after the last token of the first j. Two tokens can stand side by side when no merge across their
border would come before the merges that made them. The exact number of tokens of every prefix of
a piece is kept in a table; a text's prefix counts are running sums over its pieces.

Rows: null and empty texts have no bytes and no tokens; repeated rows each give a row; a null
doc_id stays null; columns other than doc_id and text are ignored; any length of text is counted
whole. Each row needs memory for its own text only; the piece tables of a task are emptied at
TABLE_PIECES pieces.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, table

#: The cutting rule of this family of vocabularies.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: The same rule for texts of these characters only, with plain classes, which is faster.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
EASY = rf"\t-\r -~{_LETTER}"
EASY_PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+"
#: Pieces whose prefix counts a task keeps at most before it starts its table anew.
TABLE_PIECES = 800_000
LONG_PIECE = 255
LIMIT = 1024
_LATE = 1 << 60


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if it prints, else 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Totals(dict):
    """Tokens of whole pieces, from their prefix counts."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        n = 1 if piece in self.counter.special else self.counter.counts(piece)[-1]
        if len(piece) <= LONG_PIECE:
            self[piece] = n
        return n


class PrefixCounter:
    """Exact token counts of prefixes for one vocabulary file of the tokenizers library."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            said = json.load(f)
        byte = _byte_of()
        self.ids = {bytes(byte[c] for c in t): i for t, i in said["model"]["vocab"].items() if all(c in byte for c in t)}
        name = {t: i for t, i in said["model"]["vocab"].items()}
        self.merged, self.parts = {}, {}
        for pair in said["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = name[a + b]
            self.merged[name[a], name[b]] = i
            self.parts[i] = (name[a], name[b])
        self.ends, self.size = ahocorasick.Automaton(), [0] * (1 + max(self.ids.values()))
        for t, i in self.ids.items():
            self.ends.add_word(t.decode("latin-1"), i)
            self.size[i] = len(t)
        self.ends.make_automaton()
        self.special = [t["content"] for t in said["added_tokens"] if t["special"]]
        self.any_cut, self.easy_cut = regex.compile(PIECE).findall, re.compile(EASY_PIECE).findall
        self.not_easy = re.compile(f"[^{EASY}]").search
        self.between = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.edges: tuple[dict, dict] = {}, {}
        self.fits: dict[int, bool] = {}
        self.prefixes: dict = {}
        self.totals = _Totals(self)

    def edge(self, token: int, side: int) -> list[int]:
        """What stands at the token's left (0) or right (1) border while it is made, from the byte up."""
        known = self.edges[side]
        if token not in known:
            known[token] = [*(self.edge(self.parts[token][side], side) if token in self.parts else []), token]
        return known[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes together is these two tokens."""
        left, right, i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
        while True:
            up_left = left[i + 1] if i + 1 < len(left) else _LATE
            up_right = right[j + 1] if j + 1 < len(right) else _LATE
            across = self.merged.get((left[i], right[j]), _LATE)
            if across < up_left and across <= up_right:
                return False
            if up_left == up_right == _LATE:
                return True
            if up_left <= up_right:
                i += 1
            else:
                j += 1

    def counts(self, piece: str):
        """Number of tokens of the first 0, 1, ... bytes of a piece."""
        known = self.prefixes.get(piece)
        if known is not None:
            return known
        raw = piece.encode().decode("latin-1")
        fits, size, done = self.fits, self.size, 0
        last, counts = [-1], [0]
        for end, token in self.ends.iter(raw):  # longer tokens first
            if end < done:
                continue
            j = end + 1 - size[token]
            if j:
                pair = last[j] << 20 | token
                if pair not in fits:
                    fits[pair] = self.compatible(last[j], token)
                if not fits[pair]:
                    continue
            last.append(token)
            counts.append(counts[j] + 1)
            done += 1
        if len(raw) > LONG_PIECE:  # not kept
            return counts
        if len(self.prefixes) >= TABLE_PIECES:
            self.prefixes.clear()
            self.totals.clear()
            self.fits.clear()
        self.prefixes[piece] = known = bytes(counts)
        return known

    def cut(self, text: str) -> list[str]:
        return self.any_cut(text) if self.not_easy(text) else self.easy_cut(text)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; each special string is one piece."""
        if not self.between or not any(s in text for s in self.special):
            return self.cut(text)
        out, at = [], 0
        for m in self.between.finditer(text):
            out += [*self.cut(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self.cut(text[at:])

    def tokens(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.totals.__getitem__, pieces), np.int64, len(pieces))

    def total(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, self.pieces(text)))

    def anew(self, pieces: list[str], running: np.ndarray, j: int, n: int) -> int:
        """Tokens of the text up to n characters into piece j, the last two pieces cut anew."""
        back = max(0, j - 1)
        return (int(running[back - 1]) if back else 0) + self.total("".join(pieces[back:j]) + pieces[j][:n])

    def inside(self, pieces: list[str], running: np.ndarray, j: int) -> list[int]:
        """Exact tokens of the text up to each character of piece j. A text that ends there may be cut otherwise than the
        whole: white space at its end is one piece, and a part of a special string or of a contraction is no such."""
        piece = pieces[j]
        if piece in self.special or piece in CONTRACTIONS:
            out = [self.anew(pieces, running, j, n) for n in range(1, len(piece))]
        else:
            base, counts = (int(running[j - 1]) if j else 0), self.counts(piece)
            out = [base + counts[e] for e in accumulate(len(c.encode()) for c in piece)]
        out[len(piece) - 1 :] = [int(running[j])]
        if self.joins(pieces, j):
            out[0] = self.anew(pieces, running, j, 1)
        return out

    def joins(self, pieces: list[str], j: int) -> bool:
        """Whether the first character of piece j goes on with the white space before it."""
        return bool(j and pieces[j][0].isspace() and pieces[j - 1].isspace())

    def prefix_counts(self, text: str) -> list[int]:
        """Exact tokens of the first 0, 1, 2, ... characters."""
        pieces = self.pieces(text)
        running = np.cumsum(self.tokens(pieces))
        return [0, *(n for j in range(len(pieces)) for n in self.inside(pieces, running, j))]

    def budget(self, pieces: list[str], running: np.ndarray, limit: int) -> str:
        """The longest prefix, by whole characters, of at most limit tokens. It ends inside the first piece whose end is over
        the limit, or right behind it where white space goes on."""
        k = int(np.searchsorted(running, limit, side="right"))
        if k == len(pieces):
            return "".join(pieces)
        if k + 1 < len(pieces) and self.joins(pieces, k + 1) and self.anew(pieces, running, k + 1, 1) <= limit:
            return "".join(pieces[: k + 1]) + pieces[k + 1][:1]
        n = max((n for n, tokens in enumerate(self.inside(pieces, running, k), 1) if tokens <= limit), default=0)
        return "".join(pieces[:k]) + pieces[k][:n]


_counters: dict[str, PrefixCounter] = {}


def counter(vocabulary: str) -> PrefixCounter:
    if vocabulary not in _counters:
        _counters[vocabulary] = PrefixCounter(vocabulary)
    return _counters[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, budget_bytes (the longest prefix within the limit, in bytes);
    with prefixes also the array prefix_tokens: the exact counts of the first 0, 1, 2, ... characters. vocabulary: path of
    a byte-level BPE file, which each worker opens."""

    def run(batches):
        known = counter(vocabulary)
        for batch in chunks(batches):
            rows: dict[str, list] = {k: [] for k in ("n_bytes", "n_tokens", "budget_bytes", "prefix_tokens")}
            for text in batch.column("text"):
                text = text.as_py() or ""
                size = len(text.encode())
                pieces = known.pieces(text)
                if size > limit:
                    running = np.cumsum(known.tokens(pieces))
                    n = int(running[-1]) if len(running) else 0
                else:  # no text has more tokens than bytes
                    n = sum(map(known.totals.__getitem__, pieces))
                rows["n_bytes"].append(size)
                rows["n_tokens"].append(n)
                rows["budget_bytes"].append(size if n <= limit else len(known.budget(pieces, running, limit).encode()))
                if prefixes:
                    rows["prefix_tokens"].append(known.prefix_counts(text))
            arrays = [batch.column("doc_id"), pa.array(rows["n_bytes"], pa.int64()), pa.array(rows["n_tokens"], pa.int64())]
            arrays += [pc.greater(arrays[2], limit), pa.array(rows["budget_bytes"], pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "budget_bytes"]
            if prefixes:
                names.append("prefix_tokens")
                arrays.append(pa.array(rows["prefix_tokens"], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, budget_bytes long"
    schema += ", prefix_tokens array<long>" if prefixes else ""
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
