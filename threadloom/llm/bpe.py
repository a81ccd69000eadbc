"""Byte-level BPE encoding and decoding (operator 5).

A text is cut by the tokenizer's pattern. A piece that is a token is that token; any other piece is encoded in linear
time: its bytes, as Latin-1 characters, are matched from the left against pyahocorasick's trie of the vocabulary. At each
place the longest token is tried; a shorter one follows if it does not fit the token before it or if all ways on from
its end have failed, and where none is left the last token is taken back. (The trie is asked at the places reached only:
all matches of the automaton at all places took five times as long.)
Two tokens fit if merging their joined bytes gives just these two, which is looked up once a pair. Where all neighbours
fit, the tokens are those that the merges by rank give.

Nulls count as empty texts (no tokens). Texts are taken whole. Rows are independent: ties, repeats and extra columns
change nothing, and an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept, tidy

#: Fixed value: characters with Unicode's White_Space property, as a class for regular expressions.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Chunks in each generation of what a worker remembers; one takes about 300 bytes.
REMEMBER = 600_000
#: Number of tokens, their ids in decimal with commas, and the bytes that these ids stand for.
Found = tuple[int, str, bytes]


def _joined(parts: list[Found]) -> Found:
    n, ids, data = zip(*parts, strict=True)
    return sum(n), ",".join(ids), b"".join(data)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Recent(dict[str, Found]):
    """Chunks met lately; one that is not there is looked up, so that all of a text's come by one map."""

    def __init__(self, look_up: Callable[[str], Found]) -> None:
        self.look_up = look_up

    def __missing__(self, chunk: str) -> Found:
        return self.look_up(chunk)


class BytePairCodec:
    """Encodes and decodes by the ranks of a vocabulary; what it remembers is bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = REMEMBER) -> None:
        self.ranks, self.remember = ranks, remember
        self.bytes_of = {r: b for b, r in ranks.items()}
        # the pattern's white space is Unicode's; the regex module's \s holds four control characters more
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.wide_gap = re.compile(f" (?:[{WHITE}]|\\Z)")
        self.size_of = {r: len(b) for b, r in ranks.items()}
        self.recent = _Recent(self._looked_up)
        self.older: dict[str, Found] = {}
        self.fits: dict[int, bool] = {}
        self.name_of = {r: str(r) for r in ranks.values()}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.shorter: dict[int, int] = {}
        usable: dict[str, int] = {}
        for b, r in ranks.items():
            if self._merged(b) == [r]:  # others never come from merges
                usable[b.decode("latin-1")] = r
                self.trie.add_word(b.decode("latin-1"), r)
        self.widest = max(map(len, usable), default=0)
        self.longest_of: dict[str, int] = {}  # of what starts some token, the longest token that it starts with
        for b in sorted(usable, key=len):
            for n in range(1, len(b) + 1):
                if b[:n] in usable:
                    self.longest_of[b[:n]] = usable[b[:n]]
                elif n > 1 and b[:n] not in self.longest_of and b[: n - 1] in self.longest_of:
                    self.longest_of[b[:n]] = self.longest_of[b[: n - 1]]
            if (s := self.longest_of.get(b[:-1])) is not None:
                self.shorter[usable[b]] = s

    def _merged(self, data: bytes) -> list[int]:
        """Tokens by the merges themselves, lowest rank first, then leftmost; for single tokens and pairs of them."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fit(self, a: int, b: int) -> bool:
        if len(self.fits) > 2 * self.remember:
            self.fits.clear()
        known = self.fits[a << 32 | b] = self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def _longest(self, text: str, at: int) -> int:
        """The longest token that starts at a byte; the trie finds how far any token agrees with the text."""
        part = text[at : at + self.widest]
        token = self.longest_of.get(part[: self.trie.longest_prefix(part)])
        if token is None:
            raise ValueError("the vocabulary lacks a byte of the text")
        return token

    def _backtracked(self, data: bytes) -> list[int]:
        n, size, shorter, known, text = len(data), self.size_of, self.shorter, self.fits, data.decode("latin-1")
        widest, reach, longest_of = self.widest, self.trie.longest_prefix, self.longest_of
        dead = bytearray(n + 1)  # ends from which no way leads on
        out: list[int] = []
        at, last, token = 0, -1, self._longest(text, 0)
        while True:
            while token is not None:
                if not dead[at + size[token]]:
                    if last < 0:
                        break
                    fit = known.get(last << 32 | token)
                    if fit or (fit is None and self._fit(last, token)):
                        break
                token = shorter.get(token)
            if token is not None:
                out.append(token)
                at += size[token]
                if at == n:
                    return out
                part = text[at : at + widest]
                last, token = token, longest_of.get(part[: reach(part)])
                if token is None:
                    raise ValueError("the vocabulary lacks a byte of the text")
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                token = shorter.get(token)

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        r = self.ranks.get(data)
        return [r] if r is not None else self._backtracked(data)

    def _found(self, ids: list[int]) -> Found:
        return len(ids), ",".join(map(self.name_of.__getitem__, ids)), b"".join(map(self.bytes_of.__getitem__, ids))

    def _looked_up(self, chunk: str) -> Found:
        """Two generations of what was met lately; the older one goes when the younger is full."""
        found = self.older.get(chunk)
        if found is None:
            pieces = self.pattern.findall(chunk)
            if len(pieces) == 1:
                found = self._found(self.encode_piece(chunk))
            elif len(pieces) == 2:
                (a, b, c), (x, y, z) = [self.recent.get(p) or self._looked_up(p) for p in pieces]
                found = a + x, f"{b},{y}", c + z
            else:
                found = _joined([self.recent.get(p) or self._looked_up(p) for p in pieces])
                if len(pieces) > 3:  # such are seldom met again
                    return found
        if len(chunk) <= 64:
            if len(self.recent) >= self.remember:
                self.older, self.recent = self.recent, _Recent(self._looked_up)
            self.recent[chunk] = found
        return found

    def encoded_chunks(self, text: str) -> list[Found]:
        """For each run of white space with what follows up to the next: the number of its tokens, their ids in decimal, the bytes that these stand for.

        Such a run starts and ends where matches of the pattern do, so it is looked up as one. The same holds at a space
        that neither white space nor the end follows, and splitting at those alone is quicker.
        """
        if "\0" in text or self.wide_gap.search(text):
            chunks = self.chunks.findall(text)
        else:
            chunks = text.replace(" ", "\0 ").split("\0")
            if not chunks[0]:
                del chunks[0]
        return list(map(self.recent.__getitem__, chunks))

    def encode(self, text: str) -> list[int]:
        return [int(x) for _, ids, _ in self.encoded_chunks(text) for x in ids.split(",")] if text else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str, remember: int = REMEMBER) -> BytePairCodec:
    """One a Python worker, until it runs tasks of other operators."""
    return kept((path, pattern, remember), lambda: BytePairCodec(read_ranks(path), pattern, remember))


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """df with the token ids of a text column, as array<int>."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for s in texts:
            yield pd.Series([c.encode(t) if t else [] for t in s], index=s.index, dtype=object)

    return bounded_batches(df).withColumn(out, ids(F.col(text)))


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that token ids stand for; null ids give null."""

    @F.pandas_udf("binary")
    def data(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for s in rows:
            yield pd.Series([None if x is None else c.decode(list(x)) for x in s], index=s.index, dtype=object)

    return df.withColumn(out, data(F.col(ids)))


def digests(c: BytePairCodec, texts: Iterable[str | None]) -> list[tuple[int, str, str]]:
    """n_tokens, ids_sha256 and decoded_sha256 of each text. No cycles come up here, so none are looked for among all that is remembered."""
    rows, collects = [], gc.isenabled()
    gc.disable()
    try:
        for t in texts:
            n, ids, data = _joined(c.encoded_chunks(t)) if t else (0, "", b"")
            rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest()))
    finally:
        if collects:
            gc.enable()
    return rows


def token_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", remember: int = REMEMBER) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256, both as lowercase hex.

    Ids are made, digested and decoded a row at a time, so a partition needs memory for a batch of texts only, and a
    worker for what it remembers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern, remember)
        for pdf in batches:
            got = pd.DataFrame(digests(c, pdf["_text"]), columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            got.insert(0, key, pdf["_key"].to_numpy())
            yield got

    kind = df.schema[key].dataType.simpleString()
    return bounded_batches(df).select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(tidy(run, (path, pattern, remember)), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
