"""Byte-level BPE encoding in linear time, and decoding.

Vocabulary entries are bytes, mapped one to one onto Latin-1 characters so that an
Aho-Corasick automaton over strings finds, for each start, the longest entry. A
piece of text is encoded from left to right with the longest entry, falling back
to the next shorter one, or dropping the last token, whenever the new token can't
stand beside the last one. Two adjacent tokens are compatible when merging their
bytes by rank yields just those two; since a sequence is the BPE encoding exactly
if all its adjacent pairs are compatible, the result equals the merge procedure's.
Dead positions are remembered, so each is tried once; answers on pairs are kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import pieces, table

VOCABULARY = "byte_bpe_50k.tiktoken"
KEPT_PAIRS = 1_000_000
KEPT_CHUNKS = 600_000
#: A space beside other white space: cutting there would change the pieces.
_RUN = re.compile(r" \s|\s ")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder and decoder of one vocabulary; built once in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.entry = {r: b for b, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (r, len(b)))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int | None] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.chunks: dict[str, tuple[int, str, bytes]] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for one byte."""
        if token not in self.halves:
            data, found = self.entry[token], None
            if len(data) > 1:
                for cut in range(1, len(data)):
                    a, b = self.ranks.get(data[:cut]), self.ranks.get(data[cut:])
                    if a is not None and b is not None and max(a, b) < token and self.compatible(a, b, token):
                        found = (a, b)
                        break
            self.halves[token] = found
        return self.halves[token]

    def _shorter(self, token: int) -> int | None:
        """The longest entry that is a proper prefix of ``token``."""
        if token not in self.shorter:
            data = self.entry[token]
            self.shorter[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), None)
        return self.shorter[token]

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merging the bytes of both by rank stops at (left, right).

        Undo the later of the two merges again and again: if at any time the tokens that
        touch the border could have merged earlier than the merge last undone, they would
        have. ``below`` asks the same while only merges under that rank exist.
        """
        key = (left, right)
        if below is None and key in self.beside:
            return self.beside[key]
        limit = below if below is not None else len(self.ranks) + 1
        a, b, fits = left, right, True
        while True:
            merged = self.ranks.get(self.entry[a] + self.entry[b])
            if merged is not None and merged < limit:
                fits = False
                break
            cut_a, cut_b = self._halves(a), self._halves(b)
            if cut_a is None and cut_b is None:
                break
            if cut_b is None or cut_a is not None and a > b:
                limit, a = a, cut_a[1]
            else:
                # Merges on the right of the border come after equal ones on its left.
                limit, b = b + 1, cut_b[0]
        if below is None:
            if len(self.beside) >= KEPT_PAIRS:
                self.beside.clear()
            self.beside[key] = fits
        return fits

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        longest: list[int | None] = [None] * (len(data) + 1)
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            longest[end - size + 1] = token  # ends ascend: the last is the longest
        alive = bytearray(b"\x01") * (len(data) + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while token is not None:
            end = at + len(self.entry[token])
            if alive[end] and (not tokens or self.compatible(tokens[-1], token)):
                tokens.append(token)
                at, token = end, longest[end]
                continue
            token = self._shorter(token)
            if token is None and tokens:
                alive[at] = 0
                dropped = tokens.pop()
                at -= len(self.entry[dropped])
                token = self._shorter(dropped)
                while token is None and tokens:
                    alive[at] = 0
                    dropped = tokens.pop()
                    at -= len(self.entry[dropped])
                    token = self._shorter(dropped)
        return tokens

    def encode(self, text: str) -> list[int]:
        return [t for piece in self.pieces(text) for t in self.encode_piece(piece.encode("utf-8", "surrogatepass"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.entry[t] for t in ids])

    def chunk(self, text: str) -> tuple[int, str, bytes]:
        """Number of tokens, ids as text with a leading space each, and decoded bytes."""
        got = self.chunks.get(text)
        if got is None:
            ids = self.encode(text)
            got = (len(ids), "".join([f" {t}" for t in ids]), self.decode(ids))
            if len(text) <= 64:
                if len(self.chunks) >= KEPT_CHUNKS:
                    self.chunks.clear()
                self.chunks[text] = got
        return got

    def cut(self, text: str) -> list[str]:
        """Chunks that no piece crosses: before each single space between other characters.

        There, and only there, a piece begins whatever stands before it.
        """
        parts = text.split(" ")
        if not _RUN.search(text):
            return [parts[0], *[" " + p for p in parts[1:]]]
        out, run = [], [parts[0]]
        for p in parts[1:]:
            if run[-1] and not run[-1][-1].isspace() and p and not p[0].isspace():
                out.append(" ".join(run))
                run = ["", p]
            else:
                run.append(p)
        return [*out, " ".join(run)]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``.

    Whole texts; a null text is an empty one with no tokens. Special tokens are
    ordinary text. Repeated rows give repeated results; other columns are ignored.
    ``path`` must be readable on the executors, as installed vocabularies are.
    """

    def code(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = codec(path, pattern)
        for texts in pieces(parts):
            out = []
            for text in texts:
                n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
                chunks = bpe.cut(text or "")
                for low in range(0, len(chunks), 4096):
                    got = [bpe.chunk(c) for c in chunks[low : low + 4096]]
                    joined = "".join([g[1] for g in got])
                    ids.update((joined if n else joined[1:]).encode())
                    n += sum([g[0] for g in got])
                    back.update(b"".join([g[2] for g in got]))
                out.append((n, ids.hexdigest(), back.hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    coded = F.pandas_udf(code, "n_tokens long, ids_sha256 string, decoded_sha256 string")(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long"), coded.alias("c")).select("doc_id", "c.*")


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded) for each row: the ids and the text decoded from them."""

    def code(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = codec(path, pattern)
        for texts in pieces(parts):
            ids = [[t for c in bpe.cut(text or "") for t in map(int, bpe.chunk(c)[1].split())] for text in texts]
            back = [bpe.decode(x).decode("utf-8", "surrogatepass") for x in ids]
            yield pd.DataFrame({"n_tokens": [len(x) for x in ids], "token_ids": ids, "decoded": back})

    coded = F.pandas_udf(code, "n_tokens long, token_ids array<int>, decoded string")(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long"), coded.alias("c")).select("doc_id", "c.*")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
