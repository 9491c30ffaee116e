"""Problem 8: the token ids of every document by a public byte-level BPE tokenizer.

The bytes of a text are mapped to Latin-1 characters, so that an Aho-Corasick
automaton over characters finds all vocabulary entries. From the longest match at
each position the encoder walks forward and backtracks where two neighbours
can't stand together: a pair of tokens is compatible when merging its bytes in
rank order gives this pair again. Compatibility is memoised. Texts that are
compatible at every boundary have exactly the tokens of the merge procedure.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.session import ship, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of the 50k byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Pieces that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000


class BytePairEncoder:
    """Encodes texts with the vocabulary of ranks in a .tiktoken file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        self.pieces = regex.compile(PATTERN)
        self.ids: dict[str, int] = {}
        with open(path, "rb") as f:
            for token, rank in (line.split() for line in f if line.strip()):
                self.ids[base64.b64decode(token).decode("latin-1")] = int(rank)
        self.text = {i: t for t, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.known: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[int]:
        """The tokens of text by the merge procedure itself, lowest rank first."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.ids.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == 1 << 60:
                break
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return known

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of token; -1 if there is none."""
        if (known := self.shorter.get(token)) is None:
            t = self.text[token]
            known = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
            self.shorter[token] = known
        return known

    def piece(self, text: str) -> list[int]:
        """The tokens of one piece, given as Latin-1 characters."""
        if (whole := self.ids.get(text)) is not None:
            return [whole]
        n = len(text)
        longest = [(0, -1)] * n
        for end, found in self.automaton.iter(text):
            start = end - found[0] + 1
            if found[0] > longest[start][0]:
                longest[start] = found
        open_ends = bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0][1]
        while at < n:
            last = tokens[-1] if tokens else -1
            while token >= 0:
                end = at + len(self.text[token])
                if open_ends[end] and (last < 0 or self.compatible(last, token)):
                    tokens.append(token)
                    at = end
                    token = longest[end][1] if end < n else -1
                    break
                token = self.prefix(token)
            else:  # nothing fits here: shorten the token before
                open_ends[at] = 0
                at -= len(self.text[tokens.pop()])
                token = self.prefix(last)
        return tokens

    def encode(self, text: str | None) -> list[int]:
        """The ids of text; none for null and for the empty text."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for p in self.pieces.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8").decode("latin-1"))
                if len(p) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """The encoder of a vocabulary file, once in a worker."""
    return BytePairEncoder(path)


_sent: set[tuple[str, str]] = set()


def send_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver to the executors, once a context; its name there."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _sent:
        sc.addFile(path)
        _sent.add((sc.applicationId, path))
    return Path(path).name


def encoded(df: DataFrame, column: str, out: str = "ids", path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """df with the column `out` (array<int>): the ids of `column`, [] for null and empty texts.

    path: the vocabulary on the driver, from where it is sent to the executors.
    """
    ship(df.sparkSession)
    name = send_file(df.sparkSession, path)

    @F.pandas_udf("array<int>")
    def ids(batches: pd.Series) -> pd.Series:
        enc = encoder(SparkFiles.get(name))
        return batches.map(enc.encode)

    return df.withColumn(out, ids(F.col(column)))


def p8_ids(spark, sf_dir, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """Rows (doc_id, ids) for every row of documents; null and empty texts have the ids []."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, "text", path=path).select("doc_id", "ids")
