"""Token counts by rank-synchronous merging of ragged numpy arrays.

The symbols of many pre-tokens lie in one array. In every round each sequence finds its
lowest-ranked adjacent pair and merges all of its occurrences, all sequences at the same time;
a sequence without a ranked pair is done, and its surviving symbols are its tokens. A pair's
product only takes part in later ranks, so this gives what merging one pair at a time gives.

Counts are kept for words (runs without white space, which no token crosses), the commonest
words of a task in a bounded cache.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings in a text count
as one token each, as by default; equal rows give equal counts; an empty table gives an empty
one; other columns are not read. One pass over the rows, no shuffle.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import map_texts
from kinmatch.llm.text import Chunk

#: Words held in a task's cache, and how many of the oldest stay when it is full.
CACHE_WORDS, CACHE_KEPT = 400_000, 100_000
_NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class RankMerger:
    """The vocabulary of a byte-level BPE file with word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.size = max(vocab.values()) + 1
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made
        marks = byte_symbols()
        self.inner = np.array([vocab[x] for x in marks], np.int64)
        self.final = np.array([vocab[x + end] for x in marks], np.int64)
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))

    def pieces(self, word: str) -> tuple[list[str], int]:
        """The pre-tokens of a word, and the number of special strings in it."""
        special = 0
        if "<|" in word:
            parts = self.special.split(word)
            special = len(parts) - 1
        else:
            parts = [word]
        out: list[str] = []
        for part in parts:
            if not part.isascii():
                # Lower-casing goes by single characters: no final sigma.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            out += self.split.findall(part.lower())
        return out, special

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each pre-token (none is empty)."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbols, ends = self.inner[data], np.cumsum(sizes)
        symbols[ends - 1] = self.final[data[ends - 1]]
        out, ids = sizes.copy(), np.arange(len(pieces))
        while len(ids):
            seq = np.repeat(np.arange(len(ids)), sizes)
            starts = np.cumsum(sizes) - sizes
            rank = np.full(len(symbols), _NONE, np.int32)
            rank[:-1] = self.lookup(symbols[:-1], symbols[1:])
            rank[starts + sizes - 1] = _NONE
            least = np.minimum.reduceat(rank, starts)
            hit = (rank == least[seq]) & (rank != _NONE)
            # In a run of overlapping occurrences every second one is merged, from the left.
            at = np.flatnonzero(hit)
            if len(at):
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1] + 1
                first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            sizes = np.add.reduceat(keep.astype(np.int64), starts)
            out[ids] = sizes
            going = (least != _NONE) & (sizes > 1)
            keep &= going[seq]
            symbols, ids, sizes = symbols[keep], ids[going], sizes[going]
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


class WordCounts(dict):
    """Tokens of words; unknown words are counted together."""

    def __init__(self, model: RankMerger):
        super().__init__()
        self.model = model

    def learn(self, words: set[bytes]) -> None:
        if len(self) + len(words) > CACHE_WORDS:
            kept = list(islice(self.items(), CACHE_KEPT))
            self.clear()
            self.update(kept)
        words = [w for w in words if w not in self]
        pieces: list[bytes] = []
        ends, special = [], []
        for w in words:
            got, n = self.model.pieces(w.decode())
            pieces += [p.encode() for p in got]
            ends.append(len(pieces))
            special.append(n)
        sums = np.concatenate([[0], np.cumsum(self.model.count(pieces))]) if pieces else np.zeros(1, np.int64)
        ends = np.array(ends, np.int64)
        total = sums[ends] - sums[np.concatenate([[0], ends[:-1]]).astype(np.int64)] + np.array(special, np.int64) if words else []
        self.update(zip(words, map(int, total), strict=True))


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row for each row of df: its id, n_bytes, n_tokens and over_limit (more than `limit` tokens).

    tokenizer: the path of a byte-level BPE file with word ends, present on every executor.
    """

    def make():
        known = WordCounts(merger(tokenizer))

        def one(rows: pa.RecordBatch, c: Chunk) -> pa.RecordBatch:
            data = c.data.tobytes()
            words = [data[a:b].split() for a, b in zip(c.begin, c.end, strict=True)]
            if new := set().union(*words) - known.keys():
                known.learn(new | set().union(*words) if len(known) + len(new) > CACHE_WORDS else new)
            n = np.array([sum(map(known.__getitem__, w)) for w in words], np.int64)
            return pa.RecordBatch.from_arrays([rows.column("row_id"), pa.array(c.end - c.begin, pa.int64()), pa.array(n)], ["row_id", "n_bytes", "n_tokens"])

        return one

    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    out = map_texts(rows, "text", make, f"row_id {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("row_id", id_col)
