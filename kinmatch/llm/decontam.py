"""Benchmark decontamination by latent semantic retrieval, confirmed by common subsequences.

1. Every document is counted once for each of its hashed words (2**18 counters): the IDF.
2. Benchmark items are cut into passages of at most 48 words, and these into slabs of at most
   `rank`, by hash. A randomised SVD of each slab's TF-IDF matrix, in a task for each slab, gives
   its latent space: a (features x rank) sketch is multiplied by A'A and orthonormalised, for a few
   power iterations. Slabs share the scans of the documents, as many in each as memory allows: the
   driver holds the indexes of about `scan` passages at a time, about 10 MB for a slab.
3. Windows of 64 words, 16 apart, of every whole document are folded in. Vectors are linear in
   tf, so each block of 16 words is projected once and a window is the sum of four. Its norm is
   taken word by word (repeats add up less), a difference of running sums, and so is what it has
   of common and of rarer benchmark words, which bounds its cosine with any passage that repeats
   words no more than the passages do, and tells whether it can hold `sure` of a passage's words.
   Windows within reach are compared with all passages in slabs (the benchmark is the stated
   query set). A candidate has a cosine of `min_cosine`, or a product with the passage that is no
   less than that of `sure` of the passage's words, its lightest ones: other words in the window
   thin out a short passage's cosine, but do not take from that product.
4. A candidate is a leak if the longest common subsequence holds `sure` of the passage's words,
   or, with a cosine of `min_cosine`, `possible` of them and, as in a paraphrase, the answer too:
   `answer_share` of the passage's rarest words are in the window.
5. Items of fewer than `min_words` words are too short for a share of their words to tell much;
   they are matched exactly, as runs of words.

A slab's space has a dimension for each of its passages, so it holds all of them and no cosine is
lost, however many passages there are.

Defined results: null, empty and short texts have no leak unless they hold a passage; null items
and those without words hold nothing and are in no text; the cosine of an exact run is 1; a text of
any length is read whole; repeated items are one, items of equal text are all found; of equally good
windows any gives the same result; repeated rows are judged alike; an empty benchmark or table gives
no leaks; other columns are not read, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import SMALL_CHUNK, given_back, map_texts, one_blas_thread, quoted, saved, small_batches, whole
from kinmatch.llm.text import Chunk, chunks, folded, run_hash

BUCKETS = 1 << 18
#: Features of the latent space at most.
FEATURES = 1 << 16


@dataclass(frozen=True)
class Decontam:
    passage: int = 48
    window: int = 64
    stride: int = 16
    rank: int = 256
    power: int = 2
    min_words: int = 8
    min_cosine: float = 0.33
    #: Words below this IDF are bounded apart from the rarer ones.
    common_idf: float = 5.0
    sure: float = 0.8
    possible: float = 0.6
    answer_words: int = 5
    answer_share: float = 0.8
    #: Passages in one scan of the documents, about: their indexes are held by each task.
    scan: int = 4096


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def document_frequency(df: DataFrame, text_col: str) -> np.ndarray:
    """Documents for each word bucket; the last entry is the number of documents."""

    def make(batches):
        total, last = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for c in chunks(batch.column(0), folded, SMALL_CHUNK):
                once = np.unique(c.doc.astype(np.int64) * BUCKETS + bucket(c.word_hash))
                total[:BUCKETS] += np.bincount(once % BUCKETS, minlength=BUCKETS)
                last += c.n
        total[BUCKETS] = last
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
        batch = c = once = None
        given_back()

    small_batches(df.sparkSession)
    rows = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(make, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS + 1, np.int64)
    got = rows.toPandas()
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def idf_of(counts: np.ndarray) -> np.ndarray:
    return (np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 0.1).astype(np.float32)


def cut(c: Chunk, d: int, p: Decontam) -> list[np.ndarray]:
    """The passages of a text as word hashes: as few even cuts as keep to the length."""
    words = c.word_hash[c.first[d] : c.first[d + 1]]
    return np.array_split(words, -(-len(words) // p.passage)) if len(words) else []


def passages(benchmark: DataFrame, id_col: str, text_col: str, p: Decontam) -> DataFrame:
    """item_id, words array<bigint> (hashes), short (is the item matched exactly)."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column("text"), folded):
                got = [(d, w) for d in range(c.n) for w in cut(c, d, p)]
                if got:
                    ids = batch.column("item_id").take(pa.array([c.rows.start + d for d, _ in got]))
                    short = pa.array([bool(c.n_words[d] < p.min_words) for d, _ in got])
                    yield pa.RecordBatch.from_arrays([ids, pa.array([w.view(np.int64) for _, w in got], pa.list_(pa.int64())), short], ["item_id", "words", "short"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, words array<bigint>, short boolean")


def _features(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and weight of a passage's distinct words, of unit length."""
    w, n = np.unique(words, return_counts=True)
    weight = n * idf[bucket(w)]
    return (w % np.uint64(FEATURES)).astype(np.int64), weight / max(1e-9, np.linalg.norm(weight))


def latent_space(words: list[np.ndarray], used: np.ndarray, idf: np.ndarray, p: Decontam) -> np.ndarray:
    """Right singular vectors (used features x rank) of the TF-IDF matrix of at most `rank` passages."""
    a = np.zeros((len(words), len(used)))
    for k, w in enumerate(words):
        f, x = _features(w, idf)
        np.add.at(a[k], np.searchsorted(used, f), x)
    basis = np.random.default_rng(11).standard_normal((len(used), p.rank))
    for _ in range(p.power):
        basis = np.linalg.qr(a.T @ (a @ basis))[0]
    # basis' A'A basis: its eigenvectors turn the basis into singular vectors.
    seen = a @ basis
    values, turn_by = np.linalg.eigh(seen.T @ seen)
    keep = values > max(1e-6 * values.max(), 1e-12)
    return (basis @ turn_by[:, keep]).astype(np.float32)


class Index:
    """What a task needs: the IDF, the benchmark's words and passages, and their latent vectors."""

    def __init__(self, items: list, words: list[np.ndarray], idf: np.ndarray, used: np.ndarray, space: np.ndarray, p: Decontam):
        self.items, self.idf, self.p = items, idf, p
        self.size = np.array([len(w) for w in words], np.int64)
        self.vocabulary = np.unique(np.concatenate(words))
        self.words = np.full((len(words), 64), -1, np.int32)
        for k, w in enumerate(words):
            self.words[k, : len(w)] = np.searchsorted(self.vocabulary, w)
        self.feature = np.searchsorted(used, (self.vocabulary % np.uint64(FEATURES)).astype(np.int64))
        weight = idf[bucket(self.vocabulary)]
        self.rows = np.append(space[self.feature] * weight[:, None], np.zeros((1, space.shape[1]), np.float32), 0)
        self.common = weight < p.common_idf
        self.flags = np.zeros(BUCKETS, bool)
        self.flags[bucket(self.vocabulary)] = True
        latent, self.most_common, self.repeats = [], 0.0, 1.0
        product, least, least_rare = (np.zeros(len(words)) for _ in range(3))
        rare = np.zeros((len(words), p.answer_words), np.int32)
        for k, w in enumerate(words):
            f, x = _features(w, idf)
            latent.append(x @ space[np.searchsorted(used, f)])
            once, n = np.unique(w, return_counts=True)
            mass = (n * idf[bucket(once)]) ** 2
            self.repeats = max(self.repeats, np.sqrt(mass.sum() / (mass / n).sum()))
            self.most_common = max(self.most_common, np.sqrt(mass[idf[bucket(once)] < p.common_idf].sum() / mass.sum()))
            order = np.lexsort((once, -idf[bucket(once)]))[: p.answer_words]
            rare[k] = np.resize(np.searchsorted(self.vocabulary, once[order]), p.answer_words)
            # What `sure` of the words, the lightest, have at least of the product and of the window's mass, in all and in rarer words.
            each, need = idf[bucket(once)].astype(np.float64) ** 2, int(np.ceil(p.sure * len(w) - 1e-9))
            product[k] = np.sort(np.repeat(n * each, n))[:need].sum() / np.sqrt(mass.sum())
            least[k] = np.sort(np.repeat(each, n))[:need].sum()
            of_rare = np.sort(np.repeat(each, n)[np.repeat(idf[bucket(once)] >= p.common_idf, n)])
            least_rare[k] = of_rare[: max(0, need - (len(w) - len(of_rare)))].sum()
        self.latent, self.rare = np.array(latent, np.float32), rare
        # Less a little for what small singular values and single precision take away.
        self.product = (0.97 * product).astype(np.float32)
        order = np.argsort(least_rare)
        self.least_rare, self.least = 0.999 * least_rare[order], 0.999 * np.minimum.accumulate(least[order])

    def leaks(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, passage, share of the passage in common, cosine of every confirmed window."""
        p, h = self.p, c.word_hash
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2]
        if len(h):
            b = bucket(h)
            word = np.full(len(h), -1, np.int32)
            maybe = np.flatnonzero(self.flags[b])
            at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == h[maybe]
            word[maybe[same]] = at[same]
            weight = self.idf[b].astype(np.float64) ** 2
            doc, start, stop, block, near, norm = self._windows(c, weight, word)
            latent = self._blocks(c, word, block[near])
            for k in np.array_split(near, -(-len(near) // 4096)) if len(near) else []:
                vectors = sum(latent[block[k] + j] for j in range(p.window // p.stride))
                product = vectors @ self.latent.T
                cosine = product / norm[k, None]
                w, q = np.nonzero((cosine >= p.min_cosine) | (product >= self.product))
                if len(w):
                    found, share = self._confirm(word, start[k[w]], stop[k[w]], q, cosine[w, q])
                    out.append((doc[k[w[found]]], q[found], share[found], cosine[w[found], q[found]].astype(np.float64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _windows(self, c: Chunk, weight: np.ndarray, word: np.ndarray):
        """Text, first and last word and first block of each window, those near enough, and the windows' norms."""
        p, wide = self.p, self.p.window // self.p.stride
        blocks = -(-c.n_words // p.stride)
        per = np.where(c.n_words > 0, np.maximum(1, blocks - wide + 1), 0)
        doc = np.repeat(np.arange(c.n), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = c.first[doc] + p.stride * nth
        stop = np.minimum(start + p.window, c.first[doc + 1])
        block = self._first_block(c)[doc] + nth
        rare = word >= 0
        rare[rare] = ~self.common[word[rare]]
        n2, c2, r2 = (x[stop] - x[start] for x in (np.concatenate([[0], np.cumsum(y)]) for y in (weight, weight * ((word >= 0) & ~rare), weight * rare)))
        both, a = np.sqrt(np.maximum(0, c2 + r2)), self.most_common
        # The largest product with a unit vector of which at most the part a is in common words.
        bound = np.where(np.sqrt(np.maximum(0, c2)) <= a * both, both, a * np.sqrt(np.maximum(0, c2)) + np.sqrt(1 - a * a) * np.sqrt(np.maximum(0, r2)))
        norm = np.sqrt(np.maximum(n2, 1e-12))
        # Of the passages whose rarer words the window can hold, the one of least mass; 1e-6 for the running sums.
        k = np.searchsorted(self.least_rare, r2 + 1e-6, side="right") - 1
        whole = (k >= 0) & (c2 + r2 + 1e-6 >= self.least[np.maximum(k, 0)])
        return doc, start, stop, block, np.flatnonzero(whole | (bound * self.repeats >= p.min_cosine * norm)), norm.astype(np.float32)

    def _first_block(self, c: Chunk) -> np.ndarray:
        """Blocks of `stride` words, with empty ones after each text so that no window leaves it."""
        blocks = -(-c.n_words // self.p.stride) + self.p.window // self.p.stride
        return np.cumsum(blocks) - blocks

    def _blocks(self, c: Chunk, word: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The sum of the weighted rows of the latent space over each block's words, for the blocks of wanted windows."""
        p = self.p
        total = int((-(-c.n_words // p.stride) + p.window // p.stride).sum())
        out = np.zeros((total, self.rows.shape[1]), np.float32)
        used = np.zeros(total, bool)
        for j in range(p.window // p.stride):
            used[wanted + j] = True
        base = self._first_block(c)
        used = np.flatnonzero(used)
        doc = np.searchsorted(base, used, side="right") - 1
        start = c.first[doc] + (used - base[doc]) * p.stride
        for a in range(0, len(used), 256):
            s = slice(a, a + 256)
            grid = start[s, None] + np.arange(p.stride)
            ids = np.where(grid < c.first[doc[s] + 1, None], word[np.minimum(grid, len(word) - 1)], -1)
            out[used[s]] = self.rows[ids].sum(1)  # the last row, of no word, is 0
        return out

    def _confirm(self, word: np.ndarray, start: np.ndarray, stop: np.ndarray, q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        share, answer = np.zeros(len(q)), np.zeros(len(q))
        for a in range(0, len(q), 2048):
            s = slice(a, a + 2048)
            grid = start[s, None] + np.arange(p.window)
            text = np.where(grid < stop[s, None], word[np.minimum(grid, len(word) - 1)], np.int32(-1))
            share[s] = common_subsequence(self.words[q[s]], text) / self.size[q[s]]
            answer[s] = (self.rare[q[s]][:, :, None] == text[:, None, :]).any(2).mean(1)
        return (share >= p.sure) | ((share >= p.possible) & (answer >= p.answer_share) & (cosine >= p.min_cosine)), share


class Runs:
    """Short items, found as runs of words."""

    def __init__(self, items: list, words: list[np.ndarray]):
        self.items, self.keys = [], {}
        for n in sorted({len(w) for w in words}):
            # The hash that grams() gives the same run in a text.
            some = [(run_hash(w), item) for w, item in zip(words, items, strict=True) if len(w) == n]
            key = np.array([k for k, _ in some], np.uint64)
            order = np.argsort(key, kind="stable")
            self.keys[n] = key[order], len(self.items)
            self.items += [some[k][1] for k in order]

    def leaks(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, item, 1 and 1 for every run that is an item."""
        out = [(np.zeros(0, np.int64),) * 2]
        for n, (keys, before) in self.keys.items():
            run, doc = c.grams(n)
            low, high = np.searchsorted(keys, run), np.searchsorted(keys, run, side="right")
            at = np.flatnonzero(high > low)
            times = (high - low)[at]
            nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            out.append((np.repeat(doc[at], times), before + np.repeat(low[at], times) + nth))
        doc, q = (np.concatenate(x) for x in zip(*out, strict=True))
        return doc, q, np.ones(len(q)), np.ones(len(q))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of rows of a (64 wide) and b; entries below 0 match nothing.

    Bit-parallel over the positions of a, all pairs at the same time.
    """
    left = np.full(len(a), ~np.uint64(0))
    b = np.where(b < 0, np.int32(-9), b)
    for j in range(b.shape[1]):
        match = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view("<u8")[:, 0]
        u = left & match
        left = (left + u) | (left - u)
    return np.bitwise_count(~left).astype(np.int64)


def scans(df: DataFrame, benchmark: DataFrame, p: Decontam, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> Iterator[list[Index | Runs]]:
    """The indexes of one scan after another; each index has at most `rank` passages, so that its space holds them all."""
    parts = saved(passages(benchmark, item_col, item_text, p).distinct())
    count = parts.count()
    n, slabs = -(-count // p.scan), max(1, -(-count // p.rank))
    idf = idf_of(document_frequency(df, text_col)) if n else None
    shared = df.sparkSession.sparkContext.broadcast(idf)
    parts = parts.withColumn("slab", F.pmod(F.xxhash64("item_id", "words"), F.lit(slabs)).cast("int"))

    def index(table: pa.Table) -> pa.Table:
        """The indexes of a slab: one, or more where it got more passages than `rank`."""
        one_blas_thread()
        rows = sorted(zip(table.column("words").to_pylist(), table.column("item_id").to_pylist(), strict=True), key=lambda r: (r[0], str(r[1])))
        words, out = [np.array(w, np.int64).view(np.uint64) for w, _ in rows], []
        for at in np.array_split(np.arange(len(rows)), -(-len(rows) // p.rank)):
            own = [words[i] for i in at]
            used = np.unique((np.concatenate(own) % np.uint64(FEATURES)).astype(np.int64))
            out.append(Index([rows[i][1] for i in at], own, shared.value, used, latent_space(own, used, shared.value, p), p))
            out[-1].idf = None  # all have the same one
        return pa.table({"slab": pa.array([table.column("slab")[0].as_py()], pa.int32()), "built": pa.array([pickle.dumps(out)], pa.binary())})

    for k in range(n):
        rows = parts.where(F.col("slab") % n == k)
        out = []
        for r in rows.where("not short").groupBy("slab").applyInArrow(index, "slab int, built binary").orderBy("slab").collect():
            for one in pickle.loads(r.built):
                one.idf = idf
                out.append(one)
        short = [(r.item_id, np.array(r.words, np.int64).view(np.uint64)) for r in rows.where("short").collect()]
        if short:
            out.append(Runs(*map(list, zip(*short, strict=True))))
        if out:
            yield out


def build_indexes(df: DataFrame, benchmark: DataFrame, p: Decontam, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> list[Index | Runs]:
    """The indexes of all scans."""
    return [index for scan in scans(df, benchmark, p, text_col, item_col, item_text) for index in scan]


def _all_leaks(scan: list[Index | Runs], c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the indexes of a scan find, passages numbered through."""
    found, before = [], 0
    for index in scan:
        doc, q, share, cosine = index.leaks(c)
        found.append((doc, q + before, share, cosine))
        before += len(index.items)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _each(df: DataFrame, text_col: str, scan: list[Index | Runs], schema, out: Callable[[pa.RecordBatch, Chunk, tuple], pa.RecordBatch | None], inside: str | None = None) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(scan)

    def make():
        one_blas_thread()
        return lambda rows, c: out(rows, c, _all_leaks(shared.value, c))

    return map_texts(df, text_col, make, schema, folded, inside, SMALL_CHUNK)


def find_leaks(df: DataFrame, benchmark: DataFrame, p: Decontam = Decontam(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each id and benchmark item that its text holds: id, item, lcs_share and cosine (the best of its windows)."""
    kinds = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"row_id {kinds[0]}, item {kinds[1]}, lcs_share double, cosine double"
    names = [id_col, item_col]

    def out(items, rows, c, leaks):
        doc, q, share, cosine = leaks
        if not len(doc):
            return None
        return pa.RecordBatch.from_arrays([rows.column("row_id").take(pa.array(doc)), items.take(pa.array(q)), pa.array(share), pa.array(cosine)], ["row_id", "item", "lcs_share", "cosine"])

    rows = df.select(F.col(quoted(id_col)).alias("row_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    found = df.sparkSession.createDataFrame([], schema)
    for scan in scans(df, benchmark, p, text_col, item_col, item_text):
        items = pa.array([item for index in scan for item in index.items])
        found = found.union(_each(rows, "text", scan, schema, partial(out, items)))
    return found.groupBy("row_id", "item").agg(F.max("lcs_share").alias("lcs_share"), F.max("cosine").alias("cosine")).toDF(*names, "lcs_share", "cosine")


def without_leaks(df: DataFrame, benchmark: DataFrame, p: Decontam = Decontam(), text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """df's rows, all columns, whose text holds no benchmark item."""

    def out(rows, c, leaks):
        keep = np.ones(c.n, bool)
        keep[leaks[0]] = False
        return rows.filter(pa.array(keep))

    clean = df.select(whole(df).alias("row"))
    schema = clean.schema
    for scan in scans(df, benchmark, p, text_col, item_col, item_text):
        clean = _each(clean, text_col, scan, schema, out, "row")
    return clean.select("row.*")
