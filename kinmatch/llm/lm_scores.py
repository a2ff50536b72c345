"""Language-model scores: word counts over the whole corpus, and a causal attention model.

1. Words of all training texts are counted: each task adds up its own, then the sums meet by
   hash. The counts stay a table; the commonest words, at most `common`, are broadcast, which
   spares most words the join and changes no result.
2. Every whole text becomes subword ids, once, stored; the base score of its common words is
   summed on the way, and a list of the rest meets the counts in a join.
3. The ids and the pairs of neighbouring ids of all training texts are counted; they set the
   model's classes and its direct path (attention.py).
4. The attention layer is trained in one pass over all training texts, in `rounds` rounds. Texts
   are cut into runs of `run_blocks` blocks, which meet, by hash, in one of the rounds and there
   one of its learners, of about `learner_tokens` tokens each; a learner goes on from the round's
   model by itself, and the mean of all learners' models, weighted by tokens, is the next. What a
   learner gets and its order do not depend on partitions.
5. Every text is scored whole with the model.

Size: the model's arrays, and the pair counts behind them, are bounded by Shape (at most inputs +
classes, squared, pairs: 85 MB of counts; about 10 MB on prose; 21 MB as a table in a scoring
worker), whatever the corpus; a learner's
task holds `learner_tokens` tokens, a scoring task one text or a chunk.

Words are told apart by 64-bit hashes. Defined results: a null or empty text is its end alone; a
text of any length is scored whole; a null id is hashed as an empty text; without training texts
all counts are 0, N is 0 and the model is as it begins; repeated rows score alike; an empty table
gives an empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.attention import Attention, Numbering, Shape
from kinmatch.llm.common import map_texts, one_blas_thread, saved
from kinmatch.llm.text import Chunk, chunks, lowered, mix

#: The key of the end of a text among the word hashes.
END = 0
#: Words whose subwords are remembered; then all are forgotten.
CACHE_WORDS = 400_000


#: Tokens scored or counted at a time; a longer text is held alone.
CHUNK_TOKENS = 1 << 19


@dataclass(frozen=True)
class Scoring:
    common: int = 1 << 18
    dim: int = 24
    classes: int = 256
    groups: int = 8
    block: int = 8
    inputs: int = 2048
    rounds: int = 4
    run_blocks: int = 64
    learner_tokens: int = 2_000_000
    #: Steps that a learner makes at least, over its runs again if they are few.
    least_steps: int = 200
    #: Counts merged in a task before they are sent on.
    merge: int = 3_000_000


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Subwords:
    """The subword ids of words, each with a space before it; the commonest stay in a table."""

    def __init__(self, path: str, pattern: str, n_common: int = 0):
        self.encoding, self.n_common = tokenizer(path, pattern), n_common
        self.size = self.encoding.n_vocab
        self._clear()
        # Tokens never cross a space, and in " a b c" each word begins with the one token that begins with a space.
        self.opens = np.array([self.encoding.decode_single_token_bytes(k)[:1] == b" " for k in range(self.size)])

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.sizes = self.starts = self.flat = self.slot = np.zeros(0, np.int64)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        texts = [w.decode("utf-8", "replace") for w in words]
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(texts)), np.int64)
        first = np.flatnonzero(self.opens[ids])
        if len(first) == len(words):
            return ids, np.diff(np.append(first, len(ids)))
        each = [self.encoding.encode_ordinary(" " + t) for t in texts]
        return np.array([x for ids in each for x in ids], np.int64), np.array([len(x) for x in each], np.int64)

    def __call__(self, c: Chunk, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, an end (id `size`) after each, and how many each text has.

        common: for each word its number among the commonest words, or -1; those are met by number.
        """
        if len(self.at) > CACHE_WORDS:
            self._clear()
        index = np.full(len(c.starts), -1)
        if common is not None:
            if not len(self.slot):
                self.slot = np.full(self.n_common, -1)
            numbered = common >= 0
            index[numbered] = self.slot[common[numbered]]
        open_ = np.flatnonzero(index < 0)
        if len(open_):
            data = c.data.tobytes()
            words = [data[a:b] for a, b in zip(c.starts[open_].tolist(), c.stops[open_].tolist(), strict=True)]
            grown = list(dict.fromkeys(w for w in words if w not in self.at))
            if grown:
                ids, more = self._encode(grown)
                base = len(self.sizes)
                self.at.update(zip(grown, range(base, base + len(grown)), strict=True))
                self.starts = np.append(self.starts, len(self.flat) + np.cumsum(more) - more)
                self.sizes = np.append(self.sizes, more)
                self.flat = np.append(self.flat, ids)
            index[open_] = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            if common is not None:
                ours = open_[common[open_] >= 0]
                self.slot[common[ours]] = index[ours]
        n = c.n_words
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        per_text = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])])
        gather = np.arange(int(sizes.sum())) + np.repeat(self.starts[index] - (ends - sizes), sizes)
        out = np.full(len(gather) + c.n, self.size, np.int64)
        out[np.arange(len(gather)) + np.repeat(np.arange(c.n), per_text)] = self.flat[gather]
        return out, per_text + 1


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n[order], first) if len(first) else n


def counted(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each text, its number ascending, and how often it has them."""
    order = np.lexsort((word, doc))
    doc, word = doc[order], word[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1]))) if len(doc) else order
    return doc[first], word[first], np.diff(np.append(first, len(doc)))


def word_counts(texts: DataFrame, merge: int) -> DataFrame:
    """word (hash, END for the ends), n over all texts of the column `text`."""

    def run(batches):
        keys, counts, held = [], [], 0

        def out():
            key, n = _merged(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for c in chunks(batch.column("text"), lowered):
                key, n = np.unique(np.concatenate([np.maximum(c.word_hash, 1), np.zeros(c.n, np.uint64)]), return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > merge:
                    key, n = _merged(keys, counts)
                    keys, counts, held = [key], [n], len(key)
                    if held > merge // 2:
                        yield out()
                        keys, counts, held = [], [], 0
        if keys:
            yield out()

    return texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Common:
    """Counts of the commonest words, found by the leading bits of their sorted hashes."""

    def __init__(self, key: np.ndarray, n: np.ndarray, total: int, distinct: int, ends: int):
        order = np.argsort(key)
        self.key, self.n = np.append(key[order], np.uint64(0)), np.append(n[order], 0)
        self.first = np.searchsorted(key[order] >> np.uint64(44), np.arange(1 << 20).astype(np.uint64)).astype(np.int32)
        self.longest = int(np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=1).max()) if len(key) else 0
        self.total, self.distinct, self.ends = total, distinct, ends

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for words that are not here."""
        at = self.first[(h >> np.uint64(44)).astype(np.int64)].astype(np.int64)
        out = np.full(len(h), -1)
        open_ = np.arange(len(h))
        for j in range(self.longest):
            k = np.minimum(at[open_] + j, len(self.key) - 1)
            same = self.key[k] == h[open_]
            out[open_[same]] = k[same]
            open_ = open_[~same]
        return out

    def log10(self, n):
        return np.log10((n + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def commonest(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of all words counted at least `least` times, and that least count; at most `most` words."""
    level = F.floor(8 * F.log2("n")).cast("int")
    sizes = {r.level: (r.words, r.least) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()}
    held, least = 0, None
    for k in sorted(sizes, reverse=True):
        held += sizes[k][0]
        if held > most:
            break
        least = sizes[k][1]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 1 << 62
    got = counts.where(F.col("n") >= least).toPandas()
    return got["word"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64), least


class Ids:
    """Stored ids: a text's, its end included, as bytes."""

    def __init__(self, size: int):
        self.kind = np.dtype(np.uint16 if size < 1 << 16 else np.uint32)

    def array(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(sizes)]) * self.kind.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype(self.kind))]).cast(pa.binary())

    def chunks(self, column: pa.Array):
        """(rows, ids, sizes) of about CHUNK_TOKENS tokens each, each text whole."""
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < len(column):
            upto = min(len(column), max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_TOKENS * self.kind.itemsize, side="right")) - 1))
            sizes = np.diff(ends[at : upto + 1]) // self.kind.itemsize
            data = np.frombuffer(column.buffers()[2], self.kind, int(sizes.sum()), int(ends[at])) if sizes.sum() else np.zeros(0, self.kind)
            yield slice(at, upto), data.astype(np.int64), sizes
            at = upto


def summed(texts: DataFrame, size: int, numbers, ids: Ids) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, below `size`, that numbers(ids, sizes) gives for the texts' ids, and how often; `size` bounds all of it."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, flat, sizes in ids.chunks(batch.column("ids")):
                total += np.bincount(numbers(flat, sizes), minlength=size)
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], ["key", "n"])

    got = texts.select("ids").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = (got.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
    order = np.argsort(key)
    return key[order], n[order]


def runs_of(texts: DataFrame, ids: Ids, p: Scoring, turn: int, learners: int) -> DataFrame:
    """learner, place, lead, ids: the runs that a round learns from; lead: whether block + 1 tokens before the run come along."""
    length, lead = p.run_blocks * p.block, p.block + 1

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            for rows, flat, sizes in ids.chunks(batch.column("ids")):
                n = -(-sizes // length)
                text = np.repeat(np.arange(len(sizes)), n)
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                place = mix(mix(keys[rows][text]) + k.astype(np.uint64))
                begin = (np.cumsum(sizes) - sizes)[text] + k * length
                stop = np.minimum(begin + length, np.cumsum(sizes)[text])
                mine = np.flatnonzero(place % np.uint64(p.rounds) == np.uint64(turn))
                if len(mine):
                    parts = [flat[a - (lead if j else 0) : b] for a, b, j in zip(begin[mine].tolist(), stop[mine].tolist(), k[mine].tolist(), strict=True)]
                    learner = (place[mine] // np.uint64(p.rounds) % np.uint64(learners)).astype(np.int32)
                    stored = ids.array(np.concatenate(parts), np.array([len(x) for x in parts]))
                    yield pa.RecordBatch.from_arrays([pa.array(learner), pa.array(place[mine].view(np.int64)), pa.array(k[mine] > 0), stored], ["learner", "place", "lead", "ids"])

    return texts.select("key", "ids").mapInArrow(run, "learner int, place bigint, lead boolean, ids binary")


def _packed(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in sorted(w)]).astype(np.float32)


def _unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def learned_round(model: Attention, texts: DataFrame, ids: Ids, p: Scoring, turn: int, learners: int) -> dict[str, np.ndarray]:
    """The mean of the weights that learners make of the model's on this round's runs."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(model)
    lead = p.block + 1

    def one(parts: list[np.ndarray], leads: list[bool]) -> np.ndarray:
        own = Attention.__new__(Attention)
        own.__dict__ = {**shared.value.__dict__, "w": {k: v.copy() for k, v in shared.value.w.items()}}
        row, begin = own.numbering.row, own.numbering.begin
        sizes, led = np.array([len(a) for a in parts]), np.array(leads)
        flat, first = np.concatenate(parts).astype(np.int64), np.cumsum(sizes) - sizes
        before = np.append(begin, row[flat[:-1]])
        before[first] = begin
        # A run with a lead: its first token is only an input, the others of the lead are context.
        here = np.ones(len(flat), bool)
        here[first[led]] = False
        sizes = sizes - led
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own.train(before[here], flat[here], sizes, at >= np.repeat((lead - 1) * led, sizes), p.least_steps)
        return _packed(own.w)

    def learn(batches):
        one_blas_thread()
        total, weight, now, parts, leads = 0.0, 0, None, [], []

        def closed():
            n = sum(map(len, parts))
            return (one(parts, leads) * np.float64(n), n) if parts else (0.0, 0)

        for batch in batches:
            for k, j, data in zip(*(batch.column(c).to_pylist() for c in ("learner", "lead", "ids")), strict=True):
                if k != now:
                    got, n = closed()
                    total, weight, now, parts, leads = total + got, weight + n, k, [], []
                parts.append(np.frombuffer(data, ids.kind))
                leads.append(j)
        got, n = closed()
        if weight + n:
            yield pa.RecordBatch.from_arrays([pa.array([(total + got).astype(np.float64).tobytes()], pa.binary()), pa.array([weight + n])], ["total", "weight"])

    def added(batches):
        total, weight = 0.0, 0
        for batch in batches:
            for data, n in zip(batch.column("total").to_pylist(), batch.column("weight").to_pylist(), strict=True):
                total, weight = total + np.frombuffer(data), weight + n
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([weight])], ["total", "weight"])

    dealt = runs_of(texts, ids, p, turn, learners).repartition(learners, "learner").sortWithinPartitions("learner", "place")
    # One row for each task, its learners' weights added up; then all are added up in one task, row by row.
    kind = "total binary, weight bigint"
    got = dealt.mapInArrow(learn, kind).repartition(1).mapInArrow(added, kind).collect()
    shared.unpersist()
    return _unpacked(np.frombuffer(got[0].total) / got[0].weight, model.w) if got else model.w


def score_texts(df: DataFrame, path: str, pattern: str, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", p: Scoring = Scoring()) -> DataFrame:
    """One row for each row of df: its id, learned (was it learned from), n_tokens, n_known, train_tokens, base_score, score.

    training: which rows to learn from (default: all). path, pattern: a byte-level vocabulary
    file on every executor and how its tokens split texts.
    """
    kind = df.schema[id_col].dataType.simpleString()
    learned = F.coalesce(training, F.lit(False)) if training is not None else F.lit(True)
    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"), learned.alias("learned"))
    counts = saved(word_counts(rows.where("learned").select("text"), p.merge))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    context = df.sparkSession.sparkContext
    common = context.broadcast(Common(*(found := commonest(counts, p.common))[:2], total, distinct, ends))
    least = found[2]
    ids = Ids(tokenizer(path, pattern).n_vocab)

    def make():
        table = common.value
        subwords = Subwords(path, pattern, len(table.key))

        def one(batch: pa.RecordBatch, c: Chunk) -> pa.RecordBatch:
            h = np.maximum(c.word_hash, 1)
            at = table.find(h)
            here = at >= 0
            base = np.bincount(c.doc[here], table.log10(table.n[at[here]]), c.n)
            known = np.bincount(c.doc[here], minlength=c.n)
            doc, word, times = counted(c.doc[~here], h[~here])
            rare = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=c.n))]).astype(np.int32))
            flat, sizes = subwords(c, at)
            arrays = [batch.column("row_id"), batch.column("learned"), batch.column("key"), pa.array(c.n_words + 1), pa.array(known), pa.array(base, pa.float64()), pa.ListArray.from_arrays(rare, pa.array(word.view(np.int64))), pa.ListArray.from_arrays(rare, pa.array(times)), ids.array(flat, sizes)]
            return pa.RecordBatch.from_arrays(arrays, ["row_id", "learned", "key", "n_tokens", "known", "base", "rare", "times", "ids"])

        return one

    facts = f"row_id {kind}, learned boolean, key bigint, n_tokens bigint, known bigint, base double, rare array<bigint>, times array<bigint>, ids binary"
    keyed = rows.withColumn("key", F.xxhash64(F.coalesce(F.col("row_id").cast("string"), F.lit(""))))
    stored = saved(map_texts(keyed, "text", make, facts, through=lowered)).withColumn("at", F.monotonically_increasing_id())
    model = fit(stored.where("learned"), ids, tokenizer(path, pattern).n_vocab, p)
    shared = context.broadcast(model)

    def judge(batches):
        one_blas_thread()
        for batch in batches:
            for part, flat, sizes in ids.chunks(batch.column("ids")):
                out = batch.slice(part.start, part.stop - part.start)
                columns = [out.column(c) for c in _KEPT]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shared.value.score(flat, sizes))], [*_KEPT, "score"])

    scored = stored.select(*_KEPT, "ids").mapInArrow(judge, f"at bigint, row_id {kind}, learned boolean, n_tokens bigint, known bigint, base double, score double")
    words = stored.select("at", F.explode(F.arrays_zip("rare", "times")).alias("one")).select("at", F.col("one.rare").alias("word"), "one.times")
    table = counts.where((F.col("n") < least) & (F.col("word") != END))
    scale = F.lit(float(total) + 0.1 * (distinct + 1))
    log10 = lambda c: F.log10((c + 0.1) / scale)
    met = words.join(table, "word", "left").groupBy("at").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * log10(F.coalesce("n", F.lit(0)))).alias("more_base"))
    return scored.join(met, "at", "left").select(
        F.col("row_id").alias(id_col), "learned", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + log10(F.lit(float(ends)))).alias("base_score"), "score",
    )


_KEPT = ["at", "row_id", "learned", "n_tokens", "known", "base"]


def fit(texts: DataFrame, ids: Ids, size: int, p: Scoring) -> Attention:
    """The model of all of the texts' ids."""
    shape = Shape(size, dim=p.dim, block=p.block, classes=p.classes, inputs=p.inputs, groups=p.groups)
    key, n = summed(texts, size + 1, lambda flat, sizes: flat, ids)
    counts = np.zeros(size + 1, np.int64)
    counts[key] = n
    numbering = Numbering(shape, counts)
    pair, pair_n = summed(texts, (numbering.columns + 1) * numbering.columns, numbering.pairs, ids)
    model = Attention(numbering, counts, pair, pair_n)
    learners = max(1, -(-int(counts.sum()) // (p.rounds * p.learner_tokens)))
    for turn in range(p.rounds if counts.sum() else 0):
        model.w = learned_round(model, texts, ids, p, turn, learners)
    return model
