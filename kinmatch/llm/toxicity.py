"""Toxicity by noisy-channel deobfuscation: restore disguised words, then score the text.

Learning, from all labelled rows that may be learned from: a lexicon of words and word beginnings that toxic texts have far more often (log odds,
pruned by z score and number of texts), a character language model of order 4, and a logistic
regression of the label on what the lexicon finds in the restored text.

Scoring: words that mix letters with look-alikes (1d10t), separators (s.t.u.p.i.d), doubled or
longer runs of a letter (morooon), and runs of single letters (c l o w n) span a lattice of plain
readings; a Viterbi search takes the likeliest under the character model and the channel's costs.
Between single letters and at separators a word may end, so that the reading of `a c l o w n` is two
words; every one is looked up. No run or word is too long: a search takes time in proportion to
its length. What was written stays in the text too: a reading can add hits, not remove them.

Size: the driver holds and tasks get the character runs of up to four of the labelled rows' words,
which grow far slower than the texts, and the lexicon, at most the features of a text over
`least_share`. Facts of texts stay in tasks: each step of the regression sums them there, in whole
numbers, so that the model does not depend on partitions.

Defined results: a null or empty text has no hits and gets the base score of such a text; a text of
any length is scored whole; of readings as likely the first found is taken, always the same;
without labelled rows of both kinds every score is the share of toxic rows (0 without any); a null
label or id is not learned from, and of several labels of an id the highest counts; repeated rows
score alike; an empty table gives an empty one; other columns are not read, whatever their names.
Scoring is one pass over the rows, no shuffle; learning moves the texts once, to their labels.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import SMALL_CHUNK, given_back, map_texts, saved, whole
from kinmatch.llm.text import Chunk, lowered
from kinmatch.operators.graph import tasks_for

#: Letters that look-alikes can stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
_JOINS = ".-_*"
#: Words decoded are kept up to this number, and this length.
CACHE_WORDS, CACHE_CHARS = 100_000, 40
#: Probabilities of characters kept: a Python worker holds them as long as the model.
CACHE_RUNS = 300_000
#: Distinct words whose character runs are counted at a time.
SPELLED_WORDS = 20_000


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_LETTER = _mask("abcdefghijklmnopqrstuvwxyz")
_LETTER[0x80:] = True
_DIGIT, _LEET, _JOIN = _mask("0123456789"), _mask("".join(LEET)), _mask(_JOINS)
_SOLID, _EDGE, _ASCII_LETTER = _LETTER | _DIGIT, _mask("$@"), _LETTER & (np.arange(256) < 0x80)
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class Toxicity:
    #: Times that a word counts for the character model, at most: common words would drown the others.
    most_times: int = 20
    least_texts: int = 4
    least_share: float = 0.02  # of the toxic texts
    least_z: float = 3.0
    prefixes: tuple[int, ...] = (4, 5, 6, 7)  # bytes
    swap_cost: float = 0.5
    drop_cost: float = 0.3
    literal_cost: float = 4.0
    double_cost: float = 3.0  # one letter of two alike
    alone_cost: float = 4.0  # the end of a word of one letter, at most


# -- the character model and the channel ---------------------------------------------------------


def grams_of(words: Counter, order: int = 4) -> Counter:
    """Counts of character runs of 1 to `order`, words marked ^^^ before and $ after."""
    out: Counter = Counter()
    for word, n in words.items():
        marked = "^^^" + word + "\x00"
        for k in range(3, len(marked)):
            for m in range(order):
                out[marked[k - m : k + 1]] += n
                out["|" + marked[k - m : k]] += n
    return out


def packed_grams(words: list[str], times: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The character runs of grams_of without the contexts, which are what is before their last characters, and their counts."""
    codes = np.frombuffer("".join(f"^^^{w}\x00" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    if len(alphabet) >= 1 << 16:  # more than a number of 64 bits holds four of
        grams = {g: n for g, n in grams_of(Counter(dict(zip(words, times.tolist(), strict=True)))).items() if g[0] != "|"}
        return list(grams), np.array(list(grams.values()), np.int64)
    number = np.zeros(0x110000, np.uint64)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    ids, size = number[codes], np.array([len(w) + 1 for w in words], np.int64)
    # Every character of a word and its end; three marks stand before each word.
    last = np.arange(int(size.sum())) + np.repeat(3 * np.arange(1, len(words) + 1), size)
    key, n = sum(ids[last - m] << np.uint64(16 * m) for m in range(4)), np.repeat(times, size)
    grams, counts = [], []
    chars = ["", *map(chr, alphabet.tolist())]
    for m in (3, 2, 1, 0):
        key &= np.uint64((1 << 16 * (m + 1)) - 1)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key, n = key[first], np.add.reduceat(n[order], first) if len(first) else n
        grams += ["".join(chars[k >> 16 * j & 0xFFFF] for j in range(m, -1, -1)) for k in key.tolist()]
        counts.append(n)
    return grams, np.concatenate(counts)


class CharModel:
    """log P(c | up to 3 characters before), longer contexts where they were seen."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.cache: dict[str, float] = {}

    def logp(self, context: str, c: str) -> float:
        key = context + c
        got = self.cache.get(key)
        if got is None:
            p = 1e-4
            for m in range(4):
                before = context[3 - m :]
                total = self.counts.get("|" + before, 0)
                if total:
                    p = (self.counts.get(before + c, 0) + 2.0 * p) / (total + 2.0)
            if len(self.cache) >= CACHE_RUNS:
                self.cache.clear()
            got = self.cache[key] = math.log(p)
        return got


def decode(word: str, lm: CharModel, p: Toxicity, spaced: bool = False) -> str:
    """The likeliest plain reading of a lower-case word, several words with spaces between them if it ends at a separator.

    spaced: the letters stood alone, so a word may end after each.
    """
    runs: list[tuple[str, int]] = []
    for c in word:
        if runs and runs[-1][0] == c:
            runs[-1] = (c, runs[-1][1] + 1)
        else:
            runs.append((c, 1))
    # Of each context the best score and its reading, as a chain of characters from the last one.
    states: dict[str, tuple[float, tuple | None]] = {"^^^": (0.0, None)}
    known = lm.cache

    def end(s: str) -> float:
        cost = lm.logp(s, "\x00")
        return max(cost, -p.alone_cost) if s[:2] == "^^" != s[1:] else cost

    def take(states, c: str):
        out: dict[str, tuple[float, tuple | None]] = {}
        for s, (score, chain) in states.items():
            if c == " ":
                if s == "^^^":
                    continue
                to, now = "^^^", score + end(s)
            else:
                run = s + c
                p_run = known.get(run)
                to, now = run[-3:], score + (lm.logp(s, c) if p_run is None else p_run)
            if to not in out or out[to][0] < now:
                out[to] = (now, (chain, c))
        return out

    for i, (c, n) in enumerate(runs):
        if n == 1 and not spaced and c not in LEET and c not in _JOINS:  # stands for itself alone
            states = take(states, c)
            continue
        options: list[tuple[str, float]] = []
        if c in LEET:
            options += [(x * k, p.swap_cost * k) for x in LEET[c] for k in ((1, 2) if n > 1 else (1,))]
            options.append((c * n, p.literal_cost * n))
        elif c in _JOINS:
            options += [("", p.drop_cost), (" ", p.drop_cost), (c * n, p.literal_cost * n)]
        elif n > 2:
            options += [(c, p.drop_cost), (c * 2, p.drop_cost)]
        else:
            options += [(c * n, 0.0)] + [(c, p.double_cost)] * (n == 2)
        if spaced:
            options += [(f"{x[0]} {x[1:]}", cost) for x, cost in options if len(x) == 2]
            options += [(x + " ", cost) for x, cost in options if i + 1 < len(runs) and x and x != " "]
        reached: dict[str, tuple[float, tuple | None]] = {}
        for text, cost in options:
            now = states
            for x in text:
                now = take(now, x)
            for s, v in now.items():
                if s not in reached or reached[s][0] < v[0] - cost:
                    reached[s] = (v[0] - cost, v[1])
        states = reached
    chain, out = max(states.items(), key=lambda s: s[1][0] + (end(s[0]) if s[0] != "^^^" else 0.0))[1][1], []
    while chain is not None:
        chain, c = chain
        out.append(c)
    return "".join(reversed(out))


# -- words, features and hits ---------------------------------------------------------------------


@dataclass
class Words:
    """The cores of a chunk's words, without symbols around them, and the disguised ones."""

    start: np.ndarray
    stop: np.ndarray
    disguised: np.ndarray
    spaced: list[tuple[int, int]] = field(default_factory=list)  # runs of words that are single letters


def words_of(c: Chunk) -> Words:
    d, n = c.data, len(c.data)

    def count(mask: np.ndarray) -> np.ndarray:
        """How many bytes of mask are before each byte; 32 bits are enough for an Arrow column's text in a chunk."""
        out = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
        np.cumsum(mask, out=out[1:])
        return out

    solid = _SOLID[d]
    before, at = count(solid), np.append(np.flatnonzero(solid), n)
    start, upto = at[before[c.starts]], before[c.stops]
    stop = np.where(upto > 0, at[upto - 1] + 1, 0)
    empty = start >= stop
    start, stop = np.where(empty, c.starts, start), np.where(empty, c.starts, stop)
    # $ and @ stand for letters at the edges of a word, unless they are many.
    lead = ~empty & (start - c.starts == 1) & _EDGE[d[np.minimum(c.starts, max(0, n - 1))]] if n else empty
    start = start - lead
    tail = ~empty & (c.stops - stop <= 2) & (c.stops > stop) & _EDGE[d[np.minimum(stop, max(0, n - 1))]] if n else empty
    stop = np.where(tail, c.stops, stop)
    same = np.zeros(n, bool)
    if n > 1:
        same[1:] = (d[1:] == d[:-1]) & _ASCII_LETTER[d[1:]]
    per = lambda mask, x=start, y=stop: (lambda s: s[y] - s[x])(count(mask))
    letters, leet, joins = per(_LETTER[d]), per(_LEET[d]), per(_JOIN[d])
    disguised = ((leet > 0) & (letters > 0)) | ((joins >= 1) & (letters > 0) & (letters + leet >= 3)) | ((joins >= 2) & (leet >= 3)) | (per(same, np.minimum(start + 1, stop)) > 0)
    # A letter may have several bytes, all but the first of the form 10xxxxxx.
    single = (per(_FIRST_BYTE[d]) == 1) & (letters + leet == stop - start)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    spaced = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= 2]
    return Words(start, stop, np.flatnonzero(disguised & ~single), spaced)


def feature_hashes(c: Chunk, start: np.ndarray, stop: np.ndarray, p: Toxicity) -> list[np.ndarray]:
    """For each word its hash, then those of its beginnings (0 if it is not longer)."""
    out = [c.span_hash(start, stop)]
    for k in p.prefixes:
        out.append(np.where(stop - start > k, c.span_hash(start, np.minimum(stop, start + k)) ^ np.uint64(0x5BD1E995), np.uint64(0)))
    return out


def _plain(words: list[str]) -> Chunk:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in data], dtype=np.int64)
    return Chunk(slice(0, len(data)), np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends)


class Restorer:
    """Readings of disguised words, remembered."""

    def __init__(self, lm: CharModel, p: Toxicity):
        self.lm, self.p, self.known = lm, p, {}

    def __call__(self, word: str, spaced: bool = False) -> list[str]:
        """The words of the likeliest reading."""
        got = self.known.get((word, spaced))
        if got is None:
            got = decode(word, self.lm, self.p, spaced).split()
            if len(word) <= CACHE_CHARS:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                self.known[word, spaced] = got
        return got

    def readings(self, c: Chunk, w: Words) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words of readings that differ from what stands there; then, in the order of the text, which of them are read, and in which texts."""
        data, doc = c.data.tobytes(), c.doc
        start, stop = w.start[w.disguised], w.stop[w.disguised]
        _, at, back = np.unique(c.span_hash(start, stop), return_index=True, return_inverse=True)
        words, size = [], []
        for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True):
            x = data[a:b].decode("utf-8", "ignore")
            plain = [y for y in self(x) if y != x]
            words += plain
            size.append(len(plain))
        size = np.array(size, np.int64)
        times = size[back]
        which = np.repeat((np.cumsum(size) - size)[back], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        docs, more = np.repeat(doc[w.disguised], times), []
        for a, b in w.spaced:
            cuts = [a, *(k for k in range(a + 1, b) if doc[k] != doc[k - 1]), b]
            for x, y in zip(cuts, cuts[1:]):
                if y - x >= 2:
                    plain = self(b"".join(data[w.start[k] : w.stop[k]] for k in range(x, y)).decode("utf-8", "ignore"), True)
                    words += plain
                    more += [doc[x]] * len(plain)
        which = np.append(which, np.arange(len(words) - len(more), len(words)))
        return words, which, np.append(docs, np.array(more, np.int64))


class Places:
    """Where hashes stand among sorted ones; few that are not there are searched for."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.flags = keys, np.zeros(1 << 20, bool)
        self.flags[(keys >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are there, and where."""
        maybe = np.flatnonzero(self.flags[(h >> np.uint64(44)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == h[maybe]
        return maybe[ok], at[ok]


@dataclass
class Model:
    lm: CharModel
    features: np.ndarray
    odds: np.ndarray
    weights: np.ndarray
    base: float
    p: Toxicity

    def __post_init__(self):
        self.places = Places(self.features)

    def hits(self, c: Chunk, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The highest log odds of each word's features, 0 if none is in the lexicon."""
        out = np.zeros(len(start))
        if not len(self.features):
            return out
        for h in feature_hashes(c, start, stop, self.p):
            word, at = self.places(h)
            out[word] = np.maximum(out[word], self.odds[at])
        return out

    def facts(self, c: Chunk, restore: Restorer) -> np.ndarray:
        """For each text: highest and summed log odds, hits, and hits for each 100 words."""
        w = words_of(c)
        odds, doc = self.hits(c, w.start, w.stop), c.doc
        plain, which, plain_doc = restore.readings(c, w)
        if plain:
            more = _plain(plain)
            odds, doc = np.concatenate([odds, self.hits(more, more.begin, more.end)[which]]), np.concatenate([doc, plain_doc])
        hit = odds > 0
        top = np.zeros(c.n)
        np.maximum.at(top, doc[hit], odds[hit])
        total, n = np.bincount(doc[hit], odds[hit], c.n), np.bincount(doc[hit], minlength=c.n)
        return np.column_stack([top, np.log1p(total), np.log1p(n), np.minimum(20, 100 * n / np.maximum(1, c.n_words))])

    def score(self, facts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(facts @ self.weights + self.base, -30, 30)))


#: Sums are of whole parts of this size, so that their order does not matter.
_PARTS = 1 << 36


def logistic(seen: DataFrame, names: list[str], label: str, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method; each step is one pass over seen."""
    k = len(names) + 1
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = np.zeros(k)

    def step_sums(at: np.ndarray):
        def run(batches):
            for batch in batches:
                a = [batch.column(c).to_numpy(zero_copy_only=False) for c in names] + [np.ones(batch.num_rows)]
                z = sum(x * v for x, v in zip(a, at, strict=True))
                q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                off, bend = batch.column(label).to_numpy(zero_copy_only=False) - q, q * (1 - q)
                terms = [a[i] * a[j] * bend for i, j in pairs] + [x * off for x in a]
                yield pa.RecordBatch.from_arrays([pa.array([int(np.rint(t * _PARTS).astype(np.int64).sum())], pa.int64()) for t in terms], [f"s{n}" for n in range(len(terms))])

        return run

    for _ in range(30):
        fields = [f"s{n}" for n in range(len(pairs) + k)]
        sums = seen.mapInArrow(step_sums(w), ", ".join(f"{f} bigint" for f in fields)).agg(*(F.sum(F.col(f).cast("decimal(38,0)")).alias(f) for f in fields)).first()
        values = [float(sums[f]) / _PARTS for f in fields]
        bend = np.zeros((k, k))
        for (i, j), v in zip(pairs, values, strict=False):
            bend[i, j] = bend[j, i] = v
        step = np.linalg.solve(bend + np.diag(np.append(np.full(k - 1, ridge), 1e-6)), np.array(values[len(pairs) :]) - ridge * np.append(w[:-1], 0))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _chosen(labels: DataFrame, id_col: str, label_col: str, learn: Column | None) -> DataFrame:
    """row_id, label (0 or 1): of each id that may be learned from."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    chosen = chosen.where(learn) if learn is not None else chosen
    return chosen.select(F.col(id_col).alias("row_id"), (F.col(label_col) > 0).cast("int").alias("label")).groupBy("row_id").agg(F.max("label").alias("label"))


def _counted(rows: DataFrame, p: Toxicity, wanted: Broadcast | None = None) -> DataFrame:
    """word, feature, n: how often the texts have each plain word, and in how many of them each feature (of those wanted) is."""

    def make():
        def one(batch: pa.RecordBatch, c: Chunk) -> pa.RecordBatch:
            w = words_of(c)
            hashes, data = feature_hashes(c, w.start, w.stop, p), c.data.tobytes()
            _, at, times = np.unique(hashes[0], return_index=True, return_counts=True)
            words: Counter = Counter()
            for a, b, n in zip(w.start[at].tolist(), w.stop[at].tolist(), times.tolist(), strict=True):
                if len(x := data[a:b].decode("utf-8", "ignore")) > 1 and x.isalpha():
                    words[x] += n
            keys, counts = [], []
            for h in hashes:
                doc = c.doc
                if wanted is not None:
                    at = wanted.value(h)[0]
                    h, doc = h[at], doc[at]
                # Texts stay in order among equal hashes.
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                h = h[(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)) & (h != 0)]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                keys.append(h[first])
                counts.append(np.diff(np.append(first, len(h))))
            key, n = np.concatenate(keys), np.concatenate([*counts, np.array(list(words.values()), np.int64)])
            feature = np.concatenate([key.view(np.int64), np.zeros(len(words), np.int64)])
            return pa.RecordBatch.from_arrays([pa.array([None] * len(key) + list(words), pa.string()), pa.array(feature), pa.array(n)], ["word", "feature", "n"])

        return one

    counted = map_texts(rows, "text", make, "word string, feature bigint, n bigint", through=lowered)
    return counted.groupBy("word", "feature").agg(F.sum("n").alias("n"))


def _spelled(words: DataFrame) -> CharModel:
    """The character model of words (word, n)."""

    def run(batches):
        held, some = 0, []

        def out():
            grams, n = packed_grams([w for b in some for w in b.column("word").to_pylist()], np.concatenate([b.column("n").to_numpy(zero_copy_only=False) for b in some]))
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["gram", "n"])

        for batch in batches:
            some.append(batch)
            held += batch.num_rows
            if held >= SPELLED_WORDS:
                yield out()
                held, some = 0, []
        if held:
            yield out()
        some = batch = None
        given_back()

    counts: Counter = Counter()
    for r in words.mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.gram] += r.n
        counts["|" + r.gram[:-1]] += r.n
    return CharModel(dict(counts))


def _lexicon(df: DataFrame, chosen: DataFrame, p: Toxicity, id_col: str, text_col: str) -> tuple[Model, DataFrame]:
    """A model, with weights only where labels of both kinds are missing, and the persisted rows (text, label) that it is of.

    Clean texts are only asked for features that enough toxic ones have.
    """
    texts = df.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    # By shuffle whatever the size: few labels today are many tomorrow.
    rows = texts.join(chosen.hint("shuffle_hash"), "row_id").select("text", "label").persist()
    share = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = share.get(1, 0), share.get(0, 0)
    least = max(p.least_texts, math.ceil(p.least_share * n_toxic))
    toxic = _counted(rows.where("label = 1"), p).persist()
    got = toxic.where(F.col("feature") != 0).where(F.col("n") >= least).select("feature", "n").toPandas()
    features = got["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(features)
    features, in_toxic = features[order], got["n"].to_numpy(np.int64)[order]
    places = Places(features)
    clean = _counted(rows.where("label = 0"), p, df.sparkSession.sparkContext.broadcast(places)).persist()
    got = clean.where(F.col("feature") != 0).select("feature", "n").toPandas()
    in_clean = np.zeros(len(features), np.int64)
    word, at = places(got["feature"].to_numpy(np.int64).view(np.uint64))
    in_clean[at] = got["n"].to_numpy(np.int64)[word]
    # Each word's count is that of all rows before it is cut, so the model does not depend on batches.
    words = toxic.unionByName(clean).where(F.col("word").isNotNull()).groupBy("word").agg(F.least(F.sum("n"), F.lit(p.most_times)).alias("n"))
    model = Model(_spelled(words), np.zeros(0, np.uint64), np.zeros(0), np.zeros(4), -30.0, p)
    toxic.unpersist()
    clean.unpersist()
    if not n_toxic or not n_clean:
        of_toxic = n_toxic / max(1, n_toxic + n_clean)
        model.base = math.log(of_toxic / (1 - of_toxic)) if 0 < of_toxic < 1 else (30.0 if of_toxic else -30.0)
        return model, rows
    odds = np.log((in_toxic + 0.5) / (n_toxic + 1)) - np.log((in_clean + 0.5) / (n_clean + 1))
    keep = odds / np.sqrt(1 / (in_toxic + 0.5) + 1 / (in_clean + 0.5)) >= p.least_z
    return Model(model.lm, features[keep], odds[keep], model.weights, 0.0, p), rows


_FACTS = ["a", "b", "c", "d"]


def _facts(df: DataFrame, model: Model, keep: str, kind: str) -> DataFrame:
    """The column keep of df (text and others), with the facts of its texts."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        restore = Restorer(shared.value.lm, shared.value.p)

        def one(batch: pa.RecordBatch, c: Chunk) -> pa.RecordBatch:
            x = shared.value.facts(c, restore)
            return pa.RecordBatch.from_arrays([batch.column(keep), *(pa.array(x[:, k]) for k in range(4))], [keep, *_FACTS])

        return one

    return map_texts(df, "text", make, f"{keep} {kind}, " + ", ".join(f"{c} double" for c in _FACTS), through=lowered, limit=SMALL_CHUNK)


def _weighed(model: Model, seen: DataFrame) -> Model:
    """model with the weights that the rows of seen (label, facts) teach; as it is if they have one label."""
    seen = saved(seen)
    if seen.select("label").distinct().count() < 2:
        return model
    # Few rows in many tasks cost a Python task each in every step.
    weights, base = logistic(seen.coalesce(tasks_for(seen.count(), 200_000)), _FACTS, "label")
    return Model(model.lm, model.features, model.odds, weights, base, model.p)


def fit(df: DataFrame, labels: DataFrame, p: Toxicity = Toxicity(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None) -> Model:
    """Learns from all rows of df with a label; learn: which of the labels' rows (default: all)."""
    model, rows = _lexicon(df, _chosen(labels, id_col, label_col, learn), p, id_col, text_col)
    model = _weighed(model, _facts(rows, model, "label", "int"))
    rows.unpersist()
    return model


def fit_and_score(df: DataFrame, labels: DataFrame, p: Toxicity = Toxicity(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None) -> DataFrame:
    """What score() gives with the model of fit(), but each text is restored and looked up once, for both."""
    chosen = _chosen(labels, id_col, label_col, learn)
    model, rows = _lexicon(df, chosen, p, id_col, text_col)
    rows.unpersist()
    kind = df.schema[id_col].dataType.simpleString()
    found = saved(_facts(df.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text")), model, "row_id", kind))
    model = _weighed(model, found.join(chosen.hint("shuffle_hash"), "row_id").select("label", *_FACTS))

    def judge(batches):
        for batch in batches:
            facts = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _FACTS])
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(model.score(facts))], ["row_id", "score"])

    model = Model(CharModel({}), np.zeros(0, np.uint64), np.zeros(0), model.weights, model.base, p)
    return _named(found.mapInArrow(judge, f"row_id {kind}, score double"), id_col)


def _apply(df: DataFrame, text_col: str, model: Model, schema, out, inside: str | None = None) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        restore = Restorer(m.lm, m.p)
        return lambda rows, c: out(rows, m.score(m.facts(c, restore)))

    return map_texts(df, text_col, make, schema, lowered, inside, SMALL_CHUNK)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its id, score (0 to 1) and predicted (1 from 0.5 on)."""
    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"row_id {df.schema[id_col].dataType.simpleString()}, score double"
    out = _apply(rows, "text", model, schema, lambda rows, s: pa.RecordBatch.from_arrays([rows.column("row_id"), pa.array(s)], ["row_id", "score"]))
    return _named(out, id_col)


def _named(scored: DataFrame, id_col: str) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumnRenamed("row_id", id_col)


def without_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df's rows, all columns, that are not predicted toxic."""
    rows = df.select(whole(df).alias("row"))
    return _apply(rows, text_col, model, rows.schema, lambda rows, s: rows.filter(pa.array(s < 0.5)), "row").select("row.*")
