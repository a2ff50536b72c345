"""Near duplicates by an inverted join on the coordinates of MinHash signatures.

A text's set is its distinct runs of `words` words (all its words, if fewer). Equal sets are one
node. A node's signature has `coords` coordinates, each the least hash of its set; it is posted
under each coordinate with its value. A pair is a candidate if it collides in at least `matches`
coordinates (at similarity 0.8 exactly, 26 of 48 miss a pair with a chance of 1.3e-5, above it with less), and
linked if the intersection of its full sets is at least `similarity` of their union.

Skip and prefix: postings of one node cannot collide and are skipped; a node with fewer than
`matches` others left is done; of the others only its rarest, all but `matches` - 1, are merged,
since two nodes that collide in `matches` must share one of them. So long lists, as of a passage
that many texts share, are hardly ever merged.

Linking: a list's nodes need not be paired with each other if links already join them. In each
of `rounds` rounds every list with nodes of two components pairs its nodes with one of them, the
hub; links found join components. Then all pairs across components are tested that sizes and
bitmaps of the sets leave possible; a list is cut into blocks for that, so that no task holds its
square. So components are those of all links between candidates.

Defined results: a null, empty or blank text has an empty set, links with nothing and is its own
component; a text of any length is read whole, its set in one task; repeated rows and ids share a
node, a null id counts as no id; among equal ids of a component the rows are alike; an empty table
gives an empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import SMALL_CHUNK, map_texts, saved, whole
from kinmatch.llm.text import Chunk, lowered, mix
from kinmatch.operators.graph import components, tasks_for

_rng = np.random.default_rng(7)
_XOR, _ODD = _rng.integers(0, 1 << 63, 256, dtype=np.uint64), _rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)

#: Nodes of a list in a block, about, where all of a list's pairs are looked at.
BLOCK_NODES = 512
#: Parts of each key where a component may hold many of the rows.
SALT = 16
#: Words of 64 bits in a set's bitmap.
_WORDS = 32


@dataclass(frozen=True)
class NearDup:
    words: int = 5
    similarity: int = 80  # per cent
    coords: int = 48
    matches: int = 26
    rounds: int = 2
    #: Ids or pairs of nodes up to which texts and sets to confirm are picked by broadcast (8 to 32 bytes each), else by shuffle.
    broadcast_nodes: int = 250_000


def sets_of(c: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted in each text, and how many each text has."""
    hashes, doc = c.shingles(words)
    if len(doc) and (np.diff(doc) < 0).any():
        order = np.argsort(doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
    edge = np.searchsorted(doc, np.arange(c.n + 1))
    parts = [np.unique(hashes[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return np.concatenate(parts) if parts else hashes, np.array([len(p) for p in parts], np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, p: NearDup) -> DataFrame:
    """row_id, n, node (a hash of the set, 0 if it is empty), text_key, sig array<bigint>."""

    def make():
        def one(rows: pa.RecordBatch, c: Chunk) -> pa.RecordBatch:
            sets, n = sets_of(c, p.words)
            full = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[full]
            node, sig = np.zeros(c.n, np.uint64), np.zeros((len(full), p.coords), np.uint64)
            if len(full):
                node[full] = mix(np.add.reduceat(mix(sets ^ _XOR[255]), starts) + n[full].astype(np.uint64)) | np.uint64(1)
                for k in range(p.coords):
                    sig[:, k] = mix(np.minimum.reduceat((sets ^ _XOR[k]) * _ODD[k], starts) + np.uint64(k))
            has = np.zeros(c.n + 1, np.int32)
            has[1:] = np.cumsum(n > 0) * p.coords
            arrays = [rows.column("row_id"), pa.array(n), pa.array(_signed(node)), rows.column("text_key"), pa.ListArray.from_arrays(pa.array(has), pa.array(_signed(sig.reshape(-1))))]
            return pa.RecordBatch.from_arrays(arrays, ["row_id", "n", "node", "text_key", "sig"])

        return one

    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(rows.withColumn("text_key", F.xxhash64("text")), "text", make, f"row_id {kind}, n bigint, node bigint, text_key bigint, sig array<bigint>", through=lowered, limit=SMALL_CHUNK)


def full_sets(df: DataFrame, text_col: str, wanted: DataFrame, p: NearDup, small: bool) -> DataFrame:
    """node, set array<bigint> (all 64 bits of the shingle hashes), bits array<bigint> (a bitmap of the set) for the texts of wanted (node, text_key), one for each node."""

    def make():
        def one(rows: pa.RecordBatch, c: Chunk) -> pa.RecordBatch:
            sets, n = sets_of(c, p.words)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            bits = np.zeros((c.n, _WORDS), np.uint64)
            np.bitwise_or.at(bits, (np.repeat(np.arange(c.n), n), ((sets >> np.uint64(26)) % np.uint64(_WORDS)).astype(np.int64)), np.uint64(1) << (sets >> np.uint64(20) & np.uint64(63)))
            words = pa.ListArray.from_arrays(pa.array(np.arange(c.n + 1, dtype=np.int32) * _WORDS), pa.array(_signed(bits.reshape(-1))))
            return pa.RecordBatch.from_arrays([rows.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(sets))), words], ["node", "set", "bits"])

        return one

    texts = df.select(F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    texts = texts.join(F.broadcast(wanted) if small else wanted, "text_key").select("node", "text")
    # Copies of one text: each gives the same set, one of them is kept.
    return map_texts(texts, "text", make, "node bigint, set array<bigint>, bits array<bigint>", through=lowered, limit=SMALL_CHUNK).groupBy("node").agg(F.first("set").alias("set"), F.first("bits").alias("bits"))


def postings(nodes: DataFrame, p: NearDup) -> DataFrame:
    """key, node, n, pull: what is left to merge after skipping and the prefix; pull: how many postings meet the node's."""
    posted = nodes.select(F.explode("sig").alias("key"), "node", "n")
    lists = posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = posted.join(lists, "key").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("size", "key"))).alias("keys"))
    alive = shared.where(F.size("keys") >= p.matches).withColumn("pull", F.aggregate("keys", F.lit(0).cast("bigint"), lambda n, k: n + k["size"]))
    return alive.select(F.explode(F.slice("keys", 1, F.size("keys") - p.matches + 1)).alias("k"), "node", "n", "pull").select("k.key", "node", "n", "pull")


def _with_key_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows joined with facts, one row for each key, on a salted key: a list may be long."""
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def across(rooted: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """a, b: the pairs of different components on a list whose bitmaps leave a link possible.

    An intersection has at most the bits that two bitmaps share, and as many more as the set with
    fewer shared bits has shingles on a bit that another took. Texts of a group of copies that
    changed too much fail this, so they are not paired with the whole group.
    """
    # A long list is cut into blocks, and each two blocks, or a block with itself, meet in a task of their own.
    blocks = F.ceil(F.col("size") / BLOCK_NODES).cast("int")
    open_keys = rooted.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", blocks.alias("blocks"))
    # Higher-order functions, not a term for each word: the code of the join stays small enough to be compiled.
    total = lambda words: F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))
    own = total(F.col("bits"))
    rows = _with_key_facts(rooted, open_keys).join(sets.select("node", "bits"), "node").select("key", "blocks", "node", "root", "n", "bits", (F.col("n") - own).alias("hidden"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    one = rows.withColumn("low", F.col("block")).withColumn("high", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).alias("one")
    two = rows.withColumn("high", F.col("block")).withColumn("low", F.explode(F.sequence(F.lit(0), F.col("block")))).alias("two")
    common = total(F.zip_with("one.bits", "two.bits", lambda x, y: x.bitwiseAND(y))) + F.least("one.hidden", "two.hidden")
    fits = (F.col("one.key") == F.col("two.key")) & (F.col("one.low") == F.col("two.low")) & (F.col("one.high") == F.col("two.high"))
    fits = fits & (F.col("one.root") != F.col("two.root")) & ((F.col("one.low") < F.col("one.high")) | (F.col("one.root") < F.col("two.root")))
    fits = fits & (100 * F.least("one.n", "two.n") >= p.similarity * F.greatest("one.n", "two.n"))
    fits = fits & ((100 + p.similarity) * common >= p.similarity * (F.col("one.n") + F.col("two.n")))
    return one.join(two, fits).select(F.col("one.node").alias("a"), F.col("two.node").alias("b"))


def _judged(df: DataFrame, id_col: str, text_col: str, p: NearDup) -> DataFrame:
    """row_id, text_key, n, root (a node of the component, null for an empty set), component_id and kept for each row of df."""
    docs = saved(signatures(df, id_col, text_col, p))
    nodes = docs.where("n > 0").groupBy("node").agg(F.min("row_id").alias("least"), F.first("n").alias("n"), F.min("text_key").alias("text_key"), F.first("sig").alias("sig"))
    nodes = saved(nodes)
    lists = saved(postings(nodes, p))
    roots = saved(lists.select("node").distinct().withColumn("root", F.col("node")))
    facts = saved(nodes.join(roots.select("node"), "node").select("node", "n", "sig", "text_key"))
    wanted, facts = facts.select("node", "text_key"), facts.drop("text_key")
    sets = saved(full_sets(df, text_col, wanted, p, roots.count() <= p.broadcast_nodes)) if not lists.isEmpty() else None

    def linked(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) of nodes, those whose full sets are similar enough."""
        sides = [facts.select(*(F.col(c).alias(f"{c}_{s}") for c in facts.columns)).withColumnRenamed(f"node_{s}", s) for s in "ab"]
        near = pairs.join(sides[0], "a").join(sides[1], "b")
        near = near.where(100 * F.least("n_a", "n_b") >= p.similarity * F.greatest("n_a", "n_b"))
        near = near.where(F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x)) >= p.matches).select("a", "b", "n_a", "n_b")
        near = saved(near)
        count = near.count()
        near = near.coalesce(tasks_for(count))
        small = F.broadcast if count <= p.broadcast_nodes else lambda x: x
        # Only the sets that a pair needs move, to where its second node is.
        mine = sets.drop("bits").withColumnsRenamed({"node": "a", "set": "set_a"}).join(small(near), "a")
        theirs = sets.drop("bits").withColumnsRenamed({"node": "b", "set": "set_b"}).join(small(near.select("b").distinct()), "b", "left_semi")
        both = mine.join(theirs, "b")
        common = F.size(F.array_intersect("set_a", "set_b"))
        return both.select("a", "b", common.alias("common"), "n_a", "n_b").where(100 * F.col("common") >= p.similarity * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")

    posted, round_no = lists.count(), 0
    # Few postings in many tasks cost shuffle files in every round.
    tasks = tasks_for(posted, 200_000)
    lists, roots, facts = lists.coalesce(tasks), roots.coalesce(tasks), facts.coalesce(tasks)
    while sets is not None:
        rooted = lists.join(roots, "node").persist()
        # First the node that most postings meet, likely the text that others are copies of; then, in each list, another one.
        hub = F.max_by("node", F.struct("pull", "node")) if not round_no else F.min_by("node", F.xxhash64("node", "key", F.lit(round_no)))
        open_lists = rooted.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), hub.alias("hub")).where("low <> high")
        # Pairs across components: half of size^2 less the squares of the components' parts.
        parts = rooted.groupBy("key", "root").agg(F.count("*").alias("part")).groupBy("key").agg(((F.pow(F.sum("part"), 2) - F.sum(F.col("part") * F.col("part"))) / 2).alias("pairs"))
        left = parts.agg(F.sum("pairs"), F.sum(F.lit(1))).first()[0] or 0
        if not left:
            break
        last = round_no >= p.rounds or left <= posted
        if last:
            pairs = across(rooted, sets, p)
        else:
            hubs = open_lists.select("key", "hub").join(roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub")
            pairs = _with_key_facts(rooted, hubs).where("root <> hub_root").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        joined = linked(pairs).join(roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b")
        moved = components(joined.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a <> b"))
        moved = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
        roots = saved(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))).coalesce(tasks)
        rooted.unpersist()
        round_no += 1
        if last:
            break

    # Only nodes with candidates can have another root; a component may hold many of them, so its key is salted.
    named = nodes.select("node", "least").join(roots, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joint = named.join(least, ["root", "salt"]).select("node", "root", "component_id")
    alone = nodes.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"), F.col("least").alias("component_id"))
    of_node = joint.unionByName(alone)
    out = docs.select("row_id", "text_key", "n", "node").join(of_node, "node", "left").withColumn("component_id", F.when(F.col("n") == 0, F.col("row_id")).otherwise(F.col("component_id")))
    return out.select("row_id", "text_key", "n", "root", "component_id", F.col("row_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(df: DataFrame, p: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its id, n_shingles, component_id (the smallest id reachable) and kept."""
    return _judged(df, id_col, text_col, p).select(F.col("row_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def one_of_each(df: DataFrame, p: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows, all columns, one of each component: one with its smallest id (without an id, if none has one).

    Rows are told apart by id and text. A row without words is like nothing and stays; of several
    with one id one stays.
    """
    kept = _judged(df, id_col, text_col, p).where("kept")
    counted = kept.groupBy("root", "row_id", "text_key", (F.col("n") == 0).alias("blank")).agg(F.count("*").alias("kept_rows"))
    # Rows without words and id are all wanted: nothing says that two of them are one.
    loose = F.col("blank") & F.col("row_id").isNull()
    best = F.min(F.struct("text_key", "kept_rows")).alias("best")
    one = counted.where(~loose).groupBy("root", "row_id").agg(best).select("row_id", "best.*", F.lit(False).alias("loose"))
    ids = saved(one.unionByName(counted.where(loose).select("row_id", "text_key", "kept_rows", F.lit(True).alias("loose"))))
    ids = ids.withColumnsRenamed({"row_id": "kept_id", "text_key": "kept_key"})
    few = ids.count() <= p.broadcast_nodes
    text = F.col("row").getField(text_col).cast("string")
    rows = df.select(whole(df).alias("row")).withColumn("own_id", F.col("row").getField(id_col)).withColumn("own_key", F.xxhash64(text))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_key") == F.col("kept_key"))
    wanted = ids.select("kept_id", "kept_key")
    rows = rows.join(F.broadcast(wanted) if few else wanted, same, "left_semi")
    again = ids.where("kept_rows > 1 and not loose").select("kept_id", "kept_key")
    # Usually no id and text has two rows, and then no text is moved.
    if not again.isEmpty():
        shared = rows.join(again, same, "left_semi").dropDuplicates(["own_id", "own_key"])
        rows = rows.join(again, same, "left_anti").unionByName(shared)
    return rows.select("row.*")
