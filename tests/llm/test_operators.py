"""Each operator against a brute-force version, and on nulls, empty and repeated rows and empty tables."""

import itertools
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinmatch.llm import chat, common, decontam, lm_scores, mixing, near_dup, quality, queries, sharding, token_counts, toxicity, url_rules
from kinmatch.llm.queries import URL_RULES
from kinmatch.llm.text import chunks, lowered

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(4)
VOCABULARY = ["".join(RNG.choice("abcdefgéñß") for _ in range(RNG.randint(1, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def documents(spark, rows):
    """Rows of (doc_id, text), with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", 1, True) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_tokens int, kept boolean")


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "b c"), (5, "x " * 5000), (6, "Zeile eins.\nZeile eins.\n\n"), (7, "ünï 漢字 😀 <|endoftext|>")]


def test_words_and_hashes_equal_plain_ones():
    texts = [t for _, t in EDGE] + [prose(k, k) for k in range(40)]
    for limit in (1, 64, 1 << 20):
        got, seen = [], {}
        for c in chunks(pa.array(texts, pa.string()), lowered, limit):
            data = c.data.tobytes().decode()
            assert data.encode() == c.data.tobytes()
            for d in range(c.n):
                words = [c.data[a:b].tobytes().decode() for a, b in zip(c.starts[c.first[d] : c.first[d + 1]], c.stops[c.first[d] : c.first[d + 1]])]
                got.append(words)
                for w, h in zip(words, c.word_hash[c.first[d] : c.first[d + 1]]):
                    assert seen.setdefault(w, h) == h
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        assert got == [WORD.findall((t or "").translate(low)) for t in texts]
        assert len(set(seen.values())) == len(seen)


# -- 1 --


def test_url_rules_and_mined_rules(spark):
    urls = [(1, "http://A.B.example.COM/en/7x?y"), (2, "https://com/en/1"), (3, "http://xcom/en/1"), (4, None), (5, "no scheme"), (6, "http://example.net/de/81#f"), (6, "http://example.net/de/81#f"), (7, "x://h://p/q"), (8, "http://shop.org/es")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in urls], "page_id bigint, url string, verdict string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df, URL_RULES).collect())
    assert got == Counter({
        (1, "a.b.example.com", "/en/7x", "example.com/en/7", "allow"): 1, (2, "com", "/en/1", "com/en/", "block"): 1, (3, "xcom", "/en/1", None, "block"): 1, (4, "", "", None, "allow"): 1,
        (5, "", "", None, "allow"): 1, (6, "example.net", "/de/81", "example.net/de/8", "block"): 2, (7, "h:", "//p/q", None, "allow"): 1, (8, "shop.org", "/es", None, "allow"): 1,
    })
    assert url_rules.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_each_curated_rule_has_the_word_of_the_contract(spark):
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r.text: r.verdict for r in URL_RULES} == contract
    urls = {"http://b.com/en/1": "com/en/", "http://example.com/en/7": "example.com/en/7", "http://b.net/de/1": "net/de/", "http://a.example.net/de/7": "net/de/", "http://example.net/de/8": "example.net/de/8", "http://b.org/es/1": "org/es/"}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(df, URL_RULES).collect()}
    assert got == {k: (rule, contract[rule]) for k, rule in enumerate(urls.values())}


def test_mined_rules_equal_counted_subsets(spark):
    r = random.Random(1)
    rows = [(sorted(r.sample(range(5), r.randint(1, 4))), r.choice(["block", "allow"])) for _ in range(60)]
    mined = url_rules.mine(spark.createDataFrame(rows, "groups array<int>, label string"), url_rules.Mining(0.05, 0.6)).collect()
    every = {}
    for k in range(1, 5):
        for ante in itertools.combinations(range(5), k):
            has = [label for t, label in rows if set(ante) <= set(t)]
            for v in ("block", "allow"):
                share = [label for _, label in rows].count(v) / 60
                if has and has.count(v) >= 0.05 * 60 and has.count(v) / len(has) >= max(0.6, share + 1e-12):
                    every[ante, v] = has.count(v) / len(has)
    want = {(ante, v): round(c, 9) for (ante, v), c in every.items() if not any(every.get((ante[:k] + ante[k + 1 :], v), -1) >= c for k in range(len(ante)))}
    assert {(tuple(sorted(x.antecedent)), x.verdict): round(x.confidence, 9) for x in mined} == want and want
    assert url_rules.mine(spark.createDataFrame([], "groups array<int>, label string"), url_rules.Mining()).count() == 0


def test_grown_rules_are_those_of_all_sets_beyond_the_width(spark):
    r = random.Random(3)
    rows = [(sorted(r.sample(range(7), r.randint(1, 6))), r.choice(["block", "block", "allow"])) for _ in range(80)]
    # Group 20 tells allowed URLs, but stands behind more groups than the width; so do groups that always come together.
    rows += [([*range(7), 9, 10, 11, 12, 13, 14, 20], "allow")] * 9 + [([*range(7), 9, 10, 11, 12, 13, 14], "block")] * 9
    df = spark.createDataFrame(rows, "groups array<int>, label string")
    rules = [{(tuple(x.antecedent), x.verdict, round(x.confidence, 9), x.support) for x in url_rules.mine(df, url_rules.Mining(0.05, 0.6, width)).collect()} for width in (12, 99)]
    assert rules[0] == rules[1] and ((20,), "allow", 1.0, 9) in rules[0] and any(len(x[0]) > 1 for x in rules[0])


def test_mined_rules_decide_urls_without_a_curated_rule(spark):
    urls = [f"http://s{k}.example.com/en/{k % 10}/{'good' if k % 10 == 7 else 'bad'}" for k in range(200)]
    urls += ["http://a.fr/x/good", "http://a.fr/x/bad", "http://a.fr/x/other"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(df, URL_RULES).collect()}
    assert [got[k] for k in (200, 201, 202)] == [(None, "allow"), (None, "block"), (None, "allow")]
    assert sum(v == "allow" for r, v in got.values() if r) == 20


def test_long_and_repeated_urls_are_mined_in_bounded_work(spark):
    long = "http://example.com/en/1/" + "/".join(f"w{k}" for k in range(60))
    r = random.Random(2)
    mixed = ["http://example.net/de/" + "/".join(f"v{k}" for k in range(40) if r.random() < 0.8) for _ in range(60)]
    huge = "http://a.org/" + "z" * 2_000_000
    rows = [long] * 60 + mixed + [huge, None, "", "http://a.b/w3", "http://a.b/en/7"] + ["http://example.com/en/7"] * 9
    df = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(df, URL_RULES).collect()}
    assert len(got) == len(rows) and got[0] == ("com/en/", "block") and got[60][1] == "block" and got[120] == (None, "allow")
    # A word of the repeated URL tells blocked ones; the number of the allowed ones allowed ones.
    assert got[123] == (None, "block") and got[124] == (None, "allow")


# -- 2 --

VOCAB = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_scores_equal_counted_base(spark):
    rows = EDGE + [(k, prose(30, k)) for k in range(10, 60)]
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    p = lm_scores.Scoring(common=8, dim=4, classes=16, inputs=32, least_steps=3)
    df = documents(spark, rows)
    got = lm_scores.score_texts(df, VOCAB, public_tokenizers.PATTERN, learn, p=p).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, WORD.findall((t or "").translate(low)) + ["\0end"]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if i is not None and i % 3 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)) for i, ws in tokens)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    # Neither the broadcast words nor the partitions change a result.
    scores = sorted((r.doc_id or 0, round(r.score, 3)) for r in got)
    other = lm_scores.score_texts(df.repartition(3), VOCAB, public_tokenizers.PATTERN, learn, p=lm_scores.Scoring(common=1000, dim=4, classes=16, inputs=32, least_steps=3)).collect()
    assert sorted((r.doc_id or 0, round(r.score, 3)) for r in other) == scores
    assert lm_scores.score_texts(df.limit(0), VOCAB, public_tokenizers.PATTERN, p=p).count() == 0
    unlearned = lm_scores.score_texts(df, VOCAB, public_tokenizers.PATTERN, F.lit(False), p=p).collect()
    assert len(unlearned) == len(rows) and {r.train_tokens for r in unlearned} == {0} and all(r.score < 0 for r in unlearned)


def tiny_model(dim=4, block=2, classes=8, inputs=6, ids=14, seed=1, texts=None):
    from kinmatch.llm.attention import Attention, Numbering, Shape

    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 12, 30)
    flat = rng.integers(0, ids, sizes.sum()) ** 2 // ids
    flat[np.cumsum(sizes) - 1] = ids
    if texts is not None:
        flat, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    counts = np.bincount(flat, minlength=ids + 1)
    numbering = Numbering(Shape(ids, dim=dim, block=block, classes=classes, inputs=inputs), counts)
    pair, n = np.unique(numbering.pairs(flat, sizes), return_counts=True)
    return Attention(numbering, counts, pair, n), flat, sizes


def plain_log10(model, text, flat, sizes):
    """The probability of a text, token by token, from the counts of the texts (flat, sizes) and the weights."""
    w, num, shape = model.w, model.numbering, model.shape
    follows = Counter()
    for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes)):
        for k in range(a, b):
            follows[num.begin if k == a else num.row[flat[k - 1]], flat[k]] += 1
    count = Counter(flat.tolist())
    every = range(shape.ids + 1)
    smoothed = {i: count[i] + 0.1 for i in every}
    total, out = sum(smoothed.values()), 0.0
    rows = [num.begin, *num.row[text[:-1]]]
    for at, token in enumerate(text):
        # Keys: the token's block up to it, and the block before.
        first = max(0, at // shape.block * shape.block - shape.block)
        x = w["e"][rows].astype(float)
        q = x[at] @ w["q"]
        s = [q @ (x[j] @ w["k"]) / shape.dim**0.5 + w["r"][at - j] for j in range(first, at + 1)]
        a = np.exp(s) / np.exp(s).sum()
        z = sum(p * (x[j] @ w["v"]) for p, j in zip(a, range(first, at + 1)))
        h = x[at] + z @ w["o"]
        n_row = sum(n for (r, _), n in follows.items() if r == rows[at])
        logits = []
        for k in range(shape.classes):
            share = sum(smoothed[i] for i in every if num.klass[i] == k) / total
            n = sum(n for (r, i), n in follows.items() if r == rows[at] and num.klass[i] == k)
            with np.errstate(divide="ignore"):
                logits.append(h @ w["u"][:, k] + w["c"][k] + np.log((n + shape.class_smooth * share) / (n_row + shape.class_smooth)))
        p = np.exp(logits) / np.exp(logits).sum()
        mates = [i for i in every if num.klass[i] == num.klass[token]]
        column = [i for i in mates if num.row[i] == num.row[token]]
        n = sum(follows[rows[at], i] for i in column)
        n_class = sum(follows[rows[at], i] for i in mates)
        within = (n + shape.id_smooth * sum(smoothed[i] for i in column) / sum(smoothed[i] for i in mates)) / (n_class + shape.id_smooth)
        if num.klass[token] < num.own:
            within = 1.0
        else:
            within *= smoothed[token] / sum(smoothed[i] for i in column)
        out += np.log10(p[num.klass[token]] * within)
    return out


def test_attention_scores_equal_a_plain_version():
    model, flat, sizes = tiny_model()
    rng = np.random.default_rng(9)
    model.w = {k: rng.standard_normal(v.shape).astype(np.float32) * 0.5 for k, v in model.w.items()}
    got = model.score(flat, sizes)
    cuts = np.split(flat, np.cumsum(sizes)[:-1])
    for k in range(12):
        assert abs(got[k] - plain_log10(model, cuts[k], flat, sizes)) < 1e-3
    # Long texts cross the slices that are scored at a time.
    long = rng.integers(0, 14, 1500)
    assert abs(model.score(long, np.array([1500]))[0] - plain_log10(model, long, flat, sizes)) < 0.05


def test_attention_learns_is_causal_and_sums_to_one():
    # Every other id is that of the text: only what is two back tells it, so the pair counts do not.
    r = random.Random(7)
    texts = [[y for _ in range(6) for y in (x, 6 + r.randrange(8))] for x in (r.randrange(6) for _ in range(300))]
    model, flat, sizes = tiny_model(dim=8, block=4, classes=20, inputs=15, texts=texts)
    losses = model.train(model.numbering.before(flat, sizes), flat, sizes, np.ones(len(flat), bool), 400, batch=64, rate=0.03)
    assert np.mean(losses[-20:]) < 0.8 * np.mean(losses[:5])
    # One-token texts, and second tokens: the probabilities of all ids add up to one.
    every = np.arange(15)
    assert abs(sum(10 ** model.score(every, np.ones(15, np.int64))) - 1) < 1e-3
    pairs = np.column_stack([np.full(15, 3), every]).reshape(-1)
    assert abs(np.exp(model.logs(pairs, np.full(15, 2))[1::2]).sum() - 1) < 1e-3
    # What follows does not change what is before, and texts do not see each other.
    a = model.score(np.array([1, 2, 3]), np.array([3]))[0]
    assert abs(model.score(np.array([5, 1, 2, 3, 4, 4]), np.array([1, 3, 2]))[1] - a) < 1e-4


def test_attention_gradients_are_slopes():
    model, _, _ = tiny_model(ids=6, classes=4, inputs=3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rows, opens = np.array([[7, 1], [2, 0], [7, 3]]), np.array([True, False, True])
    klass, real = np.array([[0, 1], [2, 3], [1, 0]]), np.array([[1, 1], [1, 0], [1, 1]], bool)
    _, g = model._step(rows, opens, klass, real)
    for k, w in model.w.items():
        at = tuple(d - 1 for d in w.shape)
        for at in {at, tuple(0 for _ in w.shape)}:
            kept, e = w[at], 1e-5
            w[at] = kept + e
            up = model._step(rows, opens, klass, real)[0]
            w[at] = kept - e
            down = model._step(rows, opens, klass, real)[0]
            w[at] = kept
            assert abs((up - down) / (2 * e) - g[k][at]) < 1e-4, k


def grouped_model(groups):
    """As tiny_model, with its classes in groups."""
    from kinmatch.llm.attention import Attention, Numbering, Shape

    _, flat, sizes = tiny_model()
    counts = np.bincount(flat, minlength=15)
    numbering = Numbering(Shape(14, dim=4, block=2, classes=8, inputs=6, groups=groups), counts)
    pair, n = np.unique(numbering.pairs(flat, sizes), return_counts=True)
    return Attention(numbering, counts, pair, n), flat, sizes


def test_choices_in_groups_are_the_probability_and_have_its_slopes():
    # Without weights of the output, group and class in it give what all classes at once do.
    flat_model, flat, sizes = grouped_model(1)
    model, _, _ = grouped_model(3)
    for m in (flat_model, model):
        m.w |= {k: np.zeros_like(m.w[k]) for k in ("u", "c", "gu", "gc") if k in m.w}
    assert np.abs(model.score(flat, sizes) - flat_model.score(flat, sizes)).max() < 1e-4
    # With any weights, the probabilities of all ids add up to one, and training's loss is that of the score.
    rng = np.random.default_rng(4)
    model.w = {k: rng.standard_normal(v.shape) * 0.5 for k, v in model.w.items()}
    every = np.arange(15)
    assert abs(sum(10 ** model.score(every, np.ones(15, np.int64))) - 1) < 1e-3
    pairs = np.column_stack([np.full(15, 3), every]).reshape(-1)
    assert abs(np.exp(model.logs(pairs, np.full(15, 2))[1::2]).sum() - 1) < 1e-3
    before = model.numbering.before(flat, sizes)
    at, rows, opens = model._padded(before, sizes)
    klass, real = np.zeros(rows.size, np.int64), np.zeros(rows.size, bool)
    klass[at], real[at] = model.numbering.klass[flat], True
    klass, real = klass.reshape(rows.shape), real.reshape(rows.shape)
    loss, g = model._step(rows, opens, klass, real)
    assert abs(loss + (model.logs(flat, sizes) - model._within(before, flat)).mean()) < 1e-3
    assert set(g) == set(model.w)
    for k, w in model.w.items():
        for at in {tuple(d - 1 for d in w.shape), tuple(0 for _ in w.shape)}:
            kept, e = w[at], 1e-5
            w[at] = kept + e
            up = model._step(rows, opens, klass, real)[0]
            w[at] = kept - e
            down = model._step(rows, opens, klass, real)[0]
            w[at] = kept
            assert abs((up - down) / (2 * e) - g[k][at]) < 1e-4, k


def test_a_token_meets_few_of_the_classes():
    p = lm_scores.Scoring()
    assert p.classes >= 128 and p.groups + p.classes / p.groups <= 64


def test_rare_words_are_counted_within_their_texts():
    doc, word, times = lm_scores.counted(np.array([0, 0, 0, 2, 2, 3]), np.array([7, 5, 7, 7, 7, 7], np.uint64))
    assert list(zip(doc, word, times)) == [(0, 5, 1), (0, 7, 2), (2, 7, 2), (3, 7, 1)]
    assert [len(x) for x in lm_scores.counted(np.zeros(0, np.int64), np.zeros(0, np.uint64))] == [0, 0, 0]


def test_every_run_is_learned_from_once(spark):
    ids = lm_scores.Ids(100)
    sizes = np.array([1, 5, 300, 64, 65])
    flat = np.arange(sizes.sum()) % 100
    table = [(k, bytes(np.split(flat, np.cumsum(sizes)[:-1])[k].astype(np.uint16).tobytes())) for k in range(5)]
    texts = spark.createDataFrame(table, "key bigint, ids binary")
    p = lm_scores.Scoring(block=4, run_blocks=8, rounds=3)
    got = []
    for turn in range(3):
        for r in lm_scores.runs_of(texts, ids, p, turn, 2).collect():
            run = np.frombuffer(r.ids, np.uint16)
            got += [tuple(run[5 if r.lead else 0 :].tolist())]
    want = [tuple(text[k : k + 32].tolist()) for text in np.split(flat, np.cumsum(sizes)[:-1]) for k in range(0, len(text), 32)]
    assert Counter(got) == Counter(want)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_the_model_beats_counted_words_on_held_out_texts(spark):
    out = queries.op2_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out")
    sums = out.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert sums.s > sums.b


# -- 3 --


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(path)
    rows = EDGE + [(20, "ΑΣ ΣΑΣ İx\x1cy a\x85b　c ½ ⅻ é"), (21, "aaaaaaaaaaa !!!!!!!!!! it's we've"), (22, "<|startoftext|>x<|endoftext|><|endoftext|>")] + [(k, prose(60, k)) for k in range(30, 50)]
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(documents(spark, rows), path).collect())
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    assert got == want
    assert token_counts.count_tokens(documents(spark, rows).limit(0), path).count() == 0


# -- 4 --


def test_hilbert_neighbours_and_bijection():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    index = sharding.hilbert_index(grid, 3)
    assert sorted(index) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_shards_are_even_gapless_and_complete(spark):
    rows = EDGE + [(k, prose(k % 9, k % 4)) for k in range(100, 140)]
    got = sharding.shard(documents(spark, rows), carry=True).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    order = [r.text_crc32 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert len([1 for _ in itertools.groupby(order)]) == len(set(order))  # equal texts stand together
    assert sharding.shard(documents(spark, rows).limit(0)).count() == 0


# -- 5 --


def test_copies_join_alike_by_either_way(spark, monkeypatch):
    rows = [(k, prose(5, k % 3)) for k in range(50)]
    wanted = sorted(map(str, sharding.shard(documents(spark, rows)).collect()))
    monkeypatch.setattr(sharding, "BROADCAST_GROUPS", 0)
    assert sorted(map(str, sharding.shard(documents(spark, rows)).collect())) == wanted


def plain_curve(point, bits):
    """The place of a point on the curve, by walking it: cells in the order of the Gray code, each turned to begin and end at its neighbours'."""
    n, index, entry, way = len(point), 0, 0, 0
    left = lambda x, k: ((x << k) | (x >> (n - k))) & ((1 << n) - 1)
    right = lambda x, k: left(x, n - k) if k else x
    gray = lambda i: i ^ (i >> 1)
    ones = lambda i: len(bin(i)) - len(bin(i).rstrip("1")) if i else 0
    for bit in range(bits - 1, -1, -1):
        cell = sum((point[k] >> bit & 1) << k for k in range(n))
        turned = right(cell ^ entry, (way + 1) % n)
        w = next(i for i in range(1 << n) if gray(i) == turned)
        start = 0 if w == 0 else gray(2 * ((w - 1) // 2))
        step = 0 if w == 0 else ones(w - 1) % n if w % 2 == 0 else ones(w) % n
        entry ^= left(start, (way + 1) % n)
        way = (way + step + 1) % n
        index = index << n | w
    return index


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (3, 3)])
def test_order_is_that_of_a_curve_walked_plainly(dims, bits):
    grid = list(itertools.product(range(1 << bits), repeat=dims))
    ours = sharding.hilbert_index(np.array(grid), bits)
    theirs = [plain_curve(p, bits) for p in grid]
    # Both are orders of all cells in unit steps; in two dimensions they are the same but for which axis comes first and where the curve begins.
    for index in (ours, theirs):
        path = np.array(grid)[np.argsort(index)]
        assert sorted(index) == list(range(len(grid))) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
        # Every aligned cube of half, a quarter, ... the side is passed in one go.
        for shift in range(1, bits):
            cubes = [tuple(x) for x in path >> shift]
            assert len([1 for _ in itertools.groupby(cubes)]) == len(set(cubes))
    if dims == 2:
        axes = [np.argsort([plain_curve((p[i], p[1 - i]), bits) for p in grid]).tolist() for i in range(2)]
        assert np.argsort(ours).tolist() in axes


def test_quality_counts_and_cleaning(spark):
    rows = EDGE + [(k, prose(40, k) + ".\n" + prose(3, k) + " | menu | x | y\nHOME NOW!!\n" + prose(40, k)) for k in range(10, 14)]
    got = {(r.doc_id, r.cleaned): r for r in quality.clean_lines(documents(spark, rows)).collect()}
    for (i, _), r in got.items():
        text = next(t for k, t in rows if k == i) or ""
        words, lines = WORD.findall(text), text.split("\n")
        grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + d for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for d in range(5)}
        dup = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
    cleaned = next(r for (i, _), r in got.items() if i == 11)
    assert "menu" not in cleaned.cleaned and "HOME" not in cleaned.cleaned and cleaned.lost_words > 0
    assert quality.clean_lines(documents(spark, rows).limit(0)).count() == 0


# -- 6 --


def test_mix_never_strays_a_block(spark):
    rows = [(k, None) for k in range(2000)]
    df = documents(spark, rows).withColumn("source", F.when(F.col("doc_id") < 1400, "hot").when(F.col("doc_id") < 1800, "b").when(F.col("doc_id") < 1990, "c"))
    mix = mixing.Mix(weights={"hot": 5, "b": 3, "c": 1}, block_rows=4, slots=64, piece_rows=100)
    got = mixing.mix_sources(df, mix).collect()
    assert sorted(r.row.doc_id for r in got) == list(range(2000))
    quota = {r.source: r.quota for r in mixing.quotas(df.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n")), mix).collect()}
    assert sum(quota.values()) == 64
    slots = {}
    for r in got:
        if r.in_mix:
            slots.setdefault(r.mix_slot, set()).add(r.mix_source)
    assert slots and all(len(x) == 1 for x in slots.values()) and set(slots) == set(range(max(slots) + 1))
    done = Counter()
    for t in range(max(slots) + 1):
        done[next(iter(slots[t]))] += 1
        for s, q in quota.items():
            assert abs(done[s] - (t + 1) * q / 64) < 1
    assert mixing.mix_sources(df.limit(0), mix).count() == 0


def test_mix_of_nulls_repeats_clashing_names_and_many_sources(spark, monkeypatch):
    rows = [(None, "a"), (None, "a"), (1, "b"), (1, "b"), (2, None)] + [(k, "x") for k in range(10, 700)]
    df = documents(spark, rows).withColumn("source", F.when(F.col("doc_id") >= 10, F.concat(F.lit("s"), F.col("doc_id") % 60)))
    df = df.select("*", F.lit(7).alias("row"), F.lit(8).alias("mix_slot"), F.lit(9).alias("a.b"), F.lit("p").alias("piece"))
    got = mixing.mix_sources(df, mixing.Mix(slots=32, block_rows=2)).collect()
    assert Counter((r.row.doc_id, r.row.text, r.row.mix_slot, r.row["a.b"]) for r in got) == Counter((i, t, 8, 9) for i, t in rows)
    assert max(Counter(r.mix_slot for r in got).values()) <= 2
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", 0)
    again = mixing.mix_sources(df, mixing.Mix(slots=32, block_rows=2)).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))


def test_a_tiny_source_does_not_end_the_pipelines_mix(spark):
    source = F.when(F.col("doc_id") < 3, "tiny").when(F.col("doc_id") < 60_000, "a").otherwise("b")
    df = spark.range(100_003).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).withColumn("source", source)
    got = corpus_pipeline.mixed(spark, df, "").select("doc_id", "source", "mix_slot").toPandas()
    assert sorted(got["doc_id"]) == list(range(100_003))
    # No slot has two sources, and the shares of the others go on after the tiny one.
    assert (got.groupby("mix_slot")["source"].nunique() == 1).all()
    order = got.sort_values("mix_slot")["source"].to_numpy()
    shares = [(part == "a").sum() / np.isin(part, ["a", "b"]).sum() for part in np.array_split(order[:90_000], 9)]
    assert max(shares) - min(shares) < 0.01


# -- 7 --


def brute_components(rows, k, similarity=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(ids) if ids else None))
    return Counter(out)


def copies():
    rows, r = [], random.Random(9)
    for g in range(6):
        base = prose(80, 1000 + g).split()
        for j in range(9):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 6])):
                w[r.randrange(len(w))] = f"edit{r.randrange(9)}"
            rows.append((200 + 10 * g + j, " ".join(w)))
    shared = prose(40, 5)
    rows += [(400 + j, shared + " " + prose(80, 2000 + j)) for j in range(30)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, k):
    rows = EDGE + copies()
    got = near_dup.near_duplicates(documents(spark, rows), near_dup.NearDup(words=k)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_lists_in_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_NODES", 5)
    rows = copies()
    got = near_dup.near_duplicates(documents(spark, rows), near_dup.NearDup(rounds=0)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 5)


def test_one_of_each_keeps_one_row(spark):
    rows = copies()
    got = near_dup.one_of_each(documents(spark, rows + rows[:3])).collect()
    assert sorted(r.doc_id for r in got) == sorted({c for _, _, c in brute_components(rows, 5)})
    empty = documents(spark, rows).limit(0)
    assert near_dup.one_of_each(empty).count() == 0


def test_one_of_each_keeps_one_row_for_each_component(spark):
    a, b, c, d = (prose(60, 3000 + k) for k in range(4))
    # Rows without an id: a is near nothing, b is there twice, c is a copy of one with an id; d shares its id with another text.
    rows = [(None, a), (None, b), (None, b + " "), (None, c), (7, c), (8, d), (8, prose(60, 3009)), (9, "x " + d), (9, prose(60, 3010)), (None, None), (None, " "), (None, None)]
    got = near_dup.one_of_each(documents(spark, rows)).collect()
    left = Counter((r.doc_id, (r.text or "").strip()) for r in got)
    assert left == Counter([(None, a), (None, b), (7, c), (8, d), (8, prose(60, 3009)), (9, prose(60, 3010)), (None, ""), (None, ""), (None, "")])


# -- 8 --


def test_toxic_words_are_restored_and_found(spark):
    bad = ["stupid", "idiot", "moron", "clown"]
    rows = [(k, prose(30, k) + (f" {bad[k % 4]} " if k % 3 == 0 else " ") + prose(10, k)) for k in range(720)]
    df = documents(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(720)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, labels, learn=F.col("doc_id") % 5 > 0)
    for disguised, plain in (("1d10t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("morooon", "moron"), ("cl0wn", "clown")):
        assert toxicity.decode(disguised, model.lm, model.p) == plain
    more = [(900, prose(20, 1) + " m0r0n " + prose(20, 2)), (901, prose(20, 3) + " s t u p i d " + prose(9, 4)), (902, prose(50, 5)), *EDGE]
    got = toxicity.score(documents(spark, rows + more), model).collect()
    wrong = [r.doc_id for r in got if r.doc_id is not None and 10 <= r.doc_id < 720 and r.predicted != int(r.doc_id % 3 == 0)]
    assert len(wrong) <= 5
    assert {r.doc_id: r.predicted for r in got if r.doc_id and r.doc_id >= 900} == {900: 1, 901: 1, 902: 0}
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows + more)
    assert toxicity.without_toxic(df, model).columns == df.columns
    nothing = toxicity.fit(df.limit(0), labels.limit(0))
    assert {r.score < 0.01 for r in toxicity.score(df, nothing).collect()} == {True}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_all_labelled_rows_are_learned_from(spark):
    rows = [(k, "you gromp" if k % 2 else "you there") for k in range(8100)]
    late = [(k, "you zarnik" if k % 2 else "you there") for k in range(8100, 16200)]
    labels = spark.range(16200).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    df = documents(spark, rows + late)
    model = toxicity.fit(df, labels)
    assert model.lm.counts["^^^z"] == model.lm.counts["^^^g"] == toxicity.Toxicity().most_times and model.lm.counts["|^^^"] >= 60
    other = toxicity.fit(df.repartition(7), labels)
    assert (model.weights == other.weights).all() and model.base == other.base
    # Word counts before the cut are those of all 16,200 rows: each of the two words has the odds of 4,050 texts.
    assert np.allclose(sorted(set(model.odds.round(6)))[-1], np.log(4050.5 / 8101) - np.log(0.5 / 8101))


def test_toxic_words_are_found_among_other_letters_and_in_long_runs(spark):
    bad = ["stupid", "idiot", "moron", "clown", "dünn"]
    plain = ["you", "are", "such", "that", "this", "what", "people"]
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(plain + VOCABULARY) for _ in range(n))
    rows = [(k, say(30) + (f" {bad[k % 5]} " if k % 3 == 0 else " ") + say(10)) for k in range(720)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(720)], "doc_id bigint, toxic int")
    model = toxicity.fit(documents(spark, rows), labels)
    toxic = ["you are a s t u p i d", "such a c l o w n", "y o u i d i o t", "y o u a r e s u c h a s t u p i d p e o p l e a n d t h a t i s w h a t y o u a r e", "stu" + "u" * 60 + "pid",
             "you-moron", "stu.pid", "stuupid", "d ü n n", "people.that.are.people.that.are.people.that.are.idiot"]
    clean = ["y o u a r e t h a t", "people.that.are", "p e o p l e " * 12, "youu", "x y"]
    got = toxicity.score(documents(spark, list(enumerate(f"{say(15)} {x} {say(15)}" for x in toxic + clean))), model).collect()
    assert {(toxic + clean)[r.doc_id]: r.predicted for r in got} == dict.fromkeys(toxic, 1) | dict.fromkeys(clean, 0)


# -- 9 --


def test_chats_are_read_back_exactly(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "&lt;|", "a & b < | <|", None, "", "\n\n", "é😀"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts * 2)]
    rows += [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, None, None, "y"), (None, 1, "us\ner", "z"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "v")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in rows if c == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [x[1:] for x in own]
        assert got[conv].loss_text == "".join(x[2] for x in own if x[1] == "assistant")
    assert [got[c].valid for c in (1, 2, 3, None, 4)] == [True, False, False, False, True]
    assert chat.format_chats(df.limit(0)).count() == 0


# -- 10 --


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequences_equal_brute_force():
    r = np.random.default_rng(0)
    a, b = np.full((50, 64), -1, np.int32), r.integers(-1, 6, (50, 40)).astype(np.int32)
    sizes = r.integers(1, 48, 50)
    for k, n in enumerate(sizes):
        a[k, :n] = r.integers(0, 6, n)
    got = decontam.common_subsequence(a, b)
    assert list(got) == [brute_lcs(a[k, :n], [x if x >= 0 else -9 for x in b[k]]) for k, n in enumerate(sizes)]


def test_leaks_are_found_and_clean_texts_left(spark):
    items = [(k, prose(15 + k, 5000 + k)) for k in range(30)] + [(97, "too short"), (98, None), (99, "")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    r = random.Random(2)
    rows = [*EDGE]
    for k in range(60):
        w = prose(r.choice([0, 30, 200]), k).split()
        at = r.randint(0, len(w))
        leak = items[k % 30][1].split()
        if k % 3 == 1:
            leak[len(leak) // 2] = "changed"
        if k % 3 < 2:
            rows.append((500 + k, " ".join(w[:at] + [x.upper() if k % 6 == 0 and "ß" not in x else x for x in leak] + w[at:])))
        else:
            rows.append((500 + k, prose(100, 7000 + k)))
    df = documents(spark, rows)
    got = decontam.find_leaks(df, benchmark).collect()
    want = {(500 + k, k % 30) for k in range(60) if k % 3 < 2}
    assert {(x.doc_id, x.item_id) for x in got} == want
    clean = decontam.without_leaks(df, benchmark)
    assert clean.columns == df.columns
    assert Counter(x.doc_id for x in clean.collect()) == Counter(i for i, _ in rows if i not in {d for d, _ in want})
    assert decontam.find_leaks(df, benchmark.limit(0)).count() == 0
    assert decontam.without_leaks(df.limit(0), benchmark).count() == 0


def test_latent_space_keeps_all_cosines(spark):
    """With rank over the number of passages the space's cosines are the exact ones."""
    benchmark = spark.createDataFrame([(k, prose(30, 9000 + k)) for k in range(12)], "item_id bigint, text string")
    p = decontam.Decontam(rank=32)
    index = decontam.build_indexes(documents(spark, [(k, prose(50, k)) for k in range(20)]), benchmark, p)[0]
    assert np.allclose(np.linalg.norm(index.latent, axis=1), 1, atol=1e-3)


def test_more_passages_than_rank_are_all_found(spark):
    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randrange(20_000)}" for _ in range(n))
    items = [(k, text(30)) for k in range(300)]
    rows = [(k, f"{text(60)} {items[k][1]} {text(60)}") for k in range(300)] + [(k, text(150)) for k in range(300, 350)]
    df, benchmark = documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    for p in (decontam.Decontam(rank=32), decontam.Decontam(rank=32, scan=100)):
        assert {(x.doc_id, x.item_id) for x in decontam.find_leaks(df, benchmark, p).collect()} == {(k, k) for k in range(300)}
    assert {x.doc_id for x in decontam.without_leaks(df, benchmark, p).collect()} == set(range(300, 350))


def test_short_items_among_rare_words_are_found(spark):
    r = random.Random(12)
    items = [(k, prose(n, 6000 + k)) for k, n in enumerate([8, 9, 10, 12, 15] * 8)] + [(100 + n, " ".join(f"q{n}x{j}" for j in range(n))) for n in range(1, 8)] + [(200, None), (201, " - ")]
    rare = lambda: " ".join(f"r{r.randrange(1 << 40)}" for _ in range(70))
    rows = [(k, f"{rare()} {t} {rare()}") for k, t in items if t] + [(1000 + k, prose(60, 8000 + k)) for k in range(200)]
    rows += [(500, "q3x0 q3x1 and q3x2"), (501, "q2x1 q2x0"), (502, None), (503, "")]
    df, benchmark = documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.find_leaks(df, benchmark).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(k, k) for k, t in items if t and k != 201}
    left = {x.doc_id for x in decontam.without_leaks(df, benchmark).collect()}
    assert left == {k for k, _ in rows} - {k for k, t in items if t and k != 201}


def test_queries_are_registered():
    from kinmatch.llm.queries import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 11))


def test_arrow_batches_are_bounded_by_bytes(spark):
    df = spark.range(3000).coalesce(1).selectExpr("id", "repeat('abcdefgh ', 600) AS text")
    held = lambda rows, c: pa.RecordBatch.from_arrays([pa.array([rows.column("text").buffers()[2].size])], ["held"])
    got = common.map_texts(df, "text", lambda: held, "held bigint").collect()
    assert max(r.held for r in got) < 3 * common.BATCH_BYTES


def test_a_disguised_word_is_looked_up_once_for_all_its_places():
    class Restorer(toxicity.Restorer):
        asked = 0

        def __call__(self, word, spaced=False):
            self.asked += 1
            return super().__call__(word, spaced)

    restore = Restorer(toxicity.CharModel(toxicity.grams_of(Counter({"idiot": 9, "clown": 9}))), toxicity.Toxicity())
    (c,) = chunks(pa.array(["1d10t x 1d10t", None, "1d10t c l o w n"]), lowered)
    words, which, docs = restore.readings(c, toxicity.words_of(c))
    assert [words[k] for k in which] == ["idiot"] * 3 + ["clown"] and docs.tolist() == [0, 0, 2, 2] and restore.asked == 2
