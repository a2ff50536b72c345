"""The pipeline's stages against plain versions, and every operator on texts of more than one chunk."""

import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinmatch.llm import chat, decontam, lm_scores, mixing, near_dup, quality, sharding, token_counts, toxicity
from kinmatch.llm.text import CHUNK_BYTES

from test_operators import VOCAB, WORD, brute_components, prose

BAD = ["stupid", "idiot", "moron", "clown"]
EXTRA = "size int, row string, mix_slot int, SLOT int, shard string, kept_id int, own_key int, `a.b` int, score double, word string"
EXTRA_VALUES = (1, "r", 2, 3, "s", 4, 5, 6, 0.5, "w")


def tables(spark, folder, rows):
    """documents (id, text, source and columns whose names clash), labels and benchmark in a folder."""
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), *EXTRA_VALUES) for i, t, s in rows], f"doc_id bigint, text string, lang string, source string, n_chars int, {EXTRA}")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(any(b in (t or "") for b in BAD))) for i, t, _ in rows if i is not None and i < 400] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(k, prose(20, 5000 + k)) for k in range(8)] + [(9, None), (10, "")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def corpus():
    rows = [(k, prose(30, k) + (f" {BAD[k % 4]} " if k % 4 == 0 else " ") + prose(10, 900 + k), f"s{k % 3}" if k % 3 else "hot") for k in range(400)]
    for k in range(8):
        rows.append((500 + k, f"{prose(25, 600 + k)} {prose(20, 5000 + k)} {prose(25, 700 + k)}", "leaky"))
    for k in range(6):
        words = prose(80, 800 + k % 2).split()
        words[k] = f"edit{k}"
        rows.append((600 + k, " ".join(words), None))
    return rows + [(None, prose(40, 99), "s1"), (None, prose(40, 98), None), (700, None, "s1"), (701, "", "s1"), (701, "", "s1"), (702, prose(50, 77), "s2"), (702, prose(50, 77), "s2"), (703, "x " * 200_000, "hot")]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = corpus()
    items = tables(spark, folder, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    left = stages["toxicity"](spark, docs, folder)
    assert left.columns == docs.columns
    toxic = {i for i, t, _ in rows if any(b in (t or "") for b in BAD)}
    assert sum(i in toxic for i, _ in key(left)) <= 3 and sum(n for (i, _), n in key(left).items() if i not in toxic) >= len(rows) - len(toxic) - 3

    one = stages["minhash_near_dedup"](spark, docs, folder)
    assert one.columns == docs.columns
    plain = brute_components([(i, t) for i, t, _ in rows], 5)
    kept = key(one)
    assert sorted(i for i, _ in kept.elements() if i is not None) == sorted({c for _, n, c in plain if n and c is not None} | {700, 701})
    assert sum(n for (i, _), n in kept.items() if i is None) == 2

    clean = stages["benchmark_decontamination"](spark, docs, folder)
    assert clean.columns == docs.columns
    holds = lambda t: any(x and f" {x} " in f" {t} " for _, x in items)
    assert key(clean) == Counter((i, t) for i, t, _ in rows if not holds(t or ""))

    mixed = stages["mixing"](spark, docs, folder)
    assert mixed.columns == [*docs.columns, "mix_slot_"] and key(mixed) == Counter((i, t) for i, t, _ in rows)
    sharded = stages["sharding"](spark, docs, folder)
    assert sharded.columns == [*docs.columns, "shard_", "slot_"] and key(sharded) == Counter((i, t) for i, t, _ in rows)
    assert {tuple(r)[5:15] for r in sharded.collect()} == {EXTRA_VALUES}

    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*docs.columns, "mix_slot_", "shard_", "slot_"]
    got = out.collect()
    assert not {r.doc_id for r in got} & set(range(500, 508)) and len({r.doc_id for r in got} & set(range(600, 606))) == 2
    assert Counter(r.doc_id for r in got)[None] == 2 and max(n for i, n in Counter(r.doc_id for r in got).items() if i is not None) == 1
    sizes = Counter(r.shard_ for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot_ for r in got if r.shard_ == s) == list(range(n)) for s, n in sizes.items())


def test_pipeline_of_empty_tables(spark, tmp_path):
    tables(spark, f"file://{tmp_path}", [])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


# -- texts of several chunks --


@pytest.fixture(scope="module")
def long_texts():
    line = " ".join(prose(1, k) + str(k) for k in range(9))
    one = "\n".join(f"{line} {k}." for k in range(CHUNK_BYTES // 30))
    assert len(one) > CHUNK_BYTES
    return one, one + " tail", one + "\n" + prose(20, 5000) + "\nthe end."


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")})


def test_long_texts_are_read_whole(spark, long_texts):
    df = frame(spark, ["short text here", *long_texts, None])
    words = [WORD.findall(t or "") for t in ["short text here", *long_texts, None]]
    # 2
    got = {r.doc_id: r for r in lm_scores.score_texts(df, VOCAB, public_tokenizers.PATTERN, F.col("doc_id") != 2, p=lm_scores.Scoring(dim=4, classes=16, inputs=64, least_steps=1)).collect()}
    assert [got[k].n_tokens for k in range(5)] == [len(w) + 1 for w in words] and got[2].score < got[1].score < 0
    # 3
    counted = {r.doc_id: r for r in token_counts.count_tokens(df, str(public_tokenizers.path("word_bpe_49k.json"))).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation()
    for k in (0, 2):
        text = ["short text here", *long_texts][k]
        assert counted[k].n_tokens == len(library.encode(text, add_special_tokens=False).ids) and counted[k].n_bytes == len(text.encode())
    # 4, 6
    assert {r.doc_id: r.size for r in sharding.shard(df).collect()} == {k: len((t or "").encode()) + 1 for k, t in enumerate(["short text here", *long_texts, None])}
    assert {len(r.row.text or "") for r in mixing.mix_sources(df).collect()} == {len(t or "") for t in ["short text here", *long_texts, None]}
    # 5
    judged = {r.doc_id: r for r in quality.clean_lines(df).collect()}
    assert [judged[k].n_words for k in range(5)] == [len(w) for w in words] and judged[3].cleaned.endswith("the end.")
    # 7
    near = {r.doc_id: r for r in near_dup.near_duplicates(df).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]
    assert [near[k].n_shingles for k in range(5)] == list(map(len, sets)) and [near[k].component_id for k in range(5)] == [0, 1, 1, 1, 4]
    # 10
    benchmark = spark.createDataFrame([(1, prose(20, 5000))], "item_id bigint, text string")
    assert [r.doc_id for r in decontam.find_leaks(df, benchmark).collect()] == [3]


def test_a_toxic_word_at_the_end_of_a_long_text_and_a_long_chat(spark, long_texts):
    rows = [(k, prose(30, k) + (f" {BAD[k % 4]} " if k % 3 == 0 else " ")) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id bigint, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, [long_texts[0], long_texts[0] + " stupid 1d10t"]), model).collect()}
    assert got[1] > got[0]
    turns = spark.createDataFrame([(1, 0, "user", long_texts[0]), (1, 1, "assistant", long_texts[2])], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.format_chats(turns)).first().loss_text == long_texts[2]


# -- toxicity's decoder against all readings --


def every_reading(word, lm, p, spaced):
    """(cost, reading) of all ways through the channel, by plain enumeration."""
    runs = [(c, len(list(g))) for c, g in itertools.groupby(word)]
    options = []
    for i, (c, n) in enumerate(runs):
        if c in toxicity.LEET:
            own = [(x * k, p.swap_cost * k) for x in toxicity.LEET[c] for k in ((1, 2) if n > 1 else (1,))] + [(c * n, p.literal_cost * n)]
        elif c in ".-_*":
            own = [("", p.drop_cost), (" ", p.drop_cost), (c * n, p.literal_cost * n)]
        elif n > 2:
            own = [(c, p.drop_cost), (c * 2, p.drop_cost)]
        else:
            own = [(c * n, 0.0)] + ([(c, p.double_cost)] if n == 2 else [])
        if spaced:
            own += [(f"{x[0]} {x[1]}", cost) for x, cost in own if len(x) == 2]
            own += [(x + " ", cost) for x, cost in own if i + 1 < len(runs) and x and x != " "]
        options.append(own)
    for choice in itertools.product(*options):
        text, cost = "".join(x for x, _ in choice), sum(c for _, c in choice)
        parts = text.split(" ")
        if any(not x for x in parts[:-1]):
            continue
        for part in parts:
            if not part:
                continue
            marked = "^^^" + part
            cost -= sum(lm.logp(marked[k - 3 : k], marked[k]) for k in range(3, len(marked)))
            end = lm.logp(marked[-3:], "\x00")
            cost -= max(end, -p.alone_cost) if len(part) == 1 else end
        yield cost, text


def test_readings_are_the_likeliest_of_all():
    r = random.Random(3)
    words = Counter({w: r.randint(1, 20) for w in [*BAD, "you", "are", "a", "i", *(prose(1, k) for k in range(80))]})
    lm, p = toxicity.CharModel(toxicity.grams_of(words)), toxicity.Toxicity()
    for spaced in (False, True):
        for _ in range(60):
            word = "".join(r.choice("iadotsmn0135.-") * r.choice([1, 1, 1, 2, 3]) for _ in range(r.randint(1, 5)))
            found = {text: cost for cost, text in sorted(every_reading(word, lm, p, spaced), reverse=True)}
            got = toxicity.decode(word, lm, p, spaced)
            assert got in found and abs(found[got] - min(found.values())) < 1e-9, (word, got)


# -- decontamination of many passages, exact and changed --


def test_many_passages_are_found_exact_and_changed(spark):
    r = random.Random(8)
    text = lambda n: [f"w{r.randrange(50 if r.random() < 0.3 else 30_000)}" for _ in range(n)]
    items = [text(40) for _ in range(2000)]
    rows, changed = [], set()
    for k, item in enumerate(items):
        leak = list(item)
        if k % 2:
            changed.add(k)
            for at in r.sample(range(40), 8):
                leak[at] = f"new{r.randrange(1 << 30)}"
        rows.append((k, " ".join(text(60) + leak + text(60))))
    rows += [(10_000 + k, " ".join(text(150))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.find_leaks(df, benchmark).collect()}
    # Brute force: the longest common subsequence holds four fifths of the item, in each text with its own item.
    found = {k for k in range(2000) if (k, k) in got}
    assert len(found - changed) == 1000 and len(found & changed) >= 950
    assert not [d for d, _ in got if d >= 10_000]


def test_one_blas_thread_is_harmless():
    from kinmatch.llm.common import one_blas_thread

    one_blas_thread()
    assert np.allclose(np.eye(3) @ np.arange(9).reshape(3, 3), np.arange(9).reshape(3, 3))
