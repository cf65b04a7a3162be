"""Budget mixing, context mixing, co-training and the pipeline."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

import corpus_pipeline
from tabwright.llm import co_training, context_mixing, queries
from tabwright.llm.budget_mix import fill_budget, mix


def test_fill_budget_is_nearest():
    draw = np.random.default_rng(5)
    for _ in range(60):
        sizes = np.unique(draw.integers(1, 40, 4))
        counts = draw.integers(1, 4, len(sizes))
        sums = {
            int(np.dot(sizes, take)) for take in itertools.product(*[range(c + 1) for c in counts.tolist()])
        }
        budget = int(draw.integers(0, sizes @ counts + 1))
        taken = fill_budget(sizes, counts, budget)
        assert (taken <= counts).all() and int(sizes @ taken) in sums
        spread = abs(int(sizes @ taken) - budget)
        assert spread <= max(sizes)  # the proportional start is kept; only the rest is searched


def test_mix(spark):
    rows = [(i, "w " * (i % 17 + 1), "bca"[i % 3]) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "x y", None), (1001, "x y", None), (None, "", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix(frame).collect()
    assert len(found) == len(rows)
    total = sum(r.size for r in found)
    targets = {r.source: r.target for r in found}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6
    for source, target in targets.items():
        own = [r for r in found if r.source == source]
        assert target <= 2 * own[0].source_size and own[0].source_size == sum(r.size for r in own)
        assert all(r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 17
    again = mix(frame.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert mix(frame.where("false")).count() == 0


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), "\n"]


def test_base_score_is_exact(spark, sf):
    docs = [(r.doc_id, tokens(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = collections.Counter(t for i, ts in docs if zlib.crc32(str(i).encode()) % 5 != 1 for t in ts)
    n, v = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in queries.QUERIES["op7_context_mixing"](spark, sf).collect()}
    assert len(found) == len(docs)
    for i, ts in docs:
        r = found[i]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert abs(base - r.base_score) < 1e-6 * abs(base)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(counts[t] > 0 for t in ts), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1) and r.score < 0
    held = [r for r in found.values() if r.held_out]
    assert sum(-r.score / math.log10(2) for r in held) / sum(r.bytes for r in held) < 3.5


def test_word_probabilities_sum_to_one():
    """All one-byte words and longer ones by brute force: a byte's decisions are a proper code."""
    code = context_mixing.make_code(np.random.default_rng(1).integers(0, 50, (256, 256)))
    for before in (0, 10, 97):
        lengths = code.length[before * 256 : before * 256 + 256]
        assert abs(sum(2.0 ** -lengths.astype(float)) - 1) < 1e-9


def test_context_mixing_edges(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "a b a"), (3, "a b a"), (None, "zz")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.bytes) for r in context_mixing.score(frame, frame).collect())
    assert got == [("1", 1, 1, 1), ("2", 1, 1, 1), ("3", 4, 4, 7), ("3", 4, 4, 7), ("None", 2, 2, 4)]
    none = context_mixing.score(frame, frame.where("false")).collect()
    assert len(none) == 5 and all(r.n_known == 0 for r in none)


def test_context_mixing_learns_from_every_text(spark):
    """Each training text has a word of its own, one is long: all are known better than words never seen."""
    rng = np.random.default_rng(5)
    own = ["".join(rng.choice(list("abcdefghijklmnop"), 12)) for _ in range(1_300)]
    seen, unseen = own[:1_200], own[1_200:]
    thrice = [" ".join([w] * 3) for w in seen]
    thrice[-1] += " xxxxx" * 12_000
    train = spark.createDataFrame([*enumerate(thrice)], "doc_id long, text string")
    docs = spark.createDataFrame([*enumerate(seen), *((5_000 + i, w) for i, w in enumerate(unseen))], "doc_id long, text string")
    found = {r.doc_id: r.score for r in context_mixing.score(docs, train).collect()}
    assert min(found[i] for i in range(1_200)) > max(found[5_000 + i] for i in range(100))


def test_co_training(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES["op10_co_training"](spark, folder)
    truth = spark.read.parquet(f"{folder}/labels.parquet")
    held = found.where("held_out").join(truth, "doc_id")
    assert held.where("predicted = quality").count() >= 0.9 * held.count()
    pages = spark.createDataFrame([("http://a.b.c/en/1?x=1",), ("bad",), (None,)], "url string")
    docs = spark.createDataFrame([(1, None, None, None), (None, "", "s", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, label int")
    model = co_training.fit(co_training.sample_rows(docs, pages, labels))
    assert co_training.score(docs, pages, model).count() == 2


def test_near_duplicates_decides_by_id_and_text(spark):
    words = [f"w{i}" for i in range(60)]
    copy, other, third = " ".join(words), " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    near = f"{copy} more"
    rows = [(3, copy), (5, near), (5, other), (5, other), (7, third), (None, copy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert collections.Counter(map(tuple, kept)) == collections.Counter([(3, copy), (5, other), (7, third), (None, copy)])


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.keep(stage(spark, docs, sf))
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= docs.count()
        docs = kept
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert mixed.count() == mixed.select("doc_id").distinct().count() > 0
    assert mixed.where(F.col("taken") > 2 * F.col("size")).count() == 0


def test_context_mixing_scores_a_word_once_for_a_window_of_texts(monkeypatch):
    draw = np.random.default_rng(2)
    code = context_mixing.make_code(draw.integers(0, 50, (256, 256)))
    tables = tuple(draw.integers(-3_000, 3_000, 1 << b).astype(np.int16) for b in context_mixing.table_bits(15))
    model = context_mixing.Model(code, 15, tables, np.full((context_mixing.GATES, 5), 0.2, dtype=np.float32))
    texts = [b"one two three", b"two three four", b"", b"four One one"]
    alone = [context_mixing._bits_of(model, [text]) for text in texts]
    asked, real = [], context_mixing._word_bits
    monkeypatch.setattr(context_mixing, "GROUP_BYTES", 1)
    monkeypatch.setattr(context_mixing, "_word_bits", lambda m, words: asked.extend(words) or real(m, words))
    bits, sizes, hashes = context_mixing._bits_of(model, texts)
    assert sorted(asked) == [b"\n", b"four ", b"one ", b"three ", b"two "]
    assert np.allclose(bits, [float(a[0][0]) for a in alone], rtol=1e-9) and sizes.tolist() == [15, 16, 1, 14]
    assert [len(own) for own in hashes] == [3, 3, 0, 3]


def test_context_mixing_predicts_a_word_from_the_one_before():
    """Shares of pairs, and scores of texts, against brute force; three parts, and a word whose pairs lie in all of them."""
    taught = [b"a b c", b"a b d", b"c a b", b"d d d", b"a", b"", None, b"e b a", b"a b"]
    asked = [b"a b c", b"c b a", b"d d", b"x a", b"", b"b c a", b"a x"]
    pairs = collections.Counter(p for t in taught for p in itertools.pairwise([b"", *(t or b"").split(), b"\n"]))
    short = lambda text: context_mixing._hashed([text])[0] >> np.uint64(32)
    routes = context_mixing.Routes(3, np.sort(np.concatenate([short(b"a"), [np.uint64(context_mixing.BEGIN_HASH)]])))
    batch = lambda texts: pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary()), "partition": [0] * len(texts)})
    blocks = pa.Table.from_batches([*context_mixing._taught_pairs(routes)([batch(taught[:4]), batch(taught[4:])]), *context_mixing._asked(routes)([batch(asked)])])
    answers = []
    for part in blocks["part"].unique().to_pylist():
        answers += context_mixing._answered(routes)(blocks.filter(pc.equal(blocks["part"], part))).to_pylist()
    sums = [r for r in answers if r["window"] == context_mixing.TAUGHT]
    once, twice = (sum(r[name] for r in sums) for name in ("once", "twice"))
    assert (once, twice) == tuple(sum(c == n for c in pairs.values()) for n in (1, 2))
    totals, kinds = (np.array([sum(h[f] for r in sums for h in r["hot"] if h["name"] == n) for n in routes.hot.tolist()]) for f in ("total", "kinds"))
    follow = context_mixing.Follow(routes, 0.6, totals, kinds)
    code = context_mixing.make_code(np.random.default_rng(2).integers(0, 50, (256, 256)))
    tables = tuple(np.random.default_rng(3).integers(-3_000, 3_000, 1 << b).astype(np.int16) for b in context_mixing.table_bits(15))
    model = context_mixing.Model(code, 15, tables, np.full((context_mixing.GATES, 5), 0.2, dtype=np.float32))
    held = [r for r in answers if r["window"] != context_mixing.TAUGHT]
    bits, _, _ = context_mixing._bits_of(model, asked, lambda keys: context_mixing._pair_answers(follow, held, keys))
    for text, found in zip(asked, bits, strict=True):
        total = np.zeros(len(context_mixing.SHARPNESS))
        for before, word in itertools.pairwise([b"", *text.split(), b"\n"]):
            own = context_mixing._word_bits(model, [word if word == b"\n" else word + b" "])[0]
            after = {k[1]: c for k, c in pairs.items() if k[0] == before}
            n = sum(after.values())
            share, left = (max(after.get(word, 0) - 0.6, 0) / n, 0.6 * len(after) / n) if n else (0.0, 1.0)
            total -= np.log2(share + left * 2**-own)
        assert abs(found + np.log2(np.exp2(-total).mean())) < 1e-6 * found


def test_context_mixing_knows_the_order_of_words(spark, monkeypatch):
    """The same words score apart in another order; several parts and frequent words change nothing."""
    lines = ["the cat sat on the mat", "a cat sat on a chair", "the dog lay on the mat", "the cat sat on the chair"] * 3
    train = spark.createDataFrame([*enumerate(lines)], "doc_id long, text string").repartition(3)
    docs = spark.createDataFrame([(0, "the cat sat on the mat"), (1, "mat the on sat cat the"), (2, "")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in context_mixing.score(docs, train).collect()}
    assert found[0] > found[1] + 2
    monkeypatch.setattr(context_mixing, "PART_TOKENS", 8)
    again = {r.doc_id: r.score for r in context_mixing.score(docs, train).collect()}
    assert all(abs(again[i] - found[i]) < 1e-9 * abs(found[i]) for i in found)
