"""Collocations: a brute-force version, counts of the quicksort, SQL, hot prefixes and odd inputs."""

import collections
import random
import re

import numpy as np
import pytest

from tabwright.llm import phrase_mining, queries
from tests.compare import difference, duck

SCHEMA = "doc_id long, text string, lang string, phrase string, rank int"
LOWER = {c: c + 32 for c in range(65, 91)}


def counted(docs):
    found = collections.defaultdict(collections.Counter)
    for _, text, lang, *_ in docs:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                found["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return found


def brute(docs, least, top):
    rows = []
    for lang, f in counted(docs).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        around = collections.Counter()
        for p, c in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        around[p[i:j]] = max(around[p[i:j]], c)
        left = []
        for p, a in candidates.items():
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not (around[p] and 100 * around[p] >= 80 * a):
                left.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(left)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(rows)


def rows_of(found):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())


def some_docs(seed, n=120):
    draw = random.Random(seed)
    words = ["a", "b", "c", "de", "É", "ż", "\x1c", "x\x00y", "日本", "THE", "of"]
    docs = [(0, None, "en"), (1, "", "en"), (2, " \t.,", None), (3, "hot pair " + "z" * 50_000, "en")]
    for i in range(n):
        body = "".join(
            draw.choices(words, [9, 6, 4, 3, 2, 2, 1, 1, 2, 5, 5])[0] + draw.choice([" ", " ", " ", "\t ", ". ", "\n", "!?", ", "])
            for _ in range(draw.choice([1, 5, 60, 200]))
        )
        docs.append((i % 50 if i % 7 else None, body, draw.choice(["en", "de", "", None, "und"])))
    return [(*d, "other", 3) for d in docs]


def test_matches_brute_force(spark):
    docs = some_docs(1)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(6)
    assert rows_of(phrase_mining.collocations(frame, least=5)) == brute(docs, 5, 2000)
    assert rows_of(phrase_mining.collocations(frame, least=30, top=7)) == brute(docs, 30, 7)


def test_hot_prefixes_and_cut_stretches(spark, monkeypatch):
    """A third of all suffixes begins with one pair; senders flush often and texts are cut at pieces."""
    draw = random.Random(4)
    docs = some_docs(2, 40)
    docs += [(i, " ".join(f"hot pair w{draw.randrange(3)} v{draw.randrange(300)}" for _ in range(60)), "en", "", 0) for i in range(60)]
    docs += [(i, "hot pair of four. " * 100, "en", "", 0) for i in range(200)]
    monkeypatch.setattr(phrase_mining, "FLUSH_BYTES", 3000)
    monkeypatch.setattr(phrase_mining, "PACKED", 50)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    hot = phrase_mining._crowded(frame.select("text", "lang").where("lang is not null"), 8, 1)
    assert len(hot[0]) and len(hot[1])
    assert rows_of(phrase_mining.collocations(frame, least=30)) == brute(docs, 30, 2000)


@pytest.mark.parametrize("whole", [1, 2, 3, 5])
def test_equal_parts_are_prefix_counts(whole):
    draw = np.random.default_rng(whole)
    for least in (1, 4, 30):
        ids = np.minimum(draw.geometric(0.35, size=(4, 400)), 9)
        ids[1:][:, draw.random(400) < 0.1] = 0
        weight = draw.integers(1, 4, 400)
        expected = collections.Counter()
        for column, w in zip(ids.T.tolist(), weight.tolist(), strict=True):
            for k in range(1, 5):
                if 0 not in column[:k]:
                    expected[tuple(column[:k])] += w
        found = {}
        for example, words, total in phrase_mining.equal_parts(ids, weight.astype(float), least, whole):
            for e, k, c in zip(example.tolist(), words.tolist(), total.tolist(), strict=True):
                assert tuple(ids[:k, e].tolist()) not in found
                found[tuple(ids[:k, e].tolist())] = c
        for phrase, count in expected.items():
            if count >= least or (len(phrase) < whole and phrase in found):
                assert found[phrase] == count
        assert set(found) <= set(expected)
        assert {p for p in found if len(p) >= whole} == {p for p, c in expected.items() if len(p) >= whole and c >= least}


def test_copies_empty_tables_and_big_counts(spark):
    docs = [(1, "Same words here", "en", "", 0)] * 40
    frame = spark.createDataFrame(docs, SCHEMA)
    assert rows_of(phrase_mining.collocations(frame)) == [("en", 1, "same words here", 40, 40, 40, 120, 1_000_000)]
    assert phrase_mining.collocations(frame.where("false")).count() == 0
    assert phrase_mining.collocations(frame.where("doc_id = 2")).count() == 0
    nothing = spark.createDataFrame([(1, None, None, "", 0), (2, " . ", "en", "", 0)], SCHEMA)
    assert phrase_mining.collocations(nothing).count() == 0
    wide = spark.sql("SELECT 9000000000000000000L AS a, 9100000000000000000L AS l, 9200000000000000000L AS r")
    exact = wide.selectExpr("(cast(a AS decimal(20, 0)) * 2000000BD) div (cast(l AS decimal(20, 0)) + r) AS score").first()
    assert exact.score == 2_000_000 * 9 * 10**18 // (18_300_000_000_000_000_000)


def test_query_matches_sql(spark, sf):
    name = "op12_phrase_mining"
    assert difference(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLE[name]) is None
