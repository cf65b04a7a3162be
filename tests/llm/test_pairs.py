"""Word hashes, components, the prefix join and the positional index against brute force."""

import random
import re

import pytest

from tabwright.llm import queries
from tabwright.llm.graph import components
from tabwright.llm.jaccard_join import Similarity, jaccard_join
from tabwright.llm.positional_index import contamination, proximity_matches
from tabwright.llm.texts import split_words, word_hashes
from tests.compare import difference, duck

DOCS = "doc_id long, text string, lang string, k1 string"


def test_word_hashes_tell_words_apart():
    texts = [b"", b" A b\ta ", b"\n", b"b", "é É".encode()]
    found = [h.tolist() for h in word_hashes(texts)]
    assert [len(h) for h in found] == [len(split_words(t)) for t in texts]
    assert found[1][0] == found[1][2] and found[1][1] == found[3][0] and found[4][0] != found[4][1]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 300)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_join(rows, width, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        many = max(1, len(words) - width + 1) if words else 0
        sets.append({tuple(words[i : i + width]) for i in range(many)})
    ids = [i for i, _ in rows]
    root = {i: i for i in ids}
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if ids[a] is None or ids[b] is None or not sets[a] or not sets[b]:
                continue
            if 100 * both >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(find(i)), n) for (i, _), s, n in zip(rows, sets, links, strict=True))


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, width, percent):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choices(words, k=draw.randint(2, 90)) for _ in range(25)]
    rows = [(None, "a b c d"), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "a b c d")]
    for i in range(160):
        text = list(base[i % 25])
        for _ in range(draw.randint(0, 3)):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(5, rows[12][1]), (5, rows[12][1])]
    frame = spark.createDataFrame([(i, t, None, "x") for i, t in rows], DOCS)
    found = jaccard_join(frame, Similarity(width, percent)).collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in found)
    assert got == brute_join(rows, width, percent)
    assert jaccard_join(spark.createDataFrame([], DOCS)).count() == 0


def test_large_near_copy_group_is_split(spark):
    """Hundreds of near copies in one group: tiles are cut, no link is lost or counted twice."""
    text = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join([*text[:-1], f"end{i}"])) for i in range(700)]
    found = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), Similarity(3, 90)).collect()
    assert {(r.component_id, r.n_links) for r in found} == {(0, 699)}


def test_row_without_id_ahead_of_its_copy(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words, "more"])
    rows = [(None, text, None, "c"), (2, text, None, "c"), (1, near, None, "c")]
    found = jaccard_join(spark.createDataFrame(rows, DOCS).coalesce(1), Similarity(5, 80)).collect()
    assert {(r.doc_id, r.component_id, r.n_links) for r in found} == {(None, None, 0), (2, 1, 1), (1, 1, 1)}


def test_contamination_matches_sql(spark, sf):
    name = "op8_positional_index"
    assert difference(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLE[name]) is None


def test_contamination_edges(spark):
    item = "The quick brown fox jumps over the lazy dog today again"
    items = [("a", item), ("a", item), ("b", "short item"), ("c", ""), ("d", None), ("e", "zz " * 12)]
    docs = [
        (1, f"x {item.upper()} y", None, "c"),
        (2, "a Short, ITEM! and short", None, "c"),
        (3, None, None, "c"),
        (None, item, None, "c"),
        (4, "", None, "c"),
        (5, "quick brown fox jumps over the lazy dog today", None, "c"),
        (6, "zz " * 15, None, "c"),
        (1, "other text under the same id", None, "c"),
    ]
    found = contamination(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id string, text string")
    ).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r.item_ids)) for r in found)
    assert got == sorted(
        [
            ("1", 13, 11, ("a",)),
            ("2", 5, 2, ("b",)),
            ("3", 0, 0, ()),
            ("None", 11, 11, ("a",)),
            ("4", 0, 0, ()),
            ("5", 9, 0, ()),
            ("6", 15, 15, ("e",)),
            ("1", 6, 0, ()),
        ]
    )


def test_documents_that_begin_inside_an_item(spark):
    words = [f"w{i}" for i in range(46)]
    parts = {1: words[20:41], 2: ["a", "b", "c", "d", "e", *words[30:46]], 3: words[-10:], 4: words[-9:], 5: words[:12]}
    docs = spark.createDataFrame([(k, " ".join(w), None, "c") for k, w in parts.items()], DOCS)
    found = contamination(docs, spark.createDataFrame([("a", " ".join(words))], "item_id string, text string"))
    assert {r.doc_id: r.n_hit for r in found.collect()} == {1: 21, 2: 16, 3: 10, 4: 0, 5: 12}


def test_proximity(spark):
    docs = [(1, "red x x blue green"), (2, "green blue x red"), (3, "red x x x blue x green"), (4, None)]
    items = [("i", "blue green red")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    found = proximity_matches(*frames, span=5)
    assert sorted(r.start for r in found.collect()) == [0, 0]
    assert found.select("k1").distinct().count() == 2


def test_jaccard_query_matches_sql(spark, sf):
    name = "op6_jaccard_join"
    assert difference(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLE[name]) is None
