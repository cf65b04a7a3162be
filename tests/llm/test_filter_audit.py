"""Filter orders: a brute-force version over single documents, SQL, and odd inputs."""

import collections
import itertools
import random
import re

import pytest

from tabwright.llm import queries
from tabwright.llm.filter_audit import Limits, audit, failure_cells, filter_audit
from tests.compare import difference, duck

DOCS = "doc_id long, text string, lang string, mask int, good string"
LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(docs):
    """The set of filters that each row fails."""
    found = []
    for i, text, *_ in docs:
        t = text or ""
        words = WORD.findall(t)
        own = set()
        if len(words) < 200:
            own.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            own.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            own.add("C")
        if any(c in "#$%&*|" for c in t):
            own.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs):
            own.add("E")
        found.append(own)
    return found


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = fails(docs)
    rows, removed_by = [], collections.Counter()
    for part in {d[2] or "" for d in docs}:
        own = [(d[0], f) for d, f in zip(docs, failed, strict=True) if (d[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                earlier = set(order[: step - 1])
                removed_by[part, letter] += len(gone)
                rows.append(
                    {
                        "part": part,
                        "filter_order": "".join(order),
                        "step": step,
                        "kept": len(left),
                        "removed": len(gone),
                        "redundant": sum(letter in f and bool(f & earlier) for _, f in own),
                        "unique_fails": sum(f == {letter} for _, f in own),
                        "good_lost": sum(i in good for i, _ in gone),
                        "toxic_lost": sum(i in toxic for i, _ in gone),
                    }
                )
    return sorted((tuple(r.items()), removed_by[r["part"], r["filter_order"][r["step"] - 1]]) for r in rows)


def rows_of(found):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return sorted((tuple((n, r[n]) for n in names), r["shapley"]) for r in found.collect())


def odd_docs():
    draw = random.Random(13)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "A", "é # x", "Ünï\x0bcode\x1cone word", "x" * 300_000, "long " * 60_000]
    for _ in range(30):
        body = draw.choices(words if draw.random() < 0.5 else words[:20], k=draw.choice([5, 199, 200, 201, 400]))
        text = " ".join(body)
        texts.append((text.upper() if draw.random() < 0.2 else text) + draw.choice(["", "", " 5%", "\n"]))
    rows = [(draw.randrange(40), draw.choice(texts), draw.choice(["en", "de", "", None])) for _ in range(150)]
    rows += [(None, texts[9], "en"), (None, texts[9], None), (50, texts[9], "de"), (50, texts[9], "de")]
    return [(*r, 7, "kept out") for r in rows]


def test_orders_match_brute_force(spark):
    docs = odd_docs()
    labels = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 60, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    found = filter_audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    assert rows_of(found) == brute(docs, labels)


def test_a_third_of_all_rows_one_text(spark):
    docs = [(i, "same text" if i % 3 == 0 else f"text {i} & more", "en" if i % 2 else None, 0, "") for i in range(900)]
    found = filter_audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS))
    by = {(r.part, r.filter_order, r.step): r for r in found.collect()}
    assert by["", "EABCD", 1].removed + by["en", "EABCD", 1].removed == 299
    assert by["", "EABCD", 1].good_lost == 0 and by["en", "EABCD", 5].kept == 0


def test_empty_tables_and_bad_letters(spark):
    none = spark.createDataFrame([], DOCS)
    assert filter_audit(none, spark.createDataFrame([], LABELS)).count() == 0
    cells = spark.createDataFrame([("x", 1, 5, 2, 1), (None, 3, 4, 0, 0)], "part string, mask int, docs long, good long, toxic long")
    two = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in audit(cells, "PQ").collect()}
    assert two["x", "PQ", 1] == (0, 5, 0, 10) and two["", "QP", 2] == (0, 0, 4, 4) and len(two) == 8
    for letters in ("", "AA", "ABCDEFGH", "A'"):
        with pytest.raises(ValueError):
            audit(cells, letters)


def test_limits_are_parameters(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", 0, ""), (2, "a ~", "en", 0, "")], DOCS)
    labels = spark.createDataFrame([], LABELS)
    cells = failure_cells(docs, labels, Limits(least_words=3, signs=b"~")).collect()
    assert sorted((c["mask"], c["docs"]) for c in cells) == [(0, 1), (9, 1)]


def test_query_matches_sql(spark, sf):
    name = "op13_filter_audit"
    assert difference(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLE[name]) is None
