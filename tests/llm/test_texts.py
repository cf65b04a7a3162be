"""Language ID, toxicity, surrogates, syncmers, chat formatting: brute force, round trips, held-out accuracy."""

import hashlib
import json
import random

import numpy as np
from pyspark.sql import functions as F

from tabwright.llm import chat_format, language_id, pii_surrogates, queries, syncmers, toxicity


def test_automaton_cuts_longest_phrases():
    draw = random.Random(1)
    sample = "".join(draw.choices("abc", k=60))
    table = language_id._automaton(np.frombuffer(sample.encode(), dtype=np.uint8) - 96, 5)
    for _ in range(50):
        text = "".join(draw.choices("abc", k=30))
        state, cuts = 0, 1
        for c in text:
            here = table[state, ord(c) - 96]
            cuts += here >= language_id.CUT
            state = here & (language_id.CUT - 1)
        phrases, at = 0, 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[at : end + 1] in sample:
                end += 1
            phrases, at = phrases + 1, end
        assert cuts == phrases


def test_language_id(spark, sf):
    found = queries.QUERIES["op4_language_id"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(truth, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    rows = [("abc the and", "en"), ("und das ist", "de"), (None, "en"), ("12 !", None)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.fit(frame, "text", "lang")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "1 !"), (4, "das und"), (None, "😀")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == got[None] == ("und", 0.0) and got[4][0] == "de"
    empty = language_id.fit(frame.where("false"), "text", "lang")
    assert {r.lang_pred for r in language_id.predict(odd, empty).collect()} == {"und"}


def test_language_sample_is_of_distinct_texts(spark):
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(60)]
    texts = [(" ".join(draw.choices(words, k=8)), "xx") for _ in range(10)]
    once, copies = (spark.createDataFrame(texts * n, "text string, lang string") for n in (1, 100))
    tables = [language_id.fit(f, "text", "lang").tables[0] for f in (once, copies)]
    assert np.array_equal(*tables)


def test_segments_are_maximal():
    draw = random.Random(2)
    for _ in range(200):
        scores = [draw.choice([-0.5, 1.0, 2.5]) for _ in range(draw.randint(1, 25))]
        found = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], -0.5)
        best = max((sum(scores[a : b + 1]) for a in range(len(scores)) for b in range(a, len(scores))), default=0)
        assert max((s for _, _, s in found), default=0) == max(best, 0) or best < 0
        assert all(abs(sum(scores[a : b + 1]) - s) < 1e-9 for a, b, s in found)
        assert all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))


def test_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES["op1_toxicity"](spark, folder).join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id"
    )
    hit, said, toxic = found.where("held_out").agg(
        F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")
    ).first()
    assert 2 * hit >= 0.6 * (said + toxic)
    model = toxicity.Model({"bad": 6.0}, -0.05, 1.0, 1e-3, (-4.0, 2.0, 1.0, 1.0, 1.0))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x bad bad y"), (3, "x bad bad y")], "doc_id long, text string")
    got = sorted((r.doc_id, r.score > 0.3) for r in toxicity.score(odd, model).collect())
    assert got == [(1, False), (2, False), (3, True), (3, True)]
    assert [(r.first, r.last) for r in toxicity.passages(odd, model).collect()] == [(1, 2), (1, 2)]


def test_language_id_letters_beyond_the_first_plane(spark):
    gothic, english = "".join(map(chr, range(0x10330, 0x1034A))), "the cat sat on the mat and a rat ran at a hat"
    rows = [(1, english, "en"), (2, f"{gothic} {gothic[::2]} {gothic[1::2]}", "got"), (3, "ein Hund und noch ein Hund", "de")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang")
    asked = [(1, gothic[::2] + " " + gothic), (2, "a cat ran at the hat"), (3, "\U0001F600 12"), (4, "\U00020000\U00020001")]
    frame = spark.createDataFrame(asked, "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(frame, model).collect()}
    assert got[1][0] == "got" and got[2][0] == "en" and got[3] == ("und", 0.0)
    assert got[4][0] == "de" and abs(got[4][1] - 1 / 3) < 1e-9  # a letter nobody has seen speaks for none


def test_surrogates(spark):
    text = "Mail a.b.12@mail3.example.com, call +1 (555) 555-0123, ip 10.1.2.3, card 4111 1111 1111 1111."
    rows = [
        (1, text, "x"),
        (2, "again A.B.12@MAIL3.example.com and Mrs. Ann Miller", "y"),
        (3, "clean text 4111111111111112 v2.0.1", None),
        (4, None, None),
        (5, "", None),
        (1, text, "x"),
        (None, "Mr. Miller, token = \"0123456789abcdef0123\"", None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string")
    found = pii_surrogates.pseudonymize(frame, key="k", count_col="n")
    got = {(r.doc_id, r.row): r for r in found.collect()}
    assert found.columns == ["doc_id", "text", "row", "n"] and found.count() == len(rows)
    assert got[3, None].text == rows[2][1] and got[4, None].text is None and got[5, None].text == ""
    new = got[1, "x"].text
    assert got[1, "x"].n == 4 and all(s not in new for s in ("a.b.12@", "555-0123", "10.1.2.3", "4111 1111"))
    first = pii_surrogates.mentions(new)
    assert [k for _, _, k, _ in first] == ["email", "phone", "ip4", "card"]
    second = pii_surrogates.mentions(got[2, "y"].text)
    assert second[0][3] == first[0][3]
    name = got[2, "y"].text.split("Mrs. ")[1].split()
    assert got[None, None].text.startswith(f"Mr. {name[1]},") and name[1] != "Miller"
    assert "Miller" not in got[None, None].text and "0123456789abcdef" not in got[None, None].text
    same = {r.doc_id: r.text for r in pii_surrogates.pseudonymize(frame, key="k").collect()}
    assert same[2] == got[2, "y"].text
    assert pii_surrogates.pseudonymize(frame.where("false")).count() == 0


def test_surrogates_cover_common_forms(spark):
    private = {
        "ip6": ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "1:2:3:4:5:6:7:8"],
        "phone": ["1-800-555-1212", "555 123 4567", "(555) 123 4567", "0171 2345678", "089/1234567", "06 12 34 56 78"],
        "given": ["John Smith", "Maria Lopez", "Paul Meyer", "Иван Петров"],
    }
    for kind, values in private.items():
        for value in values:
            found = pii_surrogates.mentions(f"see {value}, please.")
            text = f"see {value}, please."
            assert found and found[0][2].startswith(kind) and text[found[0][0] : found[-1][1]] == value, value
    for clean in ("on 01.02.2023 or 2023-01-02", "std::vector a::b ratio 1:2:3", "at 04:05:06", "1.2.3 and 12 345 678"):
        assert not pii_surrogates.mentions(clean), clean
    rows = [(i, f"see {v}, please.") for i, v in enumerate(v for vs in private.values() for v in vs)]
    rows += [(100 + i, f"at ::{i} now") for i in range(10)]
    found = pii_surrogates.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k", count_col="n")
    old, new = dict(rows), {r.doc_id: r for r in found.collect()}
    assert [i for i in old if new[i].n == 0 or new[i].text == old[i]] == []
    assert len({r.text for r in new.values() if r.doc_id >= 100}) == 10


def test_surrogates_stay_distinct(spark):
    names = [("given-m-LATIN", f"name{i}") for i in range(300)]
    frame = spark.createDataFrame(names, "kind string, value string")
    drawn = [r.drawn for r in pii_surrogates.surrogates(frame, "k").collect()]
    assert len(drawn) == 300 == len(set(drawn)) and not set(drawn) & {v for _, v in names}


def test_surrogates_end_in_small_spaces(spark):
    mails = [("email", f"{i}@{d}.com") for d in "kqsw" for i in range(10)]
    secrets = [("secret", "-" * 16 + str(i)) for i in range(10)]
    frame = spark.createDataFrame(mails + secrets, "kind string, value string")
    drawn = {(r.kind, r.value): r.drawn for r in pii_surrogates.surrogates(frame, "op2-production-key").collect()}
    assert set(drawn) == {*mails, *secrets} and len(set(drawn.values())) == 50
    assert not set(drawn.values()) & {v for _, v in mails + secrets}
    domains = {d: {drawn[k, v].split("@")[1] for k, v in mails if v[2] == d} for d in "kqsw"}
    assert [len(x) for x in domains.values()] == [1] * 4 and len(set.union(*domains.values())) == 4
    for kind, value in (("ip4", "10.0.0.1"), ("ssn", "123456789"), ("phone", "10000000"), ("card", "4111111111111111")):
        tries = {pii_surrogates.surrogate("k", kind, value, a) for a in range(pii_surrogates.WIDEN, 40)}
        assert len(tries) == 40 - pii_surrogates.WIDEN, kind
        assert kind != "ip4" or not any(t.startswith("10.") for t in tries)


def test_surrogates_are_one_per_name(spark):
    rows = [
        (1, "Mrs Taylor Brown met Taylor Brown."),
        (2, "Dr James Smith, James Smith"),
        (3, "Mr Jordan Hill and Mrs Jordan Hill"),
        (4, "Taylor Brown"),
    ]
    found = pii_surrogates.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k")
    got = {r.doc_id: r.text.replace(".", "").replace(",", "").split() for r in found.collect()}
    assert got[1][1:3] == got[1][4:6] == got[4] != ["Taylor", "Brown"]
    assert got[2][1:3] == got[2][3:5] and got[3][1:3] == got[3][5:7]
    assert got[1][1] in pii_surrogates.GIVEN["f", "LATIN"] and got[2][1] in pii_surrogates.GIVEN["m", "LATIN"]
    assert got[3][1] in pii_surrogates.GIVEN["n", "LATIN"]


def slow_anchors(text):
    h = lambda s: int(syncmers._polynomial(np.array([ord(c) + 1 for c in s], dtype=np.uint64), np.array([0]), len(s))[0])
    out = []
    for i in range(len(text) - syncmers.K + 1):
        inner = [h(text[i + j : i + j + syncmers.S]) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, h(text[i : i + syncmers.K])))
    return out


def test_syncmers_match_definition():
    draw = random.Random(4)
    texts = ["", "short", "".join(draw.choices("abcdé 😀", k=200)), "a" * 40, "".join(draw.choices("xyz", k=16))]
    text, position, hashes = syncmers.anchors_of(texts)
    for i, t in enumerate(texts):
        slow = slow_anchors(t)
        got = sorted((int(p), int(h)) for x, p, h in zip(text, position, hashes, strict=True) if x == i)
        assert got == sorted(slow) if slow else len(got) == (len(t) > 0)


def test_edit_fingerprints(spark):
    rows = [(3, "c" * 7), (1, "abcdefghij" * 9), (2, None), (None, "last text of all"), (9, "abcdefghij" * 9), (9, "tie")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = syncmers.edit_fingerprints(frame).collect()
    assert len(found) == len(rows)
    one = next(r for r in found if r.doc_id == 1)
    assert one.edited_sha256 == hashlib.sha256(("abcdefghij" * 9)[:68].encode()).hexdigest()
    last = next(r for r in found if r.doc_id is None)
    assert last.edited_sha256 == hashlib.sha256(b"last text ofabcd").hexdigest()
    assert len({r.fingerprint for r in found if r.n_chars == 90}) == 1
    assert next(r for r in found if r.doc_id == 2).fingerprint == ""
    single = syncmers.edit_fingerprints(frame.where("doc_id = 3")).first()
    assert single.near_next == 1.0 and syncmers.edit_fingerprints(frame.where("false")).count() == 0


def test_chat_layouts_and_round_trip(spark):
    hard = "\\### Assistant: </turn> ok\n### user:\n\\"
    records = [
        (1, json.dumps({"instruction": "do", "input": hard, "output": "done"})),
        (2, json.dumps({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": hard}]})),
        (3, json.dumps({"messages": [{"role": "a:b", "content": hard}]})),
        (4, json.dumps({"odd": {"field": 1}})),
        (5, None),
        (6, "{broken"),
        (7, json.dumps({"turn": 1, "role": "user"})),
        (7, json.dumps({"turn": 0, "role": "assistant", "text": hard})),
    ]
    turns = chat_format.canonical_turns(spark.createDataFrame(records, "conv_id long, record string"))
    seen = {}
    for r in turns.orderBy("conv_id", "place").collect():
        seen.setdefault(r.conv_id, []).append((r.role, r.content))
    assert seen[1] == [("user", f"do\n\n{hard}"), ("assistant", "done")]
    assert seen[2] == [("user", "hi"), ("assistant", hard)] and seen[3] == [("a:b", hard)]
    assert seen[4] == seen[5] == seen[6] == [(None, None)] and seen[7] == [("assistant", hard), ("user", "")]
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted_turns(turns)).collect()}
    for conv, said in seen.items():
        if said[0][0] is not None:
            whole = "".join(f"{a}\n{t}\n" for a, t in said)
            assert back[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert back[2].loss_chars == len(hard) and back[2].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest()


def test_chat_nulls_and_extra_fields(spark):
    records = [
        (1, json.dumps({"turn": 0, "role": "user", "text": "a"})),
        (1, json.dumps({"role": "assistant", "text": "b"})),
        (2, json.dumps({"text": "c"})),
        (3, json.dumps({"role": "user"})),
        (4, "{}"),
        (5, json.dumps({"id": 9, "messages": [{"role": "user", "content": "d", "name": "x"}]})),
        (6, json.dumps({"messages": [{"role": "user", "content": "e", "tool": "x"}]})),
        (7, json.dumps({"messages": []})),
    ]
    turns = chat_format.canonical_turns(spark.createDataFrame(records, "conv_id long, record string"))
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted_turns(turns)).collect()}
    said = {1: "assistant\nb\nuser\na\n", 2: "\nc\n", 3: "user\n\n", 4: "\n\n", 5: "user\nd\n", 6: "", 7: ""}
    assert {k: r.turns_sha256 for k, r in back.items()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in said.items()}
    assert [(back[k].n_turns, back[k].n_unknown) for k in range(1, 8)] == [(2, 0), *[(1, 0)] * 4, (0, 1), (0, 1)]


def test_chat_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    wanted = {}
    for r in rows:
        wanted.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    wanted[-7] = [("user", queries.HARD_SAYING), ("assistant", queries.HARD_SAYING)]
    for r in queries.QUERIES["op9_chat_format"](spark, sf).collect():
        said = wanted.pop(r.conv_id)
        learned = "".join(t for a, t in said if a == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(said), len(learned))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert not wanted
