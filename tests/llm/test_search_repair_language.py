"""Ranked search, conversation repair and language ID against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pandas
import pytest

from cellweave.llm import langid, lexical, queries, repair


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -score) for r, (score, _, _, doc) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("options", [{}, {"shard_terms": 40}])
def test_search_equals_scoring_every_document(spark, options):
    r = random.Random(4)
    words = ["the", "of", "É", "naïve", "x1", "B", "c_d", "42", "zz"]
    texts = [" ".join(r.choice(words) + r.choice(["", ".", "-", "Q"]) for _ in range(r.choice((0, 1, 3, 3, 40)))) for _ in range(80)]
    docs = [*enumerate(texts), (200, None), (201, ""), (202, "?!"), (7, texts[7]), (203, "the of " * 30_000), *[(300 + i, "same same text") for i in range(30)]]
    items = [(1, "The naïve B"), (2, "same text"), (2, "x1 of of"), (3, None), (4, ""), (5, "unseen"), (6, "c d 42 zz " * 9)]
    table = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, score int, item int").repartition(5)
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc int")
    got = lexical.LexicalIndex(table, **options).search(asked, k=10, block_bytes=30)
    assert sorted(tuple(x) for x in got.collect()) == sorted(ranked(docs, items, 10))


def test_search_with_null_ids_and_empty_tables(spark):
    table = spark.createDataFrame([(None, "one two"), (5, "one two"), (None, "one two"), (3, "three")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "two")], "item_id long, text string")
    assert [r["doc_id"] for r in lexical.search_ranked(table, asked, 2).orderBy("rank").collect()] == [5, None]
    assert lexical.search_ranked(table.limit(0), asked).count() == 0
    assert lexical.search_ranked(table, asked.limit(0)).count() == 0


# --- repair

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(initials, faults):
    """(cost, audit), by keeping the least of each state after every edit."""

    def with_insertions(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                for c, to in NEXT[state].items():
                    if c != "s":
                        best[to] = min(best.get(to, (9e9, "")), (cost + 5, audit + "I"))
        return best

    best = with_insertions({"": (0, "")})
    for initial, fault in zip(initials, faults, strict=True):
        new = {}
        for state, (cost, audit) in best.items():
            new[state] = min(new.get(state, (9e9, "")), (cost + 2, audit + "D"))
            if fault != "x":
                for c, to in NEXT[state].items():
                    for price, op in [(0, "K")] * (c == initial) + [(1, "R")] * (c != "s"):
                        new[to] = min(new.get(to, (9e9, "")), (cost + price + 5 * (fault == "t"), audit + op))
        best = with_insertions(new)
    return min(v for state, v in best.items() if state in ("", "a"))


def test_trace_equals_dynamic_programming():
    r = random.Random(9)
    for k in range(4000):
        n = r.randrange(16) if k % 100 else 400
        initials = "".join(r.choice("ssuuuaaa-") for _ in range(n))
        faults = "".join(r.choice("---xtt" if k % 2 else "------xt") for _ in range(n))
        assert repair.trace(initials, faults) == cheapest(initials, faults)


def reported(rows):
    """The report of damaged conversations in plain Python."""
    damaged = {}
    for conv, turn, role, text in rows:
        damaged.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text, role = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text, "user" if h == 4 else role
        damaged[conv] += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = []
    for conv, turns in damaged.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        seen, kinds = set(), []
        for _, role, text in turns:
            said = text.strip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [t[1][:1] if t[1][:1] in ("s", "u", "a") else "-" for t in turns]
        cost, audit = cheapest(initials, ["x" if k in ("blank", "duplicate") else "t" if k else "-" for k in kinds]) if turns else (0, "")
        lines, at, state = [], 0, ""
        for op in audit:
            if op == "D":
                at += 1
                continue
            if op == "K" and initials[at] == "s":
                state = "s"
            else:
                state = "a" if state == "u" else "u"
            lines.append(f"{turns[at][1] if op == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{'' if op == 'I' else turns[at][2]}")
            at += op != "I"
        numbers = {t[0] for t in turns if t[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        pairs = sum(turns[i][1][:1] + turns[i + 1][1][:1] not in ("su", "ua", "au") for i in range(len(turns) - 1))
        out.append((conv, gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        for turn in r.sample(range(12), r.randrange(1, 9)):
            text = r.choice(["Yes.", "No!", "Why?", "and so", "", None, " \n\t", "Same.", f"Turn {turn}.\x0b", "Ends. "])
            rows.append((conv, r.choice([turn, turn, turn, turn, None]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), text))
    rows += [(100, t, "user" if t % 2 else "assistant", r.choice(["a.", "b", f"{t}."])) for t in range(500)]
    return rows


def test_report_equals_plain_python(spark):
    rows = conversations(3)
    table = spark.createDataFrame([(*x, 1, "y") for x in rows], "conv_id long, turn long, role string, text string, pos int, op string").repartition(3)
    got = repair.report(table, repair.damaged(table))
    assert sorted((tuple(x) for x in got.collect()), key=str) == reported(rows)
    assert repair.report(table.limit(0)).count() == 0


def test_sql_of_repair_equals_plain_python():
    con = duckdb.connect()
    rows = conversations(5)
    con.register("raw", pandas.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.sql("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM raw")
    assert sorted(con.sql(queries.ORACLE_SQL["op12_conversation_repair"]).fetchall(), key=str) == reported(rows)


def test_repaired_turns_follow_the_grammar(spark):
    table = spark.createDataFrame(conversations(6), "conv_id long, turn long, role string, text string")
    rows = repair.judged(table)
    by = {}
    for x in repair.repaired(rows, repair.edits(rows)).orderBy("pos").collect():
        by.setdefault(x["conv_id"], []).append("" if x["role"] is None else x["role"][0])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in by.values())


# --- language

SYLLABLES = {"aa": ["the", "ing", "wh", "th", "er"], "bb": ["ung", "sch", "ein", "ü", "ver"], "cc": ["ción", "que", "ñ", "os", "ll"]}


def prose(lang, r, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    r = random.Random(2)
    rows = [(i, prose(lang := r.choice(list(SYLLABLES)), r, r.choice((8, 30, 200))), lang, "s") for i in range(400)]
    rows += [(500, None, "aa", "s"), (501, "", "bb", "s"), (502, "12 34 !?", "cc", "s"), (503, prose("bb", r, 40_000), None, "s"), (None, prose("cc", r, 30), "cc", "s"), (504, prose("aa", r, 30).upper(), "aa", "s"), (504, rows[0][1], None, "s")]
    rows += [(600 + i, "copy of the thing", "aa", "s") for i in range(300)]
    table = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, lang string, source string, score double")
    got = langid.identify(table).collect()
    assert len(got) == len(rows)
    truth = {x[0]: x[2] for x in rows[:400]}
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got if x["doc_id"] is not None)
    assert len(held) > 60 and sum(x["lang_pred"] == truth[x["doc_id"]] for x in held) >= 0.97 * len(held)
    one = {x["doc_id"]: x for x in got}
    assert all(one[i]["lang_pred"] == "und" and one[i]["score"] == 0 and not one[i]["certain"] for i in (500, 501, 502))
    assert one[503]["lang_pred"] == "bb" and one[None]["lang_pred"] == "cc" and not one[None]["held_out"]
    assert all(0 <= x["score"] <= 1 and x["lang_pred"] in (*SYLLABLES, "und") for x in got)


def test_language_without_training_rows_and_with_one(spark):
    table = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [x["lang_pred"] for x in langid.identify(table).collect()] == ["und"]
    assert langid.identify(table.limit(0)).count() == 0
    found = langid.predict(table, {"xx": b"some words of it"}).first()
    assert found["lang_pred"] == "xx" and found["score"] > 0


def test_narrow_margins_are_not_certain(spark):
    table = spark.createDataFrame([(1, "the thing wher werther"), (2, "einung schver ver ung"), (3, "qqq zzz kkk")], "doc_id long, text string")
    found = {x["doc_id"]: x for x in langid.predict(table, {"aa": b"the thing wher werther", "bb": b"einung schver ver ung"}).collect()}
    assert found[1]["lang_pred"] == "aa" and found[2]["lang_pred"] == "bb" and found[1]["certain"] and found[2]["certain"]
    assert not found[3]["certain"]


def test_dictionaries_are_bounded_and_hold_copies_once(spark):
    rows = [(f"text number {i} " * 50, "aa") for i in range(500)] + [("copy", "aa")] * 500 + [("x" * 100_000, "bb")]
    found = langid.fit(spark.createDataFrame(rows, "text string, lang string"), pieces=50, piece=30, dict_bytes=1000)
    assert list(found) == ["aa", "bb"] and len(found["aa"]) == 1000 and len(found["bb"]) == 30
    assert found["aa"].split(b"\n").count(b"copy") <= 1
