"""The operators against plain Python on small random tables: base columns, joins and scores."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas
import pytest

from cellweave.llm import fertility, hmm, jaccard_join, licenses, line_dedup, mixing, multi_index, packing, pii, queries, warc

WORDS = [f"w{i}" for i in range(40)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def near_copies(seed, n=60):
    """Texts in groups of copies with a few words changed, longer, shorter, empty and null ones."""
    r = random.Random(seed)
    base = [[r.choice(WORDS) + str(r.randrange(60)) for _ in range(r.choice((1, 2, 5, 30, 60)))] for _ in range(8)]
    texts = []
    for _ in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
            at = r.randrange(len(t) + 1)
            t[at : at + r.choice((0, 1))] = [r.choice(WORDS)] * r.choice((0, 1))
        texts.append(" ".join(t))
    return [*texts, None, "", "  \n", "One", "one", "A b"]


def components(texts, width, percent):
    sets = [{tuple(w[i : i + min(width, len(w))]) for i in range(len(w) - min(width, len(w)) + 1)} if (w := words_of(t)) else set() for t in texts]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return [(i, len(s), label[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent", "options"), [(3, 90, {}), (2, 80, {"block": 5, "mass": 300, "drawn": 3}), (5, 80, {"block": 3, "mass": 100, "drawn": 2}), (1, 76, {})])
def test_jaccard_components_equal_all_pairs(spark, width, percent, options):
    texts = near_copies(width)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS point", "2 AS mark", "3 AS cell", "4 AS n")
    got = jaccard_join.components(table, width=width, percent=percent, **options)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == components(texts, width, percent)
    kept = jaccard_join.one_of_each(table, width=width, percent=percent, **options)
    assert kept.columns == table.columns and kept.count() == len({c for _, _, c in components(texts, width, percent)})


def test_keys_that_a_partner_must_have():
    r = np.random.default_rng(2)
    for _ in range(2000):
        percent, n = int(r.choice([76, 80, 90, 95])), int(r.integers(4, 60))
        x = np.unique(r.integers(-(2**62), 2**62, n))
        y = np.unique(np.concatenate([r.permutation(x)[int(r.integers(0, 3)) :], r.integers(-(2**62), 2**62, int(r.integers(0, 3)))]))
        both = len(np.intersect1d(x, y))
        if len(x) == len(y) == both or 100 * both < percent * (len(x) + len(y) - both):
            continue
        (a, ka), (b, kb) = jaccard_join.keys_of(x, percent), jaccard_join.keys_of(y, percent)
        assert len(np.intersect1d(a, b)) >= max(len(a) - ka, len(b) - kb) > 0


def near(a, b):
    """Within one edit."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def test_line_dedup_equals_all_pairs(spark):
    r = random.Random(4)
    lines = ["".join(r.choice("abc ") for _ in range(r.choice((0, 3, 7, 8, 9, 14, 40, 700)))) for _ in range(40)]
    for x in list(lines):
        at = r.randrange(len(x) + 1)
        lines.append(x[:at] + r.choice(("", "d", "é")) + x[at + r.choice((0, 1)) :])
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(6)))) for i in range(40)]
    seen, want = [], {}
    for i, text in docs:
        kept = []
        for x in text.split("\n"):
            if not x.strip(" "):
                kept.append(x)
                continue
            if not any(x == y or (min(len(x), len(y)) >= 8 and near(x, y)) for y in seen):
                kept.append(x)
            seen.append(x)
        want[i] = "\n".join(kept)
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS n_lines", "'y' AS near")
    got = line_dedup.dedup_lines(table)
    assert got.columns == ["doc_id", "text", "near", "n_lines", "n_equal", "n_near"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert line_dedup.dedup_lines(table, counts=False).columns == table.columns
    con = duckdb.connect()
    con.register("documents", pandas.DataFrame(docs, columns=["doc_id", "text"]))
    sql = {r[0]: r[1:] for r in con.sql(queries.ORACLE_SQL["op9_line_dedup"]).fetchall()}
    assert sql == {r["doc_id"]: (r["n_lines"], r["n_equal"], r["n_near"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got.collect()}


def test_lines_of_any_length(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(4500))
    lines = ["short line abc", "short line abd", long + "x", long + "y"]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_near"] for r in got] == [0, 1, 0, 1]


def base_pii(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_base_spans_equal_the_patterns(spark):
    r = random.Random(5)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "10.0.0.256", "001.02.3.4.5", "+1 (017) 555-7713", "+4", "a@b.c", "x.y@z", "@", ".", " ", "é", "12", "-", "+", "word"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(400)]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {g["doc_id"]: g["base"] for g in got} == {i: base_pii(t) for i, t in enumerate(texts)}
    assert all(set(filter(None, g["base"].split(","))) <= set(g["spans"].split(",")) for g in got)


def test_licence_base_columns_equal_a_scan(spark):
    r = random.Random(6)
    bits = ["gnu", "General", "public", "LICENSE", "apache", "license", "cc", "by", "mit", "x", ".", "\n", "-"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(150)] + [None, ""]
    got = {g["doc_id"]: g for g in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        at = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in at]
        g = got[i]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert g["base_labels"] == ",".join(sorted({x for _, x in at})) and set(g["base_labels"].split(",")) <= {*g["labels"].split(","), ""} and 0 <= g["score"] <= 1


def test_quality_base_columns_equal_a_count(spark):
    import public_tokenizers

    r = random.Random(7)
    texts = ["\n".join(" ".join(r.choice(("a", "b#", "cé", "d|", "ee")) for _ in range(r.randrange(9))) for _ in range(r.randrange(20))) for _ in range(60)] + [None, "", "x " * 60]
    rows = [(i, t, None if i % 5 == 0 else "en") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS band", "2 AS script", "3 AS n_words", "4 AS kept")
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {g["doc_id"]: g for g in fertility.judge(table, path).collect()}
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if x.strip(" ")]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
        g = got[i]
        assert tuple(g[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert g["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (g["base_failed"] and g["kept"])
    good = fertility.keep_good(table, path)
    assert good.columns == table.columns and {g["doc_id"] for g in good.collect()} == {i for i, g in got.items() if g["kept"]}
    assert fertility.judge(table.where("doc_id < 0"), path).count() == 0


def test_hmm_score_is_the_sum_over_all_paths(spark):
    texts = ["a b a c", "b b a", "c a", "", "a a a b c a b"] * 6
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = hmm.HiddenMarkov(table, states=3, single=2, buckets=2, hot=2, start_docs=10, start_rounds=2, rounds=1)
    train = [words_of(t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    count = {w: sum(d.count(w) for d in train) for w in "abc"}
    order = sorted(count, key=lambda w: (-count[w], w))
    start, move, emit = (model.model[k] for k in ("start", "move", "emit"))
    for r in model.score().collect():
        total, p = 0.0, None
        for w in [*words_of(texts[r["doc_id"]]), None]:
            k = 0 if w is None else order.index(w) + 1 if order.index(w) < 2 else 3 + zlib.crc32(w.encode()) % 2
            within = 1.0 if k < 3 else (count[w] + 0.5) / (model.mass[k - 3] + 0.5 * (model.kinds[k - 3] + 1))
            p = (start if p is None else p @ move) * emit[:, k]
            total += np.log10(p.sum() * within)
            p = p / p.sum()
        assert r["score"] == pytest.approx(total)
    assert hmm.HiddenMarkov(table.where("doc_id < 0"), states=2, single=2, buckets=2, rounds=1).score().count() == 0


def test_long_sequences_train_whole():
    r = np.random.default_rng(0)
    model = {"start": r.dirichlet(np.ones(3)), "move": r.dirichlet(np.ones(3), 3), "emit": r.dirichlet(np.ones(7), 3)}
    x = r.integers(0, 7, 503)
    whole, parts = hmm.Batch([x]).expect(model), hmm.expected([x], model, part=50)
    assert all(np.allclose(whole[k], parts[k]) for k in whole)


def test_mixing_targets_and_totals(spark):
    r = random.Random(8)
    sizes = [(i, r.choice(("a", "b", "c", "d", None)), r.choice((0, 1, 5, 300, 2000))) for i in range(120)] + [(500, "tiny", 3)]
    rows = [(i, s, " ".join(["x"] * n) if n or i % 2 else None) for i, s, n in sizes]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "2 AS row", "3 AS target", "4 AS bucket")
    names = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, t, n in sizes if t == s) for s in names}
    target, left, weight = {}, float(sum(total.values())), {s: k % 3 + 1.0 for k, s in enumerate(names)}
    while True:  # share, stop what is above three times its size, share the rest again
        open_ones = [s for s in names if s not in target]
        share = {s: left * weight[s] / sum(weight[t] for t in open_ones) for s in open_ones}
        above = [s for s in open_ones if share[s] > 3 * total[s]]
        if not above:
            break
        for s in above:
            target[s] = 3.0 * total[s]
            left -= target[s]
    target |= share
    got = mixing.taken(mixing.mix(table)).collect()
    assert len(got) == len(rows) and all(g["taken"] <= 3 * g["size"] for g in got)
    for g in got:
        assert g["size"] == next(n for i, _, n in sizes if i == g["doc_id"]) and g["source_size"] == total[g["source"]]
        assert g["target"] == pytest.approx(target[g["source"]])
    for s in names:
        assert sum(g["taken"] for g in got if g["source"] == s) == pytest.approx(target[s], rel=0.05, abs=130)
    again = mixing.taken(mixing.mix(table.repartition(7))).collect()
    assert sorted((g["doc_id"], g["taken"]) for g in again) == sorted((g["doc_id"], g["taken"]) for g in got)


def test_search_finds_nine_in_ten(spark):
    r = np.random.default_rng(9)
    centres = r.standard_normal((300, 16))
    x = (centres[r.integers(0, 300, 22_000)] + 0.4 * r.standard_normal((22_000, 16))).astype(float)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    index = multi_index.MultiIndex(table, probe_rows=60)
    assert index.reach < len(x) / 4
    queries = index.entries.where("vec_id % 1000 = 0")
    got: dict = {}
    for row in index.search(queries).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 22_000, 1000):
        s = u @ u[q]
        s[q] = -9
        hits += len({v for _, v in got[q]} & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * 22


def test_search_ties_repeated_ids_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [2.0, 0.0]), (2, [1.0, 0.0]), (1, [0.0, 5.0]), (9, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS c1", "2 AS score")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in multi_index.search_every(table).orderBy("rank").collect()]
    assert got[0] == (1, 1, 1.0) and {g[1] for g in got} <= {1, 2, 3}
    assert multi_index.search_every(table.where("vec_id > 100")).count() == 0


def test_packing_of_long_texts_and_clashing_names(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    long = " ".join(f"word{i % 977}" for i in range(150_000))
    table = spark.createDataFrame([(1, long), (2, "a"), (2, "a")], "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS bucket")
    got = packing.pack_power_of_two(table, path).collect()
    pieces = sorted((r for r in got if r["doc_id"] == 1), key=lambda r: r["start"])
    ids = np.concatenate([np.frombuffer(r["token_ids"], "<u4") for r in pieces]).tolist()
    assert ids == [*packing.encode(path, long), 1] and len(pieces) > 100
    batches: dict = {}
    for r in got:
        batches.setdefault(r["batch_id"], []).append(r["length"])
    assert all(len(set(b)) == 1 and sum(b) <= 1 << 16 for b in batches.values())
    assert packing.pack_power_of_two(table.where("doc_id > 5"), path).count() == 0


def test_warc_payloads_read_back_whole(spark, tmp_path):
    r = random.Random(10)
    html = [None, "", "x" * 999, "y" * 1000, "y" * 1000, "z" * 3_000_000, "é\r\n\r\nWARC/1.1\r\n" * 100]
    rows = [(i, "http://u/\n" + str(i), r.choice(html)) for i in range(200)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS row", "2 AS payload")
    folder = f"file://{tmp_path}/w"
    index = warc.write_archive(table.coalesce(2), folder, frame_bytes=5000, bundle_bytes=500)
    assert index.select("bundle").distinct().count() > 1
    for back in (warc.read_records(spark, folder), warc.read_bundles(spark, folder)):
        got = {g["page_id"]: g for g in back.collect()}
        assert len(got) == 200
        for i, _, text in rows:
            g = got[i]
            source = got[g["refers_to"]] if g["record_type"] == "revisit" else g
            assert source["payload"] == (text or "").encode() and g["payload_digest"] == hashlib.sha1((text or "").encode()).hexdigest()
    assert warc.archive_round_trip(table.where("page_id > 500")).count() == 0
