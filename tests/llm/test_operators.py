"""Training-data operators against brute force on small fixtures, with the edge cases."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cellweave.llm import fertility, hmm, jaccard_join, licenses, line_dedup, mixing, multi_index, packing, pii, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, seconds int"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"word{i % 97} the of" for i in range(2000))
    rows = [(1, "Mail a.b@x.com or +1 (017) 555-7713 now", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, long, "en", "a"), (4, long, "en", "a"), (None, "Released under the MIT License.\nab", "de", "b"), (5, "card 4111 1111 1111 1111 then 4111-1111-1111-1111, 1.2.3.4 and 999.1.1.1\nline one two three four", "fr", "c"), (6, "line one two three fours\nline one two three four", "fr", "c")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 7) for r in rows], DOCS)


def test_packing_cuts_each_document_into_powers_of_two(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    got = packing.pack_power_of_two(docs.where("doc_id <> 4"), path).collect()
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 for r in got)
    assert len({r["sequence_id"] for r in got}) == len(got)
    for d in docs.where("doc_id <> 4").collect():
        pieces = sorted((r for r in got if r["doc_id"] == d["doc_id"]), key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["token_ids"], "<u4") for r in pieces]).tolist()
        assert ids == [*own.encode(d["text"] or "", add_special_tokens=False).ids, 1]


def test_pii_base_and_skip_links(spark, docs):
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert got[1]["base"] == "email:5:14,phone:18:35" and got[2]["spans"] == ""
    assert got[5]["n_card"] == 2 and got[5]["n_ip"] == 1
    text = "call +1 (017) 555-7713 please, or later the number (017) 555-7713 again"
    rows = [(i, text) for i in range(30)]
    more = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert more["n_phone"] == 1 and f"phone:{text.rindex('(')}:{text.rindex(' again')}" in more["spans"]


def test_pii_one_sure_mention_reaches_every_repeat(spark):
    text = "call +44 20 7946 0958 please. " + "then, some words further on, and again the number (020) 7946 0958 as above. " * 40
    got = pii.find_pii(spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string")).first()
    assert got["n_phone"] == 1 and got["n_added"] == 40


def test_emails_equal_the_pattern():
    p = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for text in ("a@b.cd@e.f", "a@b.c_x@d.e", "x@@y.z a@b", "q@r.s.t,u@v.w", "@a.b", ""):
        assert list(pii.emails(text)) == [m.span() for m in p.finditer(text)]


def test_warc_round_trip(spark, tmp_path):
    body = "x" * 1200
    pages = spark.createDataFrame([(1, "u", body), (2, "u", body), (3, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", body)], "page_id long, url string, html string")
    back = warc.archive_round_trip(pages).collect()
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back}
    assert kinds[2] == ("response", None, 1200) and kinds[1] == kinds[None] == ("revisit", 2, 1200)
    assert kinds[3][0] == kinds[4][0] == "response" and kinds[5] == ("response", None, 0)
    folder = f"file://{tmp_path}/w"
    index = warc.write_archive(pages, folder)
    one = warc.read_records(spark, folder, index.where("page_id = 2")).collect()
    assert len(one) == 1 and one[0]["payload"] == body.encode()


def test_licences(docs):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert got[None]["labels"] == "mit" and got[None]["n_base"] == 1 and got[None]["first_word"] == 3 and got[None]["score"] == 1.0
    assert got[2]["n_words"] == 0 and got[1]["labels"] == ""


def test_licences_finds_every_template_of_a_notices_file(spark):
    text = "\n".join(f"item{i} {wording}" for i, (_, wording, _) in enumerate(licenses.TEMPLATES))
    got = licenses.scan(spark.createDataFrame([(1, text), (2, "mit license")], "doc_id long, text string")).where("doc_id = 1").first()
    assert {m["template"] for m in got["matches"]} == set(range(len(licenses.TEMPLATES)))


def test_hmm_base_score_and_probability(docs):
    got = hmm.HiddenMarkov(docs, states=2, single=8, buckets=4, hot=6, start_docs=4, start_rounds=2, rounds=1).score().collect()
    train = [d for d in docs.collect() if d["doc_id"] is None or zlib.crc32(str(d["doc_id"]).encode()) % 5 != 1]
    tokens = [w for d in train for w in [*(d["text"] or "").encode().lower().split(), b"\n"]]
    count = {w: tokens.count(w) for w in set(tokens)}
    for r in got:
        text = next(d["text"] for d in docs.collect() if d["doc_id"] == r["doc_id"])
        words = [*(text or "").encode().lower().split(), b"\n"]
        base = sum(np.log10((count.get(w, 0) + 0.5) / (len(tokens) + 0.5 * (len(count) + 1))) for w in words)
        assert r["train_tokens"] == len(tokens) and r["n_tokens"] == len(words)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_search_is_exact_on_small_tables_and_skips_bad_vectors(spark):
    x = np.random.default_rng(0).standard_normal((120, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [1.0])]
    got = multi_index.search_every(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), centroids=4).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50, 100):
        s = u @ u[q]
        s[q] = -9
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == np.argsort(-s)[:5].tolist()


def test_mixing_totals(docs):
    got = mixing.taken(mixing.mix(docs, block=16)).collect()
    assert len(got) == 8 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["target"] / r["source_size"] * r["size"] for r in got if r["size"]) == pytest.approx(sum(r["size"] for r in got))


def test_line_dedup_keeps_the_earliest(docs):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[6]["text"] == "" and (got[6]["n_equal"], got[6]["n_near"]) == (1, 1)
    assert got[2]["text"] is None and got[5]["n_near"] == 0 and got[4]["seconds"] == 7


def test_line_dedup_finds_near_copies_of_long_lines(spark):
    long = " ".join(f"word{i * 7919 % 10007}" for i in range(1200))
    assert len(long) > 9000
    half = len(long) // 2
    lines = [long, long[:half] + "#" + long[half + 1 :], long[:4999] + long[5000:], "#" + long + "#", long[:4096], long[:4095]]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")).collect()}
    assert [got[i]["n_near"] for i in range(6)] == [0, 1, 1, 0, 0, 1]


def test_jaccard_components(docs):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs, width=3, percent=90).collect()), key=str)
    assert [g for g in got if g[0] == 4] == [(4, got[[g[0] for g in got].index(4)][1], 4)] * 2
    assert (2, 0, 2) in got and (3, 0, 3) in got
    assert jaccard_join.one_of_each(docs).count() == 7


def test_empty_tables(docs):
    none = docs.where("doc_id = -1")
    assert pii.find_pii(none).count() == licenses.scan(none).count() == line_dedup.dedup_lines(none).count() == 0
    assert mixing.taken(mixing.mix(none)).count() == jaccard_join.components(none).count() == 0


def test_fertility_fence_and_small_bands(spark, monkeypatch):
    row = lambda i, band, value: (i, i, band, "latin", 100, 500, 0, 0, 0, 120, value, 0.0, 0.8)
    rows = [row(i, "en:7", 4 + i % 101 / 100) for i in range(202)] + [row(900, "en:7", 6.3)] + [row(1000 + i, "de:7", 6.0) for i in range(60)]
    monkeypatch.setattr(fertility, "fertility", lambda *a: spark.createDataFrame(rows, fertility.STATS))
    kept = {r["doc_id"] for r in fertility.judge(None, "").where("kept").collect()}
    assert 900 not in kept and kept == {*range(202), *range(1000, 1060)}


def test_fertility_table_grows_with_the_words():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    words = [f"w{i}x{i % 7}".encode() for i in range(20_000)]
    pieces, model = fertility.Pieces(path, 10**6), sentencepiece.SentencePieceProcessor(model_file=path)
    rows = np.array([pieces[w] for w in words])
    for part in (rows[:1], rows[16_380:16_390], rows[::777]):
        assert pieces.measure(part)[0] == sum(len(model.encode(words[r].decode())) for r in part)


def test_block_permutations_beyond_64_bit_products(spark):
    """Slots of a source of 5e9 blocks, and all of one of a few."""
    blocks = 5_000_000_000
    slots = [0, 1, 2, 4_999_999_999, 4_294_967_296, 3_333_333_333]
    rows = spark.createDataFrame([(k, blocks, "s") for k in slots] + [(k, 77, "t") for k in range(77)], "k long, b long, source string")
    got = rows.select("k", "b", mixing.block_of(rows.k, rows.b, rows.source, 3).alias("at")).collect()
    at = {r["k"]: r["at"] for r in got if r["b"] == blocks}
    step = next(p for p in mixing.PRIMES if blocks % p)
    assert all((at[k] - at[0]) % blocks == k * step % blocks for k in slots)
    assert sorted(r["at"] for r in got if r["b"] == 77) == list(range(77))


def test_cosine_of_very_large_and_very_small_vectors():
    entries = np.array([[1.0, 1.0], [1e200, 1e200], [1e-200, 2e-200], [-3e-310, 0.0]])
    got = multi_index.cosines(np.array([1e200, 1e200]), entries)
    assert got == pytest.approx([1, 1, 3 / 10**0.5, -(0.5**0.5)])
    plain = np.random.default_rng(1).normal(size=(50, 9))
    want = (plain * plain[0]).sum(axis=1) / (np.sqrt((plain * plain).sum(axis=1)) * np.sqrt((plain[0] * plain[0]).sum()))
    assert (multi_index.cosines(plain[0], plain) == want).all()


def test_pii_links_a_card_written_with_dots(spark):
    plain, dotted = "4111 1111 1111 1111", "4111.1111.1111.1111"
    keys = {key for _, _, _, key in pii.candidates(f"card {plain} and {dotted}, at 10.20.30.40")}
    assert keys == {"4111111111111111", "10.20.30.40"}
    text = f"my card {plain} please. " + f"then, some words further on, and again the card {dotted} as above. " * 20
    got = pii.find_pii(spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string")).first()
    assert got["n_card"] == 1 and got["n_added"] == 20
