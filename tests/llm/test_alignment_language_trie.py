"""Tokenizer alignment, language identification and the conversation trie, on hard rows and against brute force."""

import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from fillcast.llm import alignment, language, prefix_trie  # noqa: E402
from fillcast.llm.queries import BYTE_FILE, PIECE_FILE  # noqa: E402

ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# -- alignment --------------------------------------------------------------------

def tricky_texts():
    rng = random.Random(3)
    words = ["the", "Straße", "naïve", "日本語", "👩‍👩‍👧", "don't", "x" * 70, "12345", "▁low", "<s>", "<|endoftext|>", "<0x0A>", "a\x00b", "﻿", "é", "ﬁ"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(25)]
    long = " ".join(rng.choice(["alpha", "beta", "Gamma,", "delta\n", "  ", "été"]) for _ in range(30_000))
    return [None, "", " ", "\n\n", "\t", "  two  spaces ", "same text", "same text", "same text", *made, long, "▁", "tail "]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "clash", "clash", 1) for i, t in enumerate(tricky_texts())] + [(None, "no id", "c", "c", 1), (7, "same text", "c", "c", 1)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, block string, pair string, n_a int")


def test_alignment_equals_brute_force(texts):
    rows, df = texts
    want = brute.alignment([r[:2] for r in rows if r[0] is None or len(r[1] or "") < 10_000], BYTE_FILE, PIECE_FILE)
    short = df.filter("text IS NULL OR length(text) < 10000")
    for parts in (1, 3):
        assert rows_of(alignment.cross_tokenizer_alignment(short.repartition(parts), BYTE_FILE, PIECE_FILE), *ALIGNED) == sorted(want, key=str)


def test_alignment_of_a_very_long_text_and_small_blocks(texts, monkeypatch):
    rows, df = texts
    want = sorted((r[:7] for r in brute.alignment([r[:2] for r in rows], BYTE_FILE, PIECE_FILE)), key=str)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 500)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 200)
    assert rows_of(alignment.cross_tokenizer_alignment(df.repartition(2), BYTE_FILE, PIECE_FILE), *ALIGNED[:7]) == want


def test_alignment_without_tokens(spark):
    schema = "doc_id bigint, text string"
    assert alignment.cross_tokenizer_alignment(spark.createDataFrame([], schema), BYTE_FILE, PIECE_FILE).count() == 0
    out = alignment.cross_tokenizer_alignment(spark.createDataFrame([(1, None), (2, ""), (3, "▁")], schema), BYTE_FILE, PIECE_FILE)
    assert rows_of(out, *ALIGNED) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    docs = 3000
    owner = np.repeat(np.arange(6), [1, 5, 3000, 700, 30, 2])
    member = np.concatenate([np.sort(rng.choice(docs, k, replace=False)) for k in (1, 5, 3000, 700, 30, 2)])
    owners, count, kind, body = alignment.pack_sets(owner, member, docs)
    assert count.tolist() == [1, 5, 3000, 700, 30, 2] and kind.tolist() == [0, 0, 1, 1, 0, 0]
    at, back = alignment.unpack_sets(kind, body)
    assert sorted(zip(at.tolist(), back.tolist(), strict=True)) == sorted(zip(owner.tolist(), member.tolist(), strict=True))


def test_planes_hold_multiplicities():
    key = np.array([(5 << 16) + 0, (5 << 16) + 2, (9 << 16) + 1])
    table = alignment.block_postings(1, key, np.array([1, 7, 3]), 3)
    total = {}
    at, member = alignment.unpack_sets(table["kind"].to_numpy(), table["docs"].combine_chunks())
    for r, m in zip(at.tolist(), member.tolist(), strict=True):
        pair, plane = table["pair"][r].as_py(), table["plane"][r].as_py()
        total[pair, m] = total.get((pair, m), 0) + (1 << max(plane, 0))
    assert total == {(5, 0): 1, (5, 2): 7, (9, 1): 3}
    assert isinstance(table["docs"].combine_chunks(), pa.Array)


def test_pair_scores_count_documents_and_links(spark):
    df = spark.createDataFrame([(1, "the cat the cat the"), (2, "the dog"), (3, "the")], "doc_id bigint, text string").repartition(3)
    rows = alignment.align_documents(df, BYTE_FILE, PIECE_FILE).filter("plane IS NOT NULL")
    best = alignment.pair_scores(rows).orderBy("count", ascending=False).first()
    assert best["count"] == 3 and best["links"] == 5 and best["best"]


# -- language -----------------------------------------------------------------------

SYLLABLES = {"en": ["the", "ing", "tion", "and", "er", "sh"], "de": ["sch", "ein", "ung", "ß", "ge", "ver"], "fr": ["eau", "oir", "ée", "les", "qu", "ç"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(4)
    rows = [(i, speech(rng, lang, rng.randint(5, 120)), lang, "clash", 0.5) for i, lang in enumerate(rng.choice(["en", "en", "de", "fr"]) for _ in range(400))]
    rows += [(1000, None, "en", "c", 0.0), (1001, "", "de", "c", 0.0), (1002, "123 ... !?", "fr", "c", 0.0), (1003, speech(rng, "fr", 60_000), None, "c", 0.0),
             (1004, speech(rng, "de", 50).upper(), None, "c", 0.0), (None, speech(rng, "en", 50), "en", "c", 0.0)]
    rows += [rows[5], rows[5]]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string, score double")


def test_languages_on_held_out_rows(spoken):
    rows, df = spoken
    known = language.train_languages(df)
    assert known.names[0] == "en" and set(known.names) == {"en", "de", "fr"} and max(map(len, known.contents)) <= language.DICTIONARY_BYTES
    got = {(r["doc_id"], r["text"]): r for r in language.identify_languages(df, known).collect()}
    unseen = [r for r in rows if r[0] is not None and r[0] < 1000 and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    right = sum(got[r[0], r[1]]["lang_pred"] == r[2] for r in unseen)
    assert len(unseen) > 100 and right >= 0.99 * len(unseen)
    assert got[1003, rows[403][1]]["lang_pred"] == "fr" and got[1004, rows[404][1]]["lang_pred"] == "de"
    for k in (400, 401, 402):
        r = got[rows[k][0], rows[k][1]]
        assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify_languages(df, known).count() == len(rows)


def test_languages_equal_plain_compression(spoken):
    """Each text's bytes under each dictionary, with a compressor made anew, without the operator's helpers."""
    rows, df = spoken
    known = language.train_languages(df)
    params = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **language._MATCHER)
    want = []
    for r in rows[:40]:
        body = " ".join(r[1].lower().split()).encode()
        sizes = []
        for content in known.contents:
            c = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            sizes.append(sum(len(c.compress(body[i:i + 1000])) for i in range(0, len(body), 1000)))
        low = min(sizes)
        want.append((r[0], known.names[sizes.index(low)], round(1 / sum(2.0 ** (low - s) for s in sizes), 9)))
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language.identify_languages(df.filter("doc_id < 40"), known, keep=["doc_id"]).distinct().collect()]
    assert sorted(got) == sorted(set(want))


def test_language_training_ignores_partitions_and_held_out_rows(spoken):
    _, df = spoken
    known = language.train_languages(df.repartition(1))
    assert known == language.train_languages(df.repartition(7))
    changed = df.selectExpr("doc_id", "text", "CASE WHEN crc32(string(doc_id)) % 3 = 1 THEN 'xx' ELSE lang END AS lang")
    assert language.train_languages(changed) == known


def test_languages_without_labels(spark, spoken):
    _, df = spoken
    none = language.train_languages(df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang"))
    assert none.names == ()
    assert {r["lang_pred"] for r in language.identify_languages(df.limit(5), none).collect()} == {"und"}
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert language.identify_languages(empty, language.train_languages(empty)).count() == 0
    one = language.train_languages(df.filter("lang = 'de'"))
    assert language.identify_languages(df.filter("doc_id = 1003"), one).first()["lang_pred"] == "de"


def test_narrow_margins_are_not_accepted():
    assert language.verdict([100, 100, 130]) == (0, 1 / (2 + 2.0 ** -30), 0.0, False)
    assert language.verdict([120, 90])[0] == 1 and language.verdict([120, 90])[3]


# -- trie ----------------------------------------------------------------------------

NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def hard_turns():
    rng = random.Random(9)
    said = ["hello there", "", None, "a b c", "x\ty", "bye"]
    rows = [(c, t, rng.choice(["user", "bot", None, ""]), rng.choice(said)) for c in [*range(-25, 90), 400, 401] for t in range(1, rng.randint(2, 6))]
    rows += [(c, t, "user", "hot") for c in range(1000, 1160) for t in (None, 1, 2)]
    rows += [(c, 0, "user", "shared first") for c in range(2000, 2040)] + [(c, 1, "bot", f"own {c}") for c in range(2000, 2040)]
    rows += [(3000, t, "user", f"turn {t}") for t in range(700)] + [(3020, t, "user", f"turn {t}") for t in range(650)]
    return rows + [(None, 1, "user", "lost"), (5000, None, None, None)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_trie_equals_brute_force(spark, parts):
    rows = hard_turns()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id bigint, turn int, role string, text string, ends string, n_convs int").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert rows_of(prefix_trie.conversation_trie(df), *NODE) == sorted(brute.trie(rows), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_equal_turns_and_copies(spark):
    """Rows equal in turn go by their code, the same on any partitioning; repeated rows are turns of their own."""
    rows = [(1, 1, "u", "b"), (1, 1, "u", "a"), (1, 1, "u", "a"), (2, 1, "u", "a"), (2, 1, "u", "b"), (2, 1, "u", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    first = rows_of(prefix_trie.conversation_trie(df, rebuild=False), *NODE)
    assert first == rows_of(prefix_trie.conversation_trie(df.repartition(5), rebuild=False), *NODE)
    assert [r[3] for r in first] == [2, 2, 2, 2]


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert prefix_trie.conversation_trie(empty).count() == 0


def test_extents_by_range_minima():
    rng = np.random.default_rng(2)
    lcp = rng.integers(0, 6, 300)
    levels = prefix_trie.sparse_table(lcp)
    at, depth = rng.integers(0, 300, 500), rng.integers(0, 7, 500)
    left, right = prefix_trie.extents(levels, at, depth)
    for i, d, lo, hi in zip(at.tolist(), depth.tolist(), left.tolist(), right.tolist(), strict=True):
        a = i
        while a > 0 and lcp[a] >= d:
            a -= 1
        b = i
        while b < 299 and lcp[b + 1] >= d:
            b += 1
        assert (lo, hi) == (a, b)
