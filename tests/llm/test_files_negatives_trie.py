"""Token files, hard negatives and the conversation trie against plain versions."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terravela.llm import hard_negatives as hn
from terravela.llm import prefix_trie as trie
from terravela.llm import token_files as tf

public = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
PATH = public.path("word_bpe_49k.json")
ODD_TEXTS = [
    "It's 'super ''s don't they'll WE'VE 3.14e-9 x'y \"'s\"", "Né. été, ÉTÉ! ñó.x Å.B é…. …é. ×3÷4. é'é", "\x1c\x1d a\x85b\xa0c d​e﻿", "<|endoftext|> and <|startoftext|>x <|ENDOFTEXT|> <|endof text|>",
    "你好。世界 \U0001f600\U0001f1e9\U0001f1ea ΣΑΣ. İI ǅ ﬁ ŉ'n ½²③", "á.́b ́c .̈ 1̀", "\r\n\t mixed \v\f ends\n", "'", "''", "a'", "\x00\x01 \x7f", "K Å Ω", "é'S É'LL",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain_tokens(tokenizer, rows):
    """(doc_id, start, n_tokens, crc) of rows (doc_id, text) in their order."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_words_encode_as_whole_texts(tokenizer):
    import pyarrow as pa

    rng = random.Random(4)
    letters = "abcXYZ éÉñßçÿ×÷ 019 .,;:!?-_'\"()<|> \n\t你好ж́̈ …"
    texts = ODD_TEXTS + [None, ""] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    encoder = tf.WordEncoder(open(PATH, encoding="utf-8").read())
    assert encoder.by_word
    expected = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for part in (texts, [t for t in texts if "<|" not in (t or "")], []):
        ids, offsets = encoder.encode(pa.array(part, pa.string()))
        want = [expected[texts.index(t)] for t in part]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


def test_an_encoder_that_forgets_stays_right(tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tf, "REMEMBERED", 7)
    encoder = tf.WordEncoder(open(PATH, encoding="utf-8").read())
    for text in ("one two three four five", "five six seven one", "a b c d e f g h i j k l m one"):
        assert encoder.encode(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    import pyarrow as pa

    path = public.path("byte_bpe_50k.json")
    other, encoder = Tokenizer.from_file(path), tf.WordEncoder(open(path, encoding="utf-8").read())
    assert not encoder.by_word
    ids, offsets = encoder.encode(pa.array(ODD_TEXTS))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [other.encode(t, add_special_tokens=False).ids for t in ODD_TEXTS]


def test_token_files_hold_every_text_in_order(spark, odd, empty, tokenizer):
    docs = odd.select("doc_id", "text", "n", F.lit("x").alias("part"), F.lit(1).alias("start")).unionByName(spark.createDataFrame([(100 + k, t, k, "y", 2) for k, t in enumerate(ODD_TEXTS)], "doc_id long, text string, n long, part string, start int"))
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tf.token_round_trip(docs, PATH).collect()))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows = sorted(((r["doc_id"], r["text"], r["h"]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert got == [(s, d, n, c) for d, s, n, c in plain_tokens(tokenizer, [r[:2] for r in rows])]
    assert tf.token_round_trip(empty, PATH).count() == 0


def test_token_files_are_laid_out_for_selective_reads(spark, tmp_path):
    path, n = str(tmp_path / "tokens"), 12_000
    docs = spark.range(n).select((n - 1 - F.col("id")).alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id").cast("string"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tf.write_token_files(docs, PATH, path, row_group_bytes=60_000, page_bytes=8_192, page_rows=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(f for f in (tmp_path / "tokens").iterdir() if f.suffix == ".parquet" and pq.ParquetFile(f).metadata.num_rows)
    assert len(files) > 1
    for f in files:
        meta = pq.ParquetFile(f).metadata
        columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
        assert meta.num_row_groups > 1 and all(c.has_offset_index and c.has_column_index for c in columns.values())
        assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings and columns["doc_id"].encodings[0] == columns["start"].encodings[0] == "DELTA_BINARY_PACKED"
        ids = pq.read_table(f, columns=["doc_id"])["doc_id"].to_numpy()
        assert (np.diff(ids) > 0).all()
    every = tf.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in every] == list(range(n)) and [r["start"] for r in every] == np.cumsum([0, *(r["n_tokens"] for r in every)])[:-1].tolist()
    some = tf.read_tokens(spark, path, F.col("doc_id").between(5_000, 5_009)).orderBy("doc_id").collect()
    assert some == every[5_000:5_010]
    stream = [i for r in every for i in r["ids"]]
    for a, b in ((0, 1), (7, 7), (len(stream) // 3, len(stream) // 3 + 5_000), (len(stream) - 3, len(stream) + 9), (len(stream), len(stream) + 4)):
        got = tf.token_window(spark, path, a, b).orderBy("start").collect()
        assert [i for r in got for i in r["ids"]] == stream[a:b] and (not got or got[0]["start"] == a)
    plan = tf.read_places(spark, path, F.col("doc_id") == 77)._jdf.queryExecution().toString()
    scans = [x for x in plan.split("\n") if "ReadSchema" in x]
    assert scans and not any("ids:array" in x for x in scans) and any("EqualTo(doc_id,77)" in x for x in scans)


def plain_negatives(rows):
    one = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        entry = (label, [math.floor(256 * x) for x in vector])
        one[vec_id] = min(one.get(vec_id, entry), entry)
    held = {i: ((label + 1) % 10 if i % 7 == 0 else label, q) for i, (label, q) in one.items()}
    out = []
    for a, (label, q) in held.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), i, other == label) for i, (other, p) in held.items() if i != a)
        for s, i, _ in [x for x in scored if x[2]][:5]:
            inside = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, i, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside)]
    return sorted(out)


def embeddings(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, rank string, q int")


@pytest.mark.parametrize("anchor_rows", [3, 8192])
def test_hard_negatives_equal_brute_force(spark, anchor_rows, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0.3, 0.3, 8)], int(rng.integers(0, 4))) for i in range(420)]
    rows += [(1000 + i, rows[1][1], i % 3) for i in range(90)] + [rows[50], rows[50], (50, rows[3][1], 9)]  # ties, repeated rows, one id twice
    rows += [(2000, None, 1), (2050, rows[0][1], None), (None, rows[0][1], 1), (2100, [None] * 8, 1), (2150, [math.nan] * 8, 1), (2200, [math.inf] + [0.0] * 7, 1), (2250, [0.0] * 8, 1), (2300, [0.5, 0.5], 2), (2350, [], 2)]
    vectors = hn.quantised(embeddings(spark, rows))
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = hn.mine_hard_negatives(moved, moved.where("vec_id % 50 = 0"), anchor_rows=anchor_rows).collect()
    expected = plain_negatives(rows)
    assert len(expected) > 60 and sorted(tuple(r) for r in got) == expected
    if anchor_rows > 3:
        assert sorted(tuple(r) for r in hn.hard_negatives(embeddings(spark, rows)).collect()) == expected


def test_hard_negatives_of_no_rows(spark):
    assert hn.hard_negatives(embeddings(spark, [])).count() == 0
    assert hn.hard_negatives(embeddings(spark, [(1, [1.0], 1), (2, [1.0], 1)])).count() == 0  # no anchor


def test_large_products_stay_exact():
    a, b = np.array([[2.0**25 + 1, 1.0]]), np.array([[2.0**25 + 3, 1.0]])
    assert hn._dot(a, a)[0, 0] == (2**25 + 1) ** 2 + 1
    big = np.array([[2.0**27 - 1, 0.0]])
    assert hn._dot(big, big)[0, 0] == (2**27 - 1) ** 2  # odd and beyond 2^53
    with pytest.raises(ValueError):
        hn._dot(big * 2**20, big * 2**20)


def plain_trie(rows):
    """Rows (conv_id, turn, role, text) -> the trie's nodes; equal turns must be equal rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    below = {}
    for path in sorted(members, key=len, reverse=True):
        under = [below[x] for x in children.get(path, [])]
        cost = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        below[path] = (sum(x[0] for x in under) or 1, cost + sum(x[1] for x in under))
    ends = {path: ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(path)))) for path, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *below[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, owner int")


def nodes(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


@pytest.mark.parametrize("part", [3, 1024])
def test_trie_equals_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(trie, "PART", part)
    rng = random.Random(6)
    rows = []
    for c in range(60):
        for t in range(rng.choice([1, 2, 5, 9, 12, 20])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 3 else "user", rng.choice(["a", "é", "long text"]) if t > 1 else "hi"))
    rows += [(c, t, "user", "same") for c in range(100, 130) for t in range(11)]  # copies
    rows += [(200, None, None, None), (200, 1, None, "x"), (200, 2, "", None), (201, 5, "r", "twice"), (201, 5, "r", "twice"), (None, 1, "user", "lost"), (203, 0, "user", "one")]
    rows += [(305, t, "user", f"t{t}") for t in range(40)]
    rng.shuffle(rows)
    assert nodes(trie.conversation_trie(conversations(spark, rows))) == sorted(plain_trie(rows), key=str)


def test_a_trie_of_little(spark):
    assert trie.conversation_trie(conversations(spark, [])).count() == 0
    assert trie.conversation_trie(conversations(spark, [(None, 1, "user", "x")])).count() == 0
    lone = [(3, 0, "user", "gone")]  # its first turns are those of an absent conversation
    assert nodes(trie.conversation_trie(conversations(spark, lone))) == plain_trie(lone) and len(plain_trie(lone)) <= 2


def test_ids_are_joined_in_pieces(spark):
    rows = [(1, 2, c) for c in range(0, 900, 3)] + [(1, 3, 7), (5, 2, 9), (5, 2, 10)]
    got = {(r["owner"], r["depth"]): r["ends_sha256"] for r in trie.joined_ids(spark.createDataFrame(rows, "owner long, depth long, conv_id long"), piece_bytes=40).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in {(1, 2): range(0, 900, 3), (1, 3): [7], (5, 2): [9, 10]}.items()}
