import base64
import gzip
import hashlib
import io
import random

import pytest

from terravela.llm import warc
from terravela.llm.warc import Archive, Record, plan_records, read_archives, record_bytes, salvage, sha1_base32, write_archives


def member(k, gz, payload=None):
    payload = payload if payload is not None else f"<p>page {k}</p>".encode() * (k + 1)
    raw = record_bytes("response", f"urn:page:{k}", f"http://x/{k}", payload, sha1_base32(payload), len(payload))
    return gzip.compress(raw, 1) if gz else raw


def read(data):
    return list(salvage(Archive(io.BytesIO(data), len(data))))


@pytest.mark.parametrize("gz", [True, False])
def test_whole_archives_have_no_gaps(gz):
    big = bytes(random.Random(1).randbytes(300_000))
    parts = [member(k, gz) for k in range(5)] + [member(9, gz, big)]
    got = read(b"".join(parts))
    assert all(isinstance(x, Record) for x in got) and len(got) == 6 and got[-1].end == sum(map(len, parts))
    assert got[-1].block.partition(b"\r\n\r\n")[2] == big
    assert read(b"") == []


@pytest.mark.parametrize("gz", [True, False])
def test_damage_costs_the_damaged_records_only(gz):
    rng = random.Random(2)
    for _ in range(60):
        parts = [member(k, gz) for k in range(6)]
        hurt = rng.randrange(6)
        bad = bytearray(parts[hurt])
        if rng.random() < 0.3:
            bad = bad[: rng.randrange(len(bad))]
        else:
            for _ in range(rng.randint(1, 8)):
                bad[rng.randrange(len(bad))] ^= 1 + rng.randrange(255)
        data = b"".join(parts[:hurt]) + bytes(bad) + b"".join(parts[hurt + 1 :])
        got = read(data)
        uris = [x.headers.get("warc-target-uri") for x in got if isinstance(x, Record)]
        assert [f"http://x/{k}" for k in range(6) if k != hurt] == [u for u in uris if u in {f"http://x/{k}" for k in range(6)} - {f"http://x/{hurt}"}]
        places = sorted((x.offset, x.end) if isinstance(x, Record) else x[:2] for x in got)
        assert places[0][0] == 0 and places[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(places, places[1:]))


def test_members_of_many_records_are_salvaged_inside():
    rng = random.Random(7)
    raws = [member(k, False, rng.randbytes(40_000)) for k in range(12)]
    uri = lambda got: [x.headers["warc-target-uri"] for x in got if isinstance(x, Record)]
    every = [f"http://x/{k}" for k in range(12)]
    whole = gzip.compress(b"".join(raws), 1)
    assert uri(read(whole)) == every and all(isinstance(x, Record) for x in read(whole))
    # A record damaged before it was packed costs itself.
    hurt = bytearray(raws[5])
    hurt[len(hurt) // 2] ^= 1
    got = read(gzip.compress(b"".join(raws[:5]) + bytes(hurt) + b"".join(raws[6:]), 1) + member(20, True))
    assert uri(got) == [u for u in every if u != every[5]] + ["http://x/20"]
    assert [x[2].startswith("inflated bytes") for x in got if not isinstance(x, Record)] == [True]
    # A damaged or cut member gives out what came before, but for the last record; the next member is found.
    for cut_short in (True, False):
        bad = bytearray(whole)
        if cut_short:
            bad = bad[: len(bad) // 2]
        else:
            bad[len(bad) // 2 : len(bad) // 2 + 40] = bytes(40)
        got = read(bytes(bad) + member(20, True))
        names = uri(got)
        assert names[-1] == "http://x/20" and names[:-1] == every[: len(names) - 1] and len(names) >= 5
        places = sorted((x.offset, x.end) if isinstance(x, Record) else x[:2] for x in got)
        assert all(a[1] == b[0] for a, b in zip(places, places[1:])) and places[-1][1] == len(bad) + len(member(20, True))


def test_lost_records_are_told(spark, tmp_path):
    path = tmp_path / "y.warc.gz"
    path.write_bytes(member(1, True) + member(2, True))
    rows = read_archives(spark.createDataFrame([(str(path), 3)], "path string, records long")).collect()
    assert sorted(r["damage"] or "" for r in rows) == ["", "", "2 records of 3"]


def expected(rows, least=0):
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        lead = max(x for x in groups[html or ""] if x is not None) if any(x is not None for x in groups[html or ""]) else None
        revisit = i is not None and lead is not None and i < lead and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=str)


PAGES = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b/\r\nX: y", None), (4, "http://c", ""), (5, "u", "x" * 200_000), (None, "n", "<p>é</p>"), (7, "u", "once"), (7, "u", "once"), (8, "u", "a\r\n\r\nb\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("least", [0, 5])
def test_pages_come_back_from_their_archives(spark, tmp_path, least):
    pages = spark.createDataFrame([(*r, 1, "x") for r in PAGES], "page_id long, url string, html string, size int, lead string")
    manifest = write_archives(plan_records(pages, least_bytes=least), f"file://{tmp_path}/w", roll_bytes=2000)
    got = read_archives(manifest)
    assert got.where("damage IS NOT NULL").count() == 0
    rows = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, rows), key=str) == expected(PAGES, least)
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in got.where("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert payloads[8] == PAGES[-1][2] and payloads[5] == PAGES[4][2]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_quarantined_bytes_are_reported_with_their_place(spark, tmp_path):
    path = tmp_path / "x.warc.gz"
    path.write_bytes(member(1, True) + b"junk junk" + member(2, True) + member(3, True)[:-9])
    rows = read_archives(spark.createDataFrame([(str(path),)], "path string")).orderBy("first_byte").collect()
    assert [(r["page_id"], r["damage"] is None) for r in rows] == [(1, True), (None, False), (2, True), (None, False)]
    assert rows[1]["end_byte"] - rows[1]["first_byte"] == 9


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as pipeline
    from tests.llm.test_dedup import components
    from tests.llm.test_text_operators import encoding, overlap, prose

    rng = random.Random(21)
    rows = [(i, prose(rng, lang, rng.randint(20, 90)), lang) for i, lang in enumerate(["en", "de", "ru"] * 14)]
    rows += [(100 + i, rows[i][1], "en") for i in range(5)] + [(200 + i, rows[i][1] + " extra", "en") for i in range(8)] + [(300, "12 34 !!", "en"), (301, None, "en"), (302, "", None)]
    items = [(0, " ".join(f"q{k}" for k in range(30)))]
    rows += [(400, prose(rng, "en", 20) + " " + items[0][1], "en"), (401, items[0][1] + " " + prose(rng, "de", 30), "de")]
    spark.createDataFrame([(*r, f"s{r[0] % 3}", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_level_bpe"]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    staged = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        staged.append(stage(spark, staged[-1], str(tmp_path)).cache())
        assert staged[-1].columns == docs.columns
    kept = [{r["doc_id"]: r["text"] for r in s.collect()} for s in staged]
    assert set(kept[0]) - set(kept[1]) == {300, 301, 302}
    last = {}
    for i, t in kept[1].items():
        last[t] = max(i, last.get(t, i))
    assert kept[2] == {i: t for t, i in last.items()}
    assert set(kept[3]) == {i for i, _, low in components(list(kept[2].items())) if i == low}
    assert set(kept[4]) == {i for i, t in kept[3].items() if overlap(t, items[0][1])[0] < 12} and {400, 401} <= set(kept[3]) - set(kept[4])
    _, own = encoding()
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: (len(own.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept[4].items()}


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd, str(tmp_path)).count() <= odd.count()


def test_every_operator_has_a_query():
    from terravela.llm.queries import QUERIES

    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
