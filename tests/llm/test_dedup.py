import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravela.llm import line_dedup, textbytes
from terravela.llm.exact_dedup import drop_copies, exact_dedup
from terravela.llm.line_dedup import banded_distance, drop_repeated_lines, line_classes, placements
from terravela.llm.ngram_join import drop_near_copies, jaccard_components


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(rows, percent=80):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            low[find(x)] = min(i, low.get(find(x), i))
    return sorted(((i, len(s), low.get(find(x))) for x, (i, s) in enumerate(sets)), key=str)


def near_copies(seed):
    """Groups whose members have from no to too many edits, with passages that groups share."""
    rng, vocabulary, rows = random.Random(seed), [f"w{i}" for i in range(300)], []
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for group in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 120]))] + (passage if group % 2 else [])
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            rows.append((rng.randint(0, 10_000), " ".join(words).title()))
    return [(i, t) for i, t in dict(rows).items()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components_equal_brute_force(spark, seed):
    rows = near_copies(seed)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == components(rows)


def test_jaccard_components_of_odd_rows(odd, empty):
    got = sorted(map(tuple, jaccard_components(odd).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == components([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert jaccard_components(empty).count() == 0


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == components(rows)


def test_one_document_of_a_group_stays(odd):
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 6, 7, 8, 10]


def exact_expected(rows, keep):
    out, groups = [], {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        best = keep(ids) if ids else None
        out.append((i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_of_odd_rows(odd, empty, keep):
    got = exact_dedup(odd, keep=keep).collect()
    assert sorted(map(tuple, got), key=str) == exact_expected([(r["doc_id"], r["text"]) for r in odd.collect()], {"min": min, "max": max}[keep])
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_excludes_collisions(spark):
    rows = [(i, f"t{i % 7}") for i in range(60)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep="max", hashed=lambda t: F.length(t))
    assert sorted(map(tuple, got.collect()), key=str) == exact_expected(rows, max)


def test_drop_copies_keeps_columns_and_rows_without_an_id(odd):
    kept = drop_copies(odd, keep="max")
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in kept.select("doc_id").collect()) == [-1, -1, -1, 3, 4, 5, 5, 6, 7, 8, 9, 10]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(rng, text, edits, alphabet="abé\U0001f600"):
    for _ in range(edits):
        at = rng.randint(0, len(text))
        text = text[:at] + rng.choice([rng.choice(alphabet), ""]) + text[at + rng.randint(0, 1) :]
    return text


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_banded_distance_equals_dynamic_programming(edits):
    rng = random.Random(edits)
    a = ["".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 15))) for _ in range(800)]
    b = [mutated(rng, x, rng.randint(0, edits + 2)) for x in a]
    assert banded_distance(a, b, edits).tolist() == [min(distance(x, y), edits + 1) for x, y in zip(a, b)]
    assert banded_distance([], [], edits).tolist() == []


def test_a_pair_within_the_threshold_shares_a_probed_segment():
    rng = random.Random(3)
    for _ in range(3000):
        edits = rng.randint(1, 3)
        a = "".join(rng.choice("ab") for _ in range(rng.randint(edits + 1, 16)))
        b = mutated(rng, a, rng.randint(0, edits), "ab")
        a, b = sorted((a, b), key=len)
        if len(a) > edits and distance(a, b) <= edits:
            found = [set(), set()]
            for k, text in enumerate((a, b)):
                for rows, shorter, i, start, size, role in placements(np.array([len(text)]), edits):
                    if len(rows) and role & (2, 1)[k]:
                        found[k].add((int(shorter[0]), i, text[start[0] : start[0] + size[0]]))
            assert found[0] & found[1]


def lines_expected(rows, edits, least):
    lines = [(i, k, x) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if x.strip(" ")]
    texts = sorted({x for _, _, x in lines})
    links = {x: {y for y in texts if y != x and min(len(x), len(y)) >= least and distance(x, y) <= edits} for x in texts}
    root = {}
    for x in texts:
        if x not in root:
            todo = [x]
            while todo:
                y = todo.pop()
                if root.setdefault(y, x) is x:
                    todo += [z for z in links[y] if z not in root]
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    first = {}
    for i, k, x in lines:
        first[root[x]] = min([first.get(root[x], (i, k)), (i, k)], key=order)
    return sorted(((i, k, len(x), *first[root[x]], len(links[x]), first[root[x]] == (i, k)) for i, k, x in lines), key=str)


def test_line_classes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    bases = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 40))) for _ in range(12)]
    rows = [(i, "\n".join(mutated(rng, rng.choice(bases), rng.randint(0, 3), "abc") for _ in range(rng.randint(0, 6)))) for i in range(40)]
    rows += [(41, None), (42, ""), (None, bases[0] + "\n \n" + bases[0]), (43, bases[1]), (43, bases[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = lines_expected(rows, 2, 8)
    assert sorted(map(tuple, line_classes(docs, min_chars=8).collect()), key=str) == expected
    monkeypatch.setattr(line_dedup, "DENSE", 1)  # on the driver only; the dense way itself is compared below
    assert line_classes(docs.limit(0)).count() == 0


def test_dense_groups_lose_no_pair(monkeypatch):
    rng = np.random.default_rng(5)
    n = 300
    key = np.arange(n) + 1
    signature = np.int64(1) << rng.integers(0, 6, n)
    role = np.full(n, 3, np.int8)
    pairs = lambda: {(min(x, y), max(x, y)) for a, b in line_dedup._meet(key, signature, role, 2) for x, y in zip(a.tolist(), b.tolist())}
    plain = pairs()
    monkeypatch.setattr(line_dedup, "DENSE", 10)
    assert pairs() == plain and plain


def test_repeated_lines_go(spark):
    docs = spark.createDataFrame([(1, "a long first line here\nshort\n\nagain", "x"), (2, "a long first line hera\nshort\nnew", "y"), (3, None, "z")], "doc_id long, text string, _gone string")
    got = {r["doc_id"]: r["text"] for r in drop_repeated_lines(docs).collect()}
    assert got == {1: "a long first line here\nshort\n\nagain", 2: "new", 3: None}


def test_line_keys_equal_sparks(spark):
    texts = ["", "a", "é\U0001f600", "x" * 1000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert got == [line_dedup.line_key(t) for t in texts]


def test_words_end_at_rows():
    import pyarrow as pa

    data, offsets = textbytes.utf8(pa.array(["ab c", None, "", " d", "e"]))
    start, end, row = textbytes.words(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == ["ab", "c", "d", "e"] and row.tolist() == [0, 0, 3, 4]


def test_short_lines_are_linked(spark):
    rng = random.Random(12)
    bases = ["Home", "Read more >", "About us", "Contact", "a line of 15 ch", "Menu", "FAQ", "x", "ab"]
    rows = [(i, "\n".join(mutated(rng, rng.choice(bases), rng.randint(0, 2), "ab>") for _ in range(4))) for i in range(30)]
    rows += [(50, "Read more >>\na line of 15 char"), (51, "\t\t\t\n   "), (52, "\t\t\t\t")]
    got = sorted(map(tuple, line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == lines_expected(rows, 2, 3)
