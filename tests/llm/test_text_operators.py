"""Operators on whole texts against brute force, with nulls, ties and empty tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from goldrec.llm import exact_repeats, postings, repetition, simhash
from goldrec.llm.components import components
from goldrec.llm.suffixes import longest_previous_factor, neighbour_lcp, suffix_order

random.seed(11)
WORDS = "ab cd ef gh Ij é".split()


def prose(n, words=WORDS):
    return " ".join(random.choice(words) for _ in range(n))


LONG = prose(3000, [f"w{i}" for i in range(4000)])
TEXTS = [None, "", " \t\n", "one", "A b\x0bc", "x " * 500, prose(40), prose(200), LONG, LONG, prose(70) + "\n" * 3]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (3, "one"), (None, "null key " * 5), (99, LONG)]


def in_windows(words, k):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    return {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + k)}


def test_repetition(docs_of):
    limits = repetition.Limits(least_repeat=4, longest_repeat=6)
    got = repetition.repetition(docs_of(ROWS), limits=limits).collect()
    assert len(got) == len(ROWS)
    want = []
    for key, text in ROWS:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, longest = len(words), 0
        while in_windows(words, longest + 1) and longest < 12:
            longest += 1
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = n < 50 or 100 * len(in_windows(words, 3)) > 50 * n
        over = 100 * len(in_windows(words, 4)) > 40 * n or longest > 6
        want.append(
            (key, n, sum(map(len, words)), len(lines) - len(set(lines)), len(in_windows(words, 3)), failed)
            + (not failed and not over, len(in_windows(words, 4)))
        )
    columns = "doc_id n_words word_chars n_dup_lines n_repeat_words base_failed kept n_covered_words".split()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got))) == sorted(map(str, want))


def test_keep_unrepetitive_leaves_columns_alone(docs_of):
    docs = docs_of(ROWS)
    kept = repetition.keep_unrepetitive(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {8, 9, 99}
    assert repetition.keep_unrepetitive(docs.limit(0)).count() == 0


def bench_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 300])
def test_contamination(spark, docs_of, monkeypatch, slice_bytes):
    monkeypatch.setattr(postings, "SLICE_BYTES", slice_bytes)
    passage = prose(20, [f"t{i}" for i in range(50)])
    items = [(1, passage), (2, "ab cd!"), (3, None), (4, "..."), (5, prose(13)), (5, passage), (10, LONG[:300])]
    items += [(None, "gh gh")]
    rows = [*ROWS, (20, f"{LONG[:900]} {passage.upper()} {LONG[:50]}"), (21, passage[:60]), (22, f"ab-cd {passage}")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = postings.contamination(docs_of(rows), bench).collect()
    windows = {}
    for item, text in items:
        words = bench_words(text)
        for i in range(max(len(words) - 13, 0) + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + 13]), set()).add(item)
    want = []
    for key, text in rows:
        words, hit, met = bench_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    met |= {str(x) for x in windows[tuple(words[i : i + n])] if x is not None}
        bad = bool(hit) and 20 * len(hit) >= len(words)
        want.append((key, len(words), len(hit), sorted(met), [], bad))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = postings.drop_contaminated(docs_of(rows), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if not w[5])
    empty = postings.contamination(docs_of(rows), bench.limit(0))
    assert {(r.n_hit, r.contaminated) for r in empty.collect()} == {(0, False)}
    assert postings.contamination(docs_of([]), bench).count() == 0


def test_proximity(docs_of):
    rows = [(1, "a x b x c"), (2, "c b a"), (3, "a b x x x x c"), (4, "a b"), (5, "c"), (6, None)]
    index = postings.build_index(docs_of(rows))
    near = postings.near_matches(index, [(7, "a b c"), (8, ""), (9, "zz")], 5)
    keys = {(r.segment, r.ordinal): r.key for r in postings.indexed_rows(index).collect()}
    assert sorted((keys[r.segment, r.ordinal], r.item) for r in near.collect()) == [(1, "7"), (2, "7")]


@pytest.mark.parametrize(("near", "slice_bytes"), [(4, 1 << 20), (17, 100), (26, 1 << 20), (62, 1 << 20)])
def test_proximity_by_brute_force(spark, docs_of, monkeypatch, near, slice_bytes):
    monkeypatch.setattr(postings, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(postings, "SEGMENT_WORDS", 700)
    monkeypatch.setattr(postings, "STARTS", 64)
    letters = [f"v{i}" for i in range(25)]
    passage = prose(40, letters)
    items = [(1, passage), (2, "v1 v1 v2"), (3, None), (4, "v3"), (5, "v4 none"), (1, prose(14, letters)), (None, "v5 v6")]
    items += [(6, "v1 v1 v2")]
    words = passage.split()
    rows = [(i, prose(20 + 7 * i, letters)) for i in range(40)]
    rows += [(50, " ".join(reversed(words[:13]))), (51, " x ".join(words[:13])), (52, passage), (53, None), (53, "v2 y v1")]
    got = postings.contamination(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"), near=near)
    want = []
    for key, text in rows:
        own, met = bench_words(text), set()
        for item, other in items:
            of = bench_words(other)
            for i in range(max(len(of) - 13, 0) + 1 if of and item is not None else 0):
                window = set(of[i : i + 13])
                if any(window <= set(own[s : s + near]) for s in range(len(own))):
                    met.add(str(item))
        want.append((key, sorted(met)))
    assert sorted((r.doc_id, r.near_items) for r in got.collect()) == sorted(want)


def simhash_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(keys_and_prints, radius=4):
    """component of every row, by comparing all pairs"""
    prints = sorted({p for _, p in keys_and_prints})
    up = {p: p for p in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                up[top(a)] = top(b)
    first = {}
    for key, p in keys_and_prints:
        if key is not None:
            first[top(p)] = min(key, first.get(top(p), key))
    return [first.get(top(p)) for _, p in keys_and_prints]


def test_simhash(spark, docs_of):
    near = [LONG[:4000] + f" tail{i}" for i in range(12)]
    rows = [*ROWS, *((200 - i, t) for i, t in enumerate(near)), (None, "alone with no key at all")]
    prints = [(k, simhash_of(t)) for k, t in rows]
    want = sorted(map(str, zip([k for k, _ in rows], [f"{p:016x}" for _, p in prints], groups(prints), strict=True)))
    found = simhash.near_duplicates(docs_of(rows), parts=4, tile=3)
    got = found.select("key", simhash.hex_digits(F.col("fp")), "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    docs = docs_of(rows)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    n_groups = len({str(c) for c in groups(prints)})  # the two null-key groups count as one
    assert kept.count() in (n_groups, n_groups + 1)
    assert len({str(r.doc_id) for r in kept.collect()} & {"3"}) == 1
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts,tile", [(2, 16384), (4, 5)])
def test_tiles_lose_no_link(spark, parts, tile):
    rng = np.random.default_rng(2)
    prints = {0, 1, 7, (1 << 63) - 1}
    for base in rng.integers(0, 1 << 62, 25).tolist():
        for _ in range(12):
            base ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            prints.add(base)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    stars = {r.u: r.v for r in components(simhash.links(df, 4, parts, tile)).collect()}
    rows = [(p, p % (1 << 64)) for p in signed]
    assert [stars.get(p, p) for p in signed] == groups(rows)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200 + i: 100 for i in range(50)}


def test_longest_previous_factor():
    for _ in range(60):
        parts = [bytes(random.choice(b"ab") for _ in range(random.randint(0, 12))) for _ in range(8)]
        owners = [random.randint(0, 4) for _ in parts]
        sizes = list(map(len, parts))
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        ends, owner = np.repeat(np.cumsum(sizes), sizes), np.repeat(owners, sizes)
        order, levels = suffix_order(data, ends)
        got = longest_previous_factor(order, neighbour_lcp(order, levels, ends), owner, 2)

        def shared(i, j):
            n = 0
            while i + n < ends[i] and j + n < ends[j] and data[i + n] == data[j + n]:
                n += 1
            return n

        for i in range(len(data)):
            best = max((shared(i, j) for j in range(len(data)) if owner[j] < owner[i]), default=0)
            assert got[i] == (best if best >= 2 else 0)


def test_exact_repeats(docs_of, monkeypatch):
    monkeypatch.setattr(exact_repeats, "BUCKET_PIECES", 200)
    rows = [*ROWS, (50, LONG[1000:3000] + "é" * 40 + LONG[:120]), (51, "ab" * 300), (52, "q" + "ab" * 100 + "é" * 40)]
    rows += [(-7, LONG[500:700]), (53, "\x00" * 120), (54, "x" * 30 + "\x00" * 60), (55, "z" * 49), (56, "z" * 49)]
    got = exact_repeats.without_repeats(docs_of(rows)).collect()
    first = {}
    for key, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49 if key is not None else 0):
            first[raw[i : i + 50]] = min(key, first.get(raw[i : i + 50], key))
    want = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49 if key is not None else 0):
            if first[raw[i : i + 50]] < key:
                gone[i : i + 50] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        want.append((key, len(raw), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    found = [
        (r.key, r.n_bytes, sum(s.e - s.s for s in r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got
    ]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert any(w[2] for w in want)
    assert exact_repeats.without_repeats(docs_of([])).count() == 0


def test_edges_of_a_shared_passage_stay_out_of_one_group(docs_of, monkeypatch):
    """A passage in very many texts: the bytes around its edges differ in almost every text,
    and must not all meet in one group."""
    meet = exact_repeats._previous_factors

    def bounded(table):
        assert sum(len(x) for x in table.column("number").to_pylist()) < 100
        return meet(table)

    monkeypatch.setattr(exact_repeats, "HOT_PIECES", 20, raising=False)
    monkeypatch.setattr(exact_repeats, "PACK_BYTES", 4000)
    monkeypatch.setattr(exact_repeats, "_previous_factors", bounded)
    rnd = random.Random(5)

    def noise(n):
        return "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))

    passage, edges = noise(300), [noise(45) for _ in range(3)]
    rows = [(i, noise(200) + passage + noise(200)) for i in range(120)]
    rows += [(200 + i, noise(60) + edges[i % 3] + passage + edges[-i % 3] + noise(60)) for i in range(12)]
    rows += [(200, rows[-5][1]), (None, passage + edges[0]), (None, rows[3][1])]
    rnd.shuffle(rows)
    got = exact_repeats.without_repeats(docs_of(rows)).collect()
    first = {}
    for key, text in rows:
        for i in range(len(text) - 49 if key is not None else 0):
            first[text[i : i + 50]] = min(key, first.get(text[i : i + 50], key))
    want = []
    for key, text in rows:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 49 if key is not None else 0):
            if first[text[i : i + 50]] < key:
                gone[i : i + 50] = True
        want.append((key, bytes(np.frombuffer(text.encode(), np.uint8)[~gone])))
    assert sorted(map(str, want)) == sorted(str((r.key, bytes(r.kept))) for r in got)


def test_only_pieces_with_a_shared_window_get_a_place_in_suffix_order(monkeypatch):
    """Pieces of equal owners, or that share fewer than 50 bytes, are left out; hits are those of all."""
    rnd = random.Random(5)
    common = "".join(rnd.choice("abcdef") for _ in range(84))
    pieces = [(i % 40, "".join(rnd.choice("abcdef") for _ in range(80)), 1000 + i) for i in range(120)]
    pieces += [(50, common, 7), (41, common[:70], 8), (60, common[30:], 9), (41, common[:70], 10), (70, "x" * 60, 11)]
    pieces += [(3, common[:49] + "!" * 20, 12), (70, "x" * 60, 13)]
    blob = {"data": b"".join(p.encode() for _, p, _ in pieces)}
    blob["owner"] = np.array([o for o, _, _ in pieces], "<i8").tobytes()
    blob["start"] = np.array([a for _, _, a in pieces], "<i4").tobytes()
    blob["number"] = np.array([len(p) - exact_repeats.LEAST + 1 for _, p, _ in pieces], "<u1").tobytes()
    table = pa.table({"pack": pa.array([6]), **{c: pa.array([v], pa.binary()) for c, v in blob.items()}})
    sizes, factors = [], exact_repeats.previous_factors

    def counted(data, ends, owner):
        sizes.append(len(data))
        return factors(data, ends, owner)

    monkeypatch.setattr(exact_repeats, "previous_factors", counted)
    (row,) = exact_repeats._previous_factors(table).to_pylist()
    windows = [(p[i : i + 50], o, a + i) for o, p, a in pieces for i in range(len(p) - 49)]
    least = {}
    for w, o, _ in windows:
        least[w] = min(least.get(w, o), o)
    want = sorted(at for w, o, at in windows if o > least[w])
    assert sorted(np.frombuffer(row["start"], "<i4").tolist()) == want and row["pack"] == 6 and len(want) > 20
    assert sizes == [sum(len(p) for _, p, a in pieces if 7 <= a <= 10)]


def test_pieces_of_a_pack_come_in_few_batches():
    """A pack has a row for each bucket; rows are handed on together."""
    rnd = random.Random(7)
    text = "".join(rnd.choice("abcdefgh") for _ in range(40_000)).encode()
    columns = {"pack": [3], "keys": [[1]], "sizes": [[len(text)]], "data": [pa.compress(text, "zstd", asbytes=True)]}
    kept = []

    class Packs:
        def mapInArrow(self, run, schema):
            kept.extend(run(iter([pa.RecordBatch.from_pydict(columns)])))

    exact_repeats._pieces_of_packs(Packs(), 900)
    assert sum(b.num_rows for b in kept) > 600 and len(kept) == 1
    assert sorted(set(b for k in kept for b in k.column(0).to_pylist())) == kept[0].column(0).to_pylist()
