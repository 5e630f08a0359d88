"""Packing, the Merkle manifest and the filter audit against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from goldrec.llm import filter_audit, merkle, packing, queries

random.seed(21)
PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(5000))
TEXTS = [None, "", " \t\n", "one.", "Two, THREE", "x " * 700, LONG, LONG, "é" * 9000, "a\x1cb c", "l'été d'Été 1²", "ok <|endoftext|> go"]
ROWS = [(i, t, random.choice(["s", "t", None])) for i, t in enumerate(TEXTS)]
ROWS += [(3, "one.", "s")] * 5 + [(None, "null key", "t"), (None, "null key", "t")]
ROWS += [(100 + i, " ".join(["to"] * random.randint(1, 90)), "s") for i in range(40)]


# ---- packing ---------------------------------------------------------------


def test_chunked_tokens_are_the_tokenizers():
    signs = list("abcDEéÉßÿÀª²½µ .,;:!?'\"-\n\t\x0b\x1c\x1f\x85\xa0 ​̱́HσΣςİ漢한각א٢９😀#$<|>")
    signs += ["<|endoftext|>", "'s", "'ll", "n't", "  ", "mm", "ö.", "X..."]
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 50))) for _ in range(3000)]
    latin = [t.encode("latin-1", "ignore").decode("latin-1") for t in texts]
    whole, mine = Tokenizer.from_file(PATH), packing.Tokens(PATH)
    for some in (texts[:1500], latin, texts[1500:], []):
        ids, upto = mine.encode(pa.array(some, pa.string()))
        got = [x.tolist() for x in np.split(ids, upto[:-1])] if some else []
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in some]
        mine.size = packing.MOST_KNOWN + 1  # forgets before the next batch


def sequences(rows, capacity):
    """Checks that every sequence is gapless and within the capacity; how many there are."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [50, 4096])
def test_packing(docs_of, capacity):
    docs = docs_of(ROWS)
    rows = packing.pack(docs.repartition(7), PATH, capacity=capacity, ids=True).collect()
    whole, want = Tokenizer.from_file(PATH), []
    for key, text, _ in ROWS:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((key, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), own))
    got = [(r["key"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    used = sequences(rows, capacity)
    assert used <= -(-sum(x[3] for x in want) // capacity) + 1


def first_fit(counts, capacity):
    bins = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, b in enumerate(bins) if b >= length]
        if fits:
            i = min(fits, key=lambda i: bins[i])
            bins[i] -= length
        else:
            bins.append(capacity - length)
    return len(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan_uses_every_piece_once(seed):
    rng, capacity = random.Random(seed), random.choice([7, 20, 64, 200])
    counts = {x: rng.randint(1, 60) for x in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 25)))}
    patterns = packing.plan(counts, capacity)
    used = {}
    for p in patterns:
        assert p.n > 0 and sum(p.lengths) <= capacity
        for x in p.lengths:
            used[x] = used.get(x, 0) + p.n
    assert used == counts
    free = np.zeros(capacity + 1, np.int64)
    for x, n in counts.items():
        free[x] = n
    alone = sum(p.n for p in packing._best_fit(free, capacity))
    assert alone == first_fit(counts, capacity)  # the grouped form is best-fit decreasing
    full = sum(x * n for x, n in counts.items()) / capacity
    assert full <= sum(p.n for p in patterns) <= alone * 1.1 + 1


def test_exact_complements_come_first():
    # best-fit decreasing needs three sequences here: 6 + 3, 5 + 4, 2
    assert sum(p.n for p in packing.plan({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10)) == 2
    found = packing.plan({7: 2, 1: 6}, 10)
    assert [(p.n, p.lengths) for p in found] == [(2, (7, 1, 1, 1))]


def test_plan_does_not_grow_with_the_table():
    rng = random.Random(5)
    counts = {x: rng.randint(1, 50) for x in rng.sample(range(1, 4097), 700)}
    few, many = packing.plan(counts), packing.plan({x: n * 10_000 for x, n in counts.items()})
    assert len(many) <= 3 * 4096 and len(many) < 3 * len(few)
    assert len(packing.places(many)) < 12 * len(many)


# ---- Merkle manifest -------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([h(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return out


def proof(tree, at):
    for level in tree[:-1]:
        first = at - at % 3
        yield level[first:at], level[at + 1 : first + 3]
        at //= 3


def brute_manifest(rows):
    """``rows``: key, group, leaf, claim."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])):
        groups.setdefault(r[1], []).append(r)
    trees = {g: levels([r[2] for r in rs]) for g, rs in groups.items()}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    crown = levels([trees[g][-1][0] for g in order])
    out = []
    for g, rs in groups.items():
        for i, (key, _, leaf, claim) in enumerate(rs):
            sides = [*proof(trees[g], i), *proof(crown, order.index(g))]
            folded = claim
            for left, right in sides:
                folded = h(*left, folded, *right)
            siblings = "".join(x for left, right in sides for x in [*left, *right])
            out.append((key, leaf, trees[g][-1][0], crown[-1][0], siblings, folded))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [3], [1, 2, 4], [9, 10, 28], [730, 1, 5], [2300, 40, 81], [1] * 800])
def test_manifest(spark, sizes):
    rng, rows = random.Random(len(sizes)), []
    for g, n in enumerate(sizes):
        name = [None, "", "=", "a/1", "ä", "-"][g] if g < 6 and len(sizes) < 10 else f"g{g}"
        keys = [rng.choice([None, i, i, i, 7]) for i in range(n)]
        for k in keys:
            leaf = h(str(rng.randint(0, n)))
            rows.append((k, name, leaf, rng.choice([leaf, h("other")])))
    rows += rows[:1] * 3
    df = spark.createDataFrame(rows, "key long, group string, leaf string, claim string").repartition(5)
    path = merkle.durable(df, "rows")
    got = merkle.climb(merkle.build(path)).withColumn("siblings", F.lower(F.hex("siblings"))).collect()
    got = [tuple(r[c] for c in ("key", "leaf", "subroot", "root", "siblings", "folded_root")) for r in got]
    assert sorted(got, key=str) == brute_manifest(rows)


def test_manifest_by_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_BROADCAST", 0)
    test_manifest(spark, [760, 3, 1])


def test_recursion_limit_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    test_manifest(spark, [4])
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_manifest_query(spark, docs_of, tmp_path):
    rows = [*ROWS, (501, "a\nb\n", "s"), (502, "\n", None)]
    got = queries.op12_merkle_manifest(spark, write(spark, tmp_path, documents=docs_of(rows))).collect()

    def leaf(key, source, text):
        values = [key, source, "en", len(text or "") if text is not None else 0, text]
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    plain = []
    for k, t, s in rows:
        own = leaf(k, s, t)
        if k is not None and zlib.crc32(str(k).encode()) % 2 == 0 and t is not None:
            values = [k, s, "en", len(t), t.replace("\n", "")]
            claim = h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
        else:
            claim = own
        plain.append((k, s, own, claim))
    want = brute_manifest(plain)
    want = [(k, a, b, c, h(p), f, f == c) for k, a, b, c, p, f in want]
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(want, key=str)
    assert {r["verified"] for r in got} == {True, False}


# ---- filter audit ----------------------------------------------------------


def brute_audit(docs, good, toxic):
    def fails(key, text):
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        out = set()
        if len(words) < 100:
            out.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            out.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            out.add("C")
        if any(c in "#$%&*|" for c in text):
            out.add("D")
        if key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in docs):
            out.add("E")
        return out

    parts = {}
    for key, text, lang in docs:
        parts.setdefault(lang or "", []).append((fails(key, text), key in good, key in toxic))
    out = []
    for part, rows in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        each = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                total[f] += len(gone)
                redundant = sum(f in r[0] for r in rows) - len(gone)
                alone = sum(r[0] == {f} for r in rows)
                lost = sum(r[1] for r in gone), sum(r[2] for r in gone)
                each.append((part, "".join(order), step, len(left), len(gone), redundant, alone, *lost))
        out += [(*x, total[x[1][x[2] - 1]]) for x in each]
    return sorted(out)


def test_audit(spark, tmp_path):
    rng, docs = random.Random(2), []
    many = [f"w{i}" for i in range(130)]
    texts = [None, "", "short", " ".join(many), " ".join(many[:40] * 3), "ABC DEF " * 60, " ".join(many) + " #", "A" * 9 + " " * 81]
    for i in range(160):
        docs.append((rng.choice([None, i, i, 5]), rng.choice(texts), rng.choice(["en", None, "", "de"])))
    docs += [(9, "short", "xx")] * 4
    langs = spark.createDataFrame([(k, t, g) for k, t, g in docs], "doc_id long, text string, lang string")
    for c in ("mask", "n", "part", "digest", "first"):
        langs = langs.withColumn(c, F.lit(1))
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(5, 1, 0), (None, 1, 1), (4, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    good = {k for k, q, _ in marks if q == 1 and k is not None}
    toxic = {k for k, _, t in marks if t == 1 and k is not None}
    got = queries.op13_filter_audit(spark, write(spark, tmp_path, documents=langs.repartition(6), labels=labels))
    got = sorted(map(tuple, got.collect()))
    assert got == brute_audit(docs, good, toxic)


def test_path_weights():
    lattice = filter_audit.edges(5)
    assert len(lattice) == 80
    for i in range(5):  # every order passes over one edge of each filter
        assert sum(w for _, f, w in lattice if f == i) == 120


def test_new_operators_on_empty_tables(spark, docs_of, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    folder = write(spark, tmp_path, documents=docs_of([]), labels=labels)
    for name in ("op11_best_fit_packing", "op12_merkle_manifest", "op13_filter_audit"):
        assert queries.QUERIES[name](spark, folder).collect() == []
