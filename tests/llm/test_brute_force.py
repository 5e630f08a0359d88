"""Votes, trees, shards and pages against plain re-evaluations, and pages made to hurt."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from goldrec.llm import html_layout, latent_votes, queries, sharding, url_filter

SF = "/root/testdata/sf0.001"


# ---- votes ----------------------------------------------------------------


def plain_vote(model, counts):
    """One text against all labelled vectors, sorted by similarity and place."""
    row = np.log1p(counts) * model.idf
    row[: latent_votes.TERMS] /= max(np.linalg.norm(row[: latent_votes.TERMS]), 1e-12)
    row[latent_votes.TERMS :] = np.where(counts[latent_votes.TERMS :] > 0, latent_votes.SHAPE, 0)
    latent = row.astype(np.float64) @ model.basis.astype(np.float64)
    latent /= max(np.linalg.norm(latent), 1e-12)
    like = [round(float(v @ latent), latent_votes.LIKE_DIGITS) for v in model.vectors.astype(np.float64)]
    near = sorted(range(len(like)), key=lambda i: (-like[i], i))[: latent_votes.NEIGHBOURS]
    weight = [max(like[i], 0) ** 4 for i in near]
    vote = sum(w * model.labels[i] for w, i in zip(weight, near, strict=True)) + 1e-6 * model.prior
    return vote / (sum(weight) + 1e-6)


def test_votes_against_brute_force_and_equal_rows_alike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    copies = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    both = docs.select("doc_id", "text").unionByName(copies)
    model = latent_votes.fit(docs, labels)
    one = {r.doc_id: r.score for r in latent_votes.score(both.repartition(7), model).collect()}
    two = {r.doc_id: r.score for r in latent_votes.score(both.repartition(31).orderBy("text"), model).collect()}
    assert one == two and len(one) == both.count()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    by_text = {}
    for key, text in texts.items():
        assert one[key] == one[key + 10_000] == by_text.setdefault(text, one[key])
    some = sorted(texts)[:60]
    counts = latent_votes.term_counts([texts[k] for k in some])
    for k, row in zip(some, counts, strict=True):
        assert abs(one[k] - plain_vote(model, row)) < 1e-3
    again = latent_votes.fit(docs.repartition(9), labels.repartition(3))
    assert {r.doc_id: r.score for r in latent_votes.score(both, again).collect()} == one


def test_nearest_takes_the_first_of_equals():
    rng = random.Random(1)
    for _ in range(300):
        like = np.array([rng.choice([0.1, 0.2, 0.3]) for _ in range(rng.randint(1, 12))])
        k = rng.randint(1, len(like))
        want = sorted(range(len(like)), key=lambda i: (-like[i], i))[:k]
        assert sorted(latent_votes.nearest(like, k)) == sorted(want)


# ---- URLs -----------------------------------------------------------------


def urls(spark, rows):
    return spark.createDataFrame(rows, "url string, label int")


def features(rows):
    host, path = url_filter.host_and_path(F.col("url"))
    return url_filter.lexical(rows.withColumns({"host": host, "path": path}))


def test_trees_against_their_own_splits(spark):
    rows = [(f"https://a{i}.org/x/{i}", 0) for i in range(60)] + [(f"https://b{i}.biz/?q={i}&r=1&s=2", 1) for i in range(60)]
    known = features(urls(spark, rows))
    suffixes = url_filter.suffix_statistics(known)
    model = url_filter.train(known, suffixes)
    vectors = url_filter._vectors(known, suffixes).select("url", "features").collect()
    margin = {r.url: sum(w * t.predict(r.features) for w, t in zip(model.treeWeights, model.trees, strict=True)) for r in vectors}
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = url_filter.judge(pages, urls(spark, rows), rules=()).collect()
    assert {rows[r.page_id][0]: r.verdict for r in got} == {u: "block" if m > 0 else "allow" for u, m in margin.items()}
    assert sum((r.verdict == "block") == bool(rows[r.page_id][1]) for r in got) >= 115


def test_copies_of_a_url_do_not_fill_the_sample(spark):
    rows = [("https://hot.biz/?a=1&b=2", 1)] * 3000
    rows += [(f"https://b{i}.biz/?q={i}&r=1", 1) for i in range(30)] + [(f"https://a{i}.org/x", 0) for i in range(30)]
    known = features(urls(spark, rows))
    model = url_filter.train(known, url_filter.suffix_statistics(known), rows=40)
    assert model is not None and model.getNumTrees > 1
    pages = spark.createDataFrame([(1, "https://a77.org/x"), (2, "https://b77.biz/?q=9&r=1")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, urls(spark, rows), rules=()).collect()}
    assert got == {1: "allow", 2: "block"}
    alone = url_filter.judge(pages, urls(spark, rows[:5]), rules=())
    assert {r.verdict for r in alone.collect()} == {"block"}


# ---- shards ---------------------------------------------------------------


def greedy_spread(sizes, shards):
    out = [0] * shards
    for size in sorted(sizes, reverse=True):
        out[out.index(min(out))] += size
    return max(out) - min(out)


def test_shards_against_a_plain_layout(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op6_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    size = {k: len((t or "").encode()) + 1 for k, t in texts.items()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {
        k: (size[k], zlib.crc32((t or "").encode())) for k, t in texts.items()
    }
    shards = [0] * 16
    for r in got:
        shards[r.shard] += r.size
    mean = sum(shards) / 16
    assert max(shards) - min(shards) <= max(2 * greedy_spread(size.values(), 16), mean * 0.02)


def test_files_of_rows_that_stay_are_not_rewritten(spark, docs_of):
    rng = random.Random(4)
    docs = docs_of([(i, "x" * rng.randint(0, 90)) for i in range(800)])
    layout = sharding.lay_out(docs, "doc_id", "text", 3, 1500)
    placed = sharding.assign(layout, 4).collect()
    total = sum(r["size"] for r in placed)
    old, new = [0] * 3, [0] * 4
    for r in placed:
        old[r["old_shard"]] += r["size"]
        new[r["shard"]] += r["size"]
    moved = sum(r["size"] for r in placed if r["old_shard"] != r["shard"])
    least = total - sum(min(a, b) for a, b in zip(old, sharding.even(total, 4), strict=False))
    assert least <= moved <= least + 4 * 91 + 0.02 * total
    assert max(new) - min(new) <= 3


def test_single_moves_bring_sizes_together():
    rng = random.Random(9)
    for _ in range(50):
        rows, sizes = [], [0] * 5
        for i in range(60):
            s, n = rng.randrange(5), rng.randint(1, 40)
            rows.append((0, 0, i, n, s))
            sizes[s] += n
        moves = {i: to for _, _, i, to in sharding._single_moves(sizes, rows)}
        after = [0] * 5
        for _, _, i, n, s in rows:
            after[moves.get(i, s)] += n
        assert max(after) - min(after) <= 2 and sum(after) == sum(sizes)


# ---- pages ----------------------------------------------------------------


def grid_places(table):
    """Columns by the plain way: a set of held places; the earlier cell keeps its own."""
    held, out = set(), []
    for y, row in enumerate(table):
        x, own = 0, []
        for across, down in row:
            while (y, x) in held:
                x += 1
            own.append(x)
            for c in range(x, x + across):
                if (y + 1, c) not in held:
                    held |= {(y + k, c) for k in range(1, down)}
            x += across
        out.append(own)
    return out


def test_cells_stand_where_a_grid_puts_them():
    rng = random.Random(2)
    for _ in range(2000):
        plan = [[(rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 4])) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 7))]
        table = html_layout.Table()
        for row in plan:
            table.row()
            for across, down in row:
                table.add(html_layout.Node("td", {"colspan": str(across), "rowspan": str(down)}), ["x"])
        assert [[x for x, _ in row] for row in table.rows] == grid_places(plan)


def filled(unit, before="", size=1 << 20):
    return before + unit * (size // len(unit))


HURTING = {
    "spans": "<table>" + "<tr><td colspan=1000 rowspan=1000>" * 25,
    "many spans": filled("<td colspan=1000 rowspan=1000>x", "<table><tr>"),
    "rows of spans": filled("<tr><td rowspan=1000>a<td rowspan=999>b", "<table>"),
    "wide and long": filled("<tr><td>b", filled("<td>a", "<table><tr>", 1 << 17)),
    "long cell": filled("<tr><td>b<td>c", "<table><tr><td>" + "w" * 100_000),
    "hopeless ends": filled("</span>", filled("<b>", "<span><table>", 1 << 18)),
    "quotes": filled("<blockquote>a"),
    "lists": filled("<ol><li>a"),
    "open comments": filled("<!--"),
    "open quotes": filled("<a b='"),
    "tables": filled("<table><tr><td>x"),
}


@pytest.mark.parametrize("name", HURTING)
def test_time_and_output_grow_with_the_page(name):
    page = HURTING[name]
    start = time.process_time()
    text = html_layout.render(page).text
    assert time.process_time() - start < 60
    assert len(text) <= 12 * len(page)


@pytest.mark.parametrize(
    "page, text",
    [
        ("a<textarea>\n x &amp;\n  <b>y</textarea>z", "a x &\n  <b>yz"),
        ("<svg><title>t</title><desc>d</desc><text>seen</text><style>s</style>loose</svg>", "seen"),
        ("<svg><text>a<tspan>b</tspan></text><text>c</text></svg>", "ab\nc"),
        ("<div style='visibility:hidden'>h<b style='visibility: visible'>v</b>h</div>w", "v\nw"),
        ("<div style='display:none'>h<b style='visibility: visible'>v</b></div>w", "w"),
        ("<table><tbody><tr><td rowspan=5>a<td>b<tbody><tr><td>c<td>d</table>", "a | b\nc | d"),
    ],
)
def test_what_is_shown(page, text):
    assert html_layout.render(page).text == text


def test_hidden_parts_do_not_count(spark):
    page = "<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul><table style='visibility:collapse'><td>c</table>"
    got = html_layout.render(page)
    assert (got.text, got.n_items, got.n_rows, got.n_cells) == ("- b", 1, 0, 0)
