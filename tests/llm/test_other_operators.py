"""Formatting, filters, mixing, sharding, votes, rendering, the pipeline and the SQL."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from goldrec.llm import html_layout, latent_votes, mixing, preferences, sharding, simhash, url_filter
from goldrec.llm.oracle import SQL
from goldrec.llm.queries import QUERIES, table
from tools.check import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    con = duck(SF)
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    con.close()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


# ---- chat pairs -----------------------------------------------------------


def test_preferences(spark):
    schema = "key long, chosen array<struct<role: string, text: string>>, rejected array<struct<role: string, text: string>>"
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    pairs = [(1, [u, a], [u, b]), (2, [u, a], [u, a]), (3, [a], [u, a]), (4, [u, a, u], [u, a]), (5, [], [])]
    got = {r.key: r for r in preferences.format_preferences(spark.createDataFrame(pairs, schema), "key").collect()}
    assert [got[k].n_common for k in range(1, 6)] == [1, 2, 0, 2, 0]
    assert got[1].prompt == "<|user|>\nhi<|end|>\n"
    assert got[1].chosen == "<|assistant|>\nyes<|end|>\n"
    assert [got[1].chosen[m.s : m.e] for m in got[1].chosen_mask] == ["yes<|end|>\n"]
    assert [got[3].rejected[m.s : m.e] for m in got[3].rejected_mask] == ["yes<|end|>\n"]
    assert (got[2].chosen, got[2].chosen_mask, got[5].prompt) == ("", [], "")
    assert got[4].chosen == "<|user|>\nhi<|end|>\n" and got[4].chosen_mask == []


def test_earlier_replies(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a<|2")]
    turns += [(2, 0, "user", "echo"), (2, 1, "assistant", "x"), (2, 2, "user", "after"), (3, 0, "user", "alone")]
    turns += [(4, 0, "assistant", None), (5, 0, None, None), (None, 0, "assistant", "n"), (6, 1, "assistant", "t")]
    turns += [(6, 1, "assistant", "t")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = preferences.with_earlier_reply(preferences.conversations(df))
    got = {r.conv_id: (r.chosen[-1].text, r.rejected[-1].text) for r in pairs.collect()}
    assert got == {1: ("a< |2", "a1"), 2: ("x", "echo"), 4: ("", ""), None: ("n", ""), 6: ("t", "t")}
    assert preferences.conversations(df.limit(0)).count() == 0


# ---- URLs -----------------------------------------------------------------


def test_rules_and_verdicts(spark):
    urls = [None, "", "nothing", "http://Example.COM/en/x", "http://a.example.com/en/", "https://www.example.com/en/1"]
    urls += ["http://example.com", "http://x.net/es/1?q=/", "ftp://net/fr/", "http://notnet/es/", "://net/es/"]
    urls += ["http://h#://net/es/", "http://a.b.www.example.com/en/y?z", "http://example.com?/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labelled = url_filter.labelled_by_rules(pages)
    got = {r.page_id: r for r in url_filter.judge(pages, labelled).collect()}
    want_rule = [None, None, None, "example.com/en/", "example.com/en/", "www.example.com/en/"]
    want_rule += [None, "net/es/", "net/fr/", None, "net/es/", None, "www.example.com/en/", None]
    assert [got[i].rule for i in range(len(urls))] == want_rule
    assert (got[3].host, got[3].path) == ("example.com", "/en/x")
    assert (got[0].host, got[2].path, got[11].host, got[13].path) == ("", "", "h", "")
    assert {got[i].verdict for i in (5, 12)} == {"allow"} and {got[i].verdict for i in (3, 7, 8, 10)} == {"block"}
    assert all(r.verdict in ("allow", "block") for r in got.values())
    none = url_filter.judge(pages, labelled.limit(0))
    assert {r.verdict for r in none.filter("rule is null").collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), labelled).count() == 0


def test_trees_learn_lexical_labels(spark):
    random.seed(4)
    urls = []
    for i in range(900):
        bad = i % 3 == 0
        tail = "".join(random.choice("0123456789") for _ in range(14)) if bad else random.choice(["about", "news"])
        urls.append((f"https://h{i}.org/{tail}", int(bad)))
    known, rest = urls[:600], urls[600:]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rest)], "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame(known, "url string, label int"), rules=())
    right = sum((r.verdict == "block") == bool(rest[r.page_id][1]) for r in got.collect())
    assert right >= 0.97 * len(rest)


# ---- mixing ---------------------------------------------------------------


def mixture(docs_of, sizes, **how):
    rows = [(1000 * s + i, "w " * 10, f"s{s}") for s, n in enumerate(sizes) for i in range(n)]
    return docs_of(rows), mixing.Mix(block_tokens=40, **how)


def test_mixture_keeps_all_and_repeats_within_limit(docs_of):
    docs, mix = mixture(docs_of, [400, 30, 30, 60], repeat=2.0)
    got = Counter(r.doc_id for r in mixing.mix_rows(docs, mix).collect())
    assert len(got) == 520 and set(got.values()) <= {1, 2}
    per = Counter(k // 1000 for k, n in got.items() for _ in range(n))
    assert per[0] == 400 and per[1] == per[2] and per[1] > 30 and per[1] / 30 > per[3] / 60


def test_mixture_meets_entropy_and_budget(docs_of):
    docs, mix = mixture(docs_of, [400, 30, 30, 60], entropy=0.97, epochs=1.5)
    out = mixing.mixed(docs, mix)
    assert out.count() <= 780
    got = out.groupBy("source").agg(
        F.count("*").alias("n"), F.first("weight_ppb").alias("w"), F.first("exponent_ppm").alias("e")
    )
    got = {r.source: r for r in got.collect()}
    for r in got.values():
        assert abs(10 * r.n - r.w * 7800 / 1e9) <= 10
    assert 0 < got["s0"].e < 1_000_000
    w = [r.w / 1e9 for r in got.values()]
    import math

    assert -sum(x * math.log(x) for x in w) >= 0.97 * math.log(4) - 1e-5
    orders = out.filter("source = 's1'").groupBy("epoch").agg(F.sort_array(F.collect_list(F.struct("block_position", "block"))))
    assert orders.count() > 1


def test_mixture_edges(docs_of):
    odd = docs_of([(None, None, None), (1, "", "e"), (1, "", "e"), (2, "a b", None)])
    got = mixing.mix_rows(odd, mixing.Mix(repeat=3.0))
    assert got.columns == odd.columns and got.count() == 4
    assert mixing.mix_rows(odd.limit(0), mixing.Mix(entropy=0.9)).count() == 0


# ---- sharding -------------------------------------------------------------


def test_transfers_move_the_fewest_bytes():
    random.seed(8)
    for _ in range(30):
        sizes = [random.randint(0, 50) for _ in range(random.randint(1, 5))]
        capacities = sharding.even(sum(sizes), random.randint(1, 6))
        flow = sharding.transfers(sizes, capacities)
        assert [sum(r) for r in flow] == sizes
        assert [sum(c) for c in zip(*flow, strict=True)] == capacities
        stay = sum(min(a, b) for a, b in zip(sizes, capacities, strict=False))
        moved = sum(x for s, r in enumerate(flow) for t, x in enumerate(r) if s != t)
        assert moved == sum(sizes) - stay
    cost = [[0, 9, 1], [9, 0, 1]]
    assert sharding.transfers([4, 0], [1, 1, 2], cost) == [[1, 1, 2], [0, 0, 0]]


def test_reshard(docs_of):
    random.seed(5)
    data = [(i, "é" * random.randint(0, 60)) for i in range(600)] + [(7, None), (None, "n"), (None, "n"), (9, "x" * 500)]
    got = sharding.reshard(docs_of(data), old_shards=3, shards=4, block_bytes=2000).collect()
    assert sorted(str((r.row.doc_id, r.row.text)) for r in got) == sorted(map(str, data))
    sizes = Counter()
    slots = {}
    for r in got:
        sizes[r.shard] += len((r.row.text or "").encode()) + 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == {0, 1, 2, 3}
    assert max(sizes.values()) - min(sizes.values()) <= 130
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.reshard(docs_of([])).count() == 0


# ---- votes ----------------------------------------------------------------


def test_votes_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = latent_votes.score(docs, latent_votes.fit(docs, labels))
    assert found.count() == docs.count()
    got = found.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 and (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_votes_use_no_held_out_label(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn(
        "quality", F.when(latent_votes.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    one, two = (latent_votes.score(docs, latent_votes.fit(docs, x)).toPandas() for x in (labels, flipped))
    assert one.sort_values("doc_id").score.round(6).tolist() == two.sort_values("doc_id").score.round(6).tolist()


def test_votes_edges(spark, docs_of):
    odd = docs_of([(None, None), (1, ""), (1, ""), (2, "a " * 5000)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in latent_votes.score(odd, latent_votes.fit(odd, none)).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None)], "doc_id long, quality int")
    assert latent_votes.score(odd, latent_votes.fit(odd, some)).count() == 4
    assert latent_votes.score(odd.limit(0), latent_votes.fit(odd, some)).count() == 0


# ---- rendering ------------------------------------------------------------

PAGES = [
    (None, ""),
    ("", ""),
    ("a  b\n c", "a b c"),
    ("<p>One<p>Two<br>2", "One\n\nTwo\n2"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  3. c\n  4. d\n- e"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1</table>x", "Name  | N\nalpha | 1\n\nx"),
    ("<table><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab |   | c\n1  | 2 | 3"),
    ("<title>t</title><script>if (a<b) '</p>'</script><style>x</style><p>v", "v"),
    ("<div hidden>h</div><p style='DISPLAY : none'>n<p>v<template>t</template>", "v"),
    ("<pre> a\n  b</pre>", " a\n  b"),
    ("1 &lt; 2 &amp; 3 < 4", "1 < 2 & 3 < 4"),
    ("a<!-- x > y -->b<!-- open", "ab"),
    ("<a title='>'>q</a> <b class=\"x>text", "q text"),
    ("</p>x</div></td>y", "xy"),
    ("<details><summary>s</summary>hid</details><details open>o</details>", "s\n\no"),
    ("<b" * 4000, "<b" * 4000),
    ("<div>" * 30000 + "deep", "deep"),
    ("<p>" + "word " * 50000, ("word " * 50000).strip()),
]


@pytest.mark.parametrize("page,text", PAGES, ids=range(len(PAGES)))
def test_render(page, text):
    assert html_layout.render(page).text == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>T</title><h1>Hi</h1><p>text", "Hi\n\ntext"),
        ("<head><meta charset=x><div>a</div><p>b</head>c", "a\n\nbc"),
        ("<head><link rel=x> \n bare <b>text</b>", "bare text"),
        ("<head>&nbsp;a", "\xa0a"),
        ("<head>1 < 2", "1 < 2"),
        ("<head>< 2", "< 2"),
        ("<head><script>s</script><style>p</style>\n<noscript>n</noscript><template><p>t</template><p>a", "a"),
        ("<head><base><basefont><bgsound><noframes>n</noframes><ul><li>a", "- a"),
        ("<head><head><title>T</title></title><p>a<head>b", "ab"),
        ("<head><title>T</title></body>a", "a"),
        ("<head></br>a", "a"),
        ("<head><title>T</title> \n </head><body>a", "a"),
        ("<head><title>T</title>\n", ""),
        ("<head><table><td>a<td>b", "a | b"),
    ],
)
def test_head_left_open(page, text):
    assert html_layout.render(page).text == text


def test_visible_text(spark):
    data = [(1, "<ul><li>a<li>b</ul><table><td>x</table>"), (1, None), (None, "t"), (2, "t")]
    got = html_layout.visible_text(spark.createDataFrame(data, "page_id long, html string")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(
        map(str, [(1, "- a\n- b\n\nx", 4, 2, 1, 1), (1, "", 0, 0, 0, 0), (None, "t", 1, 0, 0, 0), (2, "t", 1, 0, 0, 0)])
    )


# ---- the pipeline ---------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept, columns = docs, docs.columns
    ids = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            path = str(tmp_path / name)
            out.write.parquet(path)
            kept = spark.read.parquet(path)
            ids.append({r.doc_id for r in kept.select("doc_id").collect()})
        else:
            last = out
    rules = {r.doc_id for r in QUERIES["op1_quality_rules"](spark, SF).filter("kept").collect()}
    assert ids[0] == rules
    survivors = docs.filter(F.col("doc_id").isin(sorted(rules)))
    found = simhash.near_duplicates(survivors).select("component_id").distinct().collect()
    assert ids[1] == {r.component_id for r in found}
    clean = QUERIES["op2_decontamination"](spark, SF).filter("not contaminated").collect()
    assert ids[2] == ids[1] & {r.doc_id for r in clean}
    assert ids[3] == ids[2]
    got = last.collect()
    assert len(got) == kept.count() and {r.doc_id for r in got} == ids[3]
    assert {r.law for r in got} == {"bytes"} and {r.shard for r in got} == set(range(16))
