import random

import pytest
from pyspark.sql import functions as F

from goldrec.operators import match
from goldrec.sources import fixtures as fx

CONTACT = "{} string, name string, email string, phone string"


def contacts(seed, count, prefix):
    rnd = random.Random(seed)
    out = []
    for i in range(count):
        name = rnd.choice(("John", "Jon", "Bob", "Robert", "Ann")) + " " + rnd.choice(("Smith", "Smyth", "Doe", "Roe"))
        email = rnd.choice((None, "a.b@gmail.com", "ab@gmail.com", " A@x.org", "c@x.org", "d@x.org"))
        phone = rnd.choice((None, "+1-555-123-4567", "5551234567", "9995550000", "77"))
        out.append((f"{prefix}{i:03d}", name, email, phone))
    return out


def frames(spark, incoming, golden):
    return (
        spark.createDataFrame(incoming, CONTACT.format("incoming_id")),
        spark.createDataFrame(golden, CONTACT.format("national_id")),
    )


def edited(rnd, text, most, letters):
    """The text after up to ``most`` changed, inserted or dropped characters."""
    for _ in range(rnd.randint(0, most)):
        i = rnd.randint(0, len(text))
        cut = rnd.choice((0, 1))
        text = text[:i] + rnd.choice((rnd.choice(letters), "")) + text[i + cut :]
    return text


def odd_contacts(seed, count, prefix):
    """Contacts derived from few names, e-mails and phones, so that pairs come near all limits."""
    rnd, base = random.Random(seed), random.Random(1)
    names = ["john smith", "bob roe", "robert roe", "al", "é", "aaaa aaaa aaaa", "mary-ann van der berg", "jo", "bo li"]
    mails = ["j.smith@gmail.com", "jsmith@gmail.com", "a@b", "aaaaaaaa@aaaa", "robert.roe.1970@example.org", "x@y.z", "marie@firm.fr"]
    phones = ["5551234567", "7771234567", "12", "", None, "1-555-123-4567", "0000000"]
    base.shuffle(names)
    out = []
    for i in range(count):
        name = edited(rnd, rnd.choice(names), 3, "ajoe b") if rnd.random() < 0.95 else None
        mail = edited(rnd, rnd.choice(mails), 5, "ajm.1") if rnd.random() < 0.9 else None
        out.append((f"{prefix}{i:03d}", name, mail, rnd.choice(phones)))
    return out


def scores_of(scored):
    rows = scored.select("incoming_id", "national_id", "score", "matched_rules").collect()
    found = {(r.incoming_id, r.national_id): (r.score, r.matched_rules) for r in rows}
    assert len(found) == len(rows)
    return found


def every_pair(incoming, golden):
    """All profiles of one side with all of the other, scored."""

    def side(df, row_id, prefix):
        columns = ("profile", "copies", *match.COMPARED)
        return match.profiles(df, row_id).select(row_id, *(F.col(c).alias(f"{prefix}_{c}") for c in columns))

    pairs = side(incoming, "incoming_id", "in").crossJoin(side(golden, "national_id", "gold"))
    return scores_of(match.match_score(pairs).filter(F.col("score") >= 0.5))


@pytest.mark.parametrize("seed,limit", [(1, None), (4, 25)])
def test_scored_pairs_are_all_pairs_that_reach_the_limit(spark, hot_limit, seed, limit):
    incoming, golden = frames(
        spark,
        odd_contacts(seed, 260, "i") + contacts(seed, 30, "j"),
        odd_contacts(seed + 50, 240, "g") + contacts(seed + 9, 30, "h"),
    )
    want = every_pair(incoming, golden)
    if limit:
        hot_limit(limit)
    got = match.scored_pairs(incoming, golden)
    assert scores_of(got) == want and len(want) > 300
    assert {s >= 0.8 for s, _ in want.values()} == {True, False}


@pytest.mark.parametrize("seed", [1])
def test_near_names_against_all_names(spark, seed):
    rnd = random.Random(seed)
    words = ["", "a", "ab", "aba", "anan anan anan", "bo lee", "robert lee", "ann o'neil-smith", "Çelik öz"]
    left = sorted({edited(rnd, rnd.choice(words), 3, "abno ") for _ in range(220)})
    right = sorted({edited(rnd, rnd.choice(words), 3, "abno ") for _ in range(220)})
    a, b = (match.profiles(spark.createDataFrame([(n, n, None, None) for n in x], CONTACT.format("id")), "id") for x in (left, right))
    got = match.near_names(a, b).collect()
    a, b = (x.select("name").distinct().withColumns(match.name_parts()).withColumns(match._name_signals()) for x in (a, b))
    a, b = (x.select(*(F.col(c).alias(f"{p}_{c}") for c in x.columns)) for x, p in ((a, "in"), (b, "gold")))
    score = match.pair_scores()["name_score"]
    want = a.crossJoin(b).select("in_name", "gold_name", score.alias("s")).filter("s > 0").collect()
    assert sorted((r.in_name, r.gold_name, r.name_score) for r in got) == sorted(map(tuple, want))


def test_no_task_gets_all_pairs_of_a_hot_name(spark, hot_limit):
    """Every contact has one name and one phone; pairs are made in several tasks."""
    hot_limit(20)
    rows = [(str(i), "john smith", f"u{i}@x.org", "5551234567") for i in range(120)]
    incoming, golden = frames(spark, rows, rows)
    pairs = match.scored_pairs(incoming, golden)
    assert pairs.count() == 120 * 120


def test_copies_of_a_contact_meet_the_other_side_once(spark):
    one = ("Ann Doe", "a@x.org", "5551234567")
    incoming, golden = frames(
        spark, [(f"i{n}", *one) for n in range(50)], [(f"g{n}", *one) for n in range(60)]
    )
    pair = match.match_candidates(incoming, golden).collect()
    assert len(pair) == 1 and (pair[0].in_copies, pair[0].gold_copies) == (50, 60)
    best = match.best_match(incoming, match.scored_pairs(incoming, golden))
    assert best.count() == 50
    assert {r.national_id for r in best.collect()} == {"g0"}


def test_best_match_covers_every_incoming_contact(spark):
    incoming, golden = frames(
        spark,
        [("i1", "Jon Smith", "j@x.org", "5551234567"), ("i2", "Zed", None, None), ("i3", "Ann Roe", "q@x.org", "9995551234")],
        [("g1", "John Smyth", "j@x.org", "1-555-123-4567"), ("g2", "John Smith", "k@x.org", "5551234567"), ("g3", "Ann Doe", "w@y.net", "1115551234")],
    )
    scored = match.scored_pairs(incoming, golden)
    best = {r.incoming_id: r for r in match.best_match(incoming, scored).collect()}
    assert best["i1"].national_id == "g1" and best["i1"].match_type == "DUPLICATE"
    assert best["i2"].match_type == "NO_MATCH" and best["i2"].national_id is None
    assert best["i3"].score < 0.8
    queue = match.review_queue(scored).collect()
    assert [r.score for r in queue] == sorted((r.score for r in queue), reverse=True)


@pytest.mark.parametrize("limit", [None, 5], ids=["plain", "hot"])
def test_exact_email_takes_the_first_golden_record(spark, hot_limit, limit):
    if limit:
        hot_limit(limit)
    incoming, golden = frames(
        spark,
        [(f"i{n}", "x", " A@X.org ", None) for n in range(20)] + [("j", "x", None, None), ("k", "x", "b@x.org", None)],
        [("g2", "y", "a@x.org", None), ("g1", "y", "A@x.ORG", None), ("g3", "y", " b@x.org", None)],
    )
    got = match.match_email_exact(incoming, golden).collect()
    assert len(got) == 20 and {r.national_id for r in got} == {"g1"}


def test_class_limits(spark):
    df = spark.createDataFrame([(0.8,), (0.799999,), (0.5,), (0.499999,)], "score double")
    got = [r[0] for r in df.select(match.match_class(F.col("score"))).collect()]
    assert got == ["DUPLICATE", "POSSIBLE_DUPLICATE", "POSSIBLE_DUPLICATE", "NO_MATCH"]


def test_pairs_with_typos_are_found(spark):
    """Each pair shares one signal whole; of the other only pieces are left."""
    incoming = [
        ("i1", "John Smith", "john.smith@acme.com", None),
        ("i2", "Rob Cane", "r@acme.com", None),
        ("i3", "Ann Lee", "family.roe@acme.com", "5551234567"),
        ("i4", "Abe", "z@acme.com", "12"),
    ]
    golden = [
        ("g1", "John Smith", "john.smyth@acme.com", None),
        ("g2", "Bob Kane", "r@acme.com", None),
        ("g3", "Mary Poe", "family.poe@acme.com", "5551234567"),
        ("g4", "Obi", "z@acme.com", "12"),
        ("g5", "Ann Lee", "other@else.org", "5559999999"),
    ]
    incoming, golden = frames(spark, incoming, golden)
    scored = match.scored_pairs(incoming, golden)
    assert {(r.incoming_id, r.national_id) for r in scored.filter("score >= 0.5").collect()} == {
        (f"i{n}", f"g{n}") for n in range(1, 5)
    }


def test_members_give_back_all_copies(spark):
    rows = [("a", "Zoe", "Z@x.org", None), ("b", " zoe", "z@x.org ", None), ("c", None, None, None), ("d", "", "", "")]
    df = spark.createDataFrame(rows, CONTACT.format("id"))
    assert sorted(map(tuple, match.match_members(df, "id").collect())) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]


def test_best_match_equals_that_of_all_pairs(spark):
    incoming, golden = frames(spark, odd_contacts(7, 150, "i"), odd_contacts(8, 150, "g"))
    best = {}
    for (i, g), (score, _) in every_pair(incoming, golden).items():
        best[i] = min(best.get(i, (0, "")), (-score, g))
    copies = {r["incoming_id"]: r["representative"] for r in match.match_members(incoming, "incoming_id").collect()}
    for r in match.best_match(incoming, match.scored_pairs(incoming, golden)).collect():
        want = best.get(copies[r["incoming_id"]], (0, None))
        assert (r["score"], r["national_id"]) == (-want[0], want[1])


@pytest.mark.parametrize("box", ["jon.smith"])
def test_one_changed_character_at_any_place_is_found(spark, box):
    other = {box[:i] + "x" + box[i:] for i in range(len(box) + 1)}
    other |= {box[:i] + rest + box[i + 1 :] for i in range(len(box)) for rest in ("", "y")}
    incoming, golden = frames(
        spark,
        [("i", "John Smith", f"{box}@acme.com", None)],
        [(b, "John Smith", f"{b}@acme.com", None) for b in sorted(other)],
    )
    got = {r["national_id"]: r["score"] for r in match.scored_pairs(incoming, golden).collect()}
    assert set(got) == other and min(got.values()) > 0.7


def test_scored_pairs_are_not_stored(spark, monkeypatch):
    """Pairs of like names are as many as the square of a name's bearers."""
    stored, store = [], match.durable

    def durable(df, name="step"):
        stored.append(set(df.columns))
        return store(df, name)

    monkeypatch.setattr(match, "durable", durable)
    sf = "/root/testdata/sf0.001"
    found = match.scored_pairs(fx.incoming_contacts(spark, sf), fx.golden_contacts(spark, sf))
    assert found.count() and len(stored) > 4
    assert not any({"email_score", "phone_score"} & columns for columns in stored)


def test_no_table_of_pairs_is_stored(spark, monkeypatch):
    """Pairs are many times the contacts: they are told apart where they meet."""
    stored, store = [], match.durable

    def durable(df, name="step"):
        stored.append(set(df.columns))
        return store(df, name)

    monkeypatch.setattr(match, "durable", durable)
    incoming, golden = frames(spark, odd_contacts(2, 40, "i"), odd_contacts(3, 40, "g"))
    scored = match.scored_pairs(incoming, golden)
    assert scored.count() == scored.select("incoming_id", "national_id").distinct().count() > 0
    assert not any({"incoming_id", "national_id"} <= columns for columns in stored)


@pytest.mark.parametrize("limit", [None, 20])
def test_best_match_keeps_one_number_a_contact(spark, hot_limit, limit):
    if limit:
        hot_limit(limit)
    copies = [("i", "Ann Doe", "a@x.org", None), (None, "Ann Doe", "b@x.org", None)]
    incoming, golden = frames(spark, odd_contacts(5, 90, "i") + copies, odd_contacts(6, 90, "g") + copies + copies[:1])
    pairs, places = match.placed_pairs(incoming, golden)
    best = match.best_match(incoming, pairs, places)
    want = match.best_match(incoming, pairs)
    plan = best._jdf.queryExecution().executedPlan().toString().splitlines()
    reduced = [line for line in plan if "partial_min" in line and "gold_place" in line]
    assert reduced and all(" HashAggregate(" in line for line in reduced)
    rows = sorted(map(str, best.collect()))
    assert rows == sorted(map(str, want.collect())) and len(rows) == 92
    ids = [r.national_id for r in places.orderBy("gold_place").collect()]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
