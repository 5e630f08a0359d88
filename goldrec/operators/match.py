"""Duplicate matching of incoming contacts against golden contacts.

``incoming`` has ``incoming_id, name, email, phone``; ``golden`` has
``national_id, name, email, phone``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldrec.functions import similarity as S
from goldrec.functions.text import norm_email, norm_name, norm_phone
from goldrec.plans.durable import durable
from goldrec.plans.skew import join_unique, salted_join, spread

#: Pieces counted as frequent; which they are changes the work, never the pairs.
FREQUENT = 64
#: Names of few different pieces up to this length are found by what two edits leave.
SHORT_NAME = 8
COMPARED = (
    "email", "email_key", "name", "phone", "phone_key", "first_name", "last_name", "first_sound", "last_sound", "first_full"
)
#: A score in millionths above the place of a golden id fits one long: 20 and 43 bits.
MILLION = 1_000_000
PLACES = 1 << 43


def match_email_exact(incoming: DataFrame, golden: DataFrame) -> DataFrame:
    """First golden record with the incoming e-mail. The golden side is folded to
    one row per e-mail before the join, so no pair list is built. Golden e-mails
    are case-folded only, not trimmed."""
    first = (
        golden.filter(F.col("email").isNotNull())
        .groupBy(F.lower("email").alias("email_key"))
        .agg(F.min("national_id").alias("national_id"))
    )
    wanted = incoming.select(
        "incoming_id", norm_email(F.col("email")).alias("email_key")
    ).filter(F.col("email_key").isNotNull())
    return join_unique(wanted, first, "email_key", bound=incoming).select(
        "incoming_id",
        "national_id",
        F.lit(1.0).alias("score"),
        F.lit("EMAIL_EXACT_MATCH").alias("rule"),
    )


def with_profile(contacts: DataFrame) -> DataFrame:
    """Add the cleaned values that scores depend on and ``profile``, their key."""
    clean = contacts.withColumns(
        {
            "email": norm_email(F.col("email")),
            "name": norm_name(F.col("name")),
            "phone": norm_phone(F.col("phone")),
        }
    )
    parts = [F.coalesce(c, F.lit("")) for c in ("email", "name", "phone")]
    return clean.withColumn("profile", F.sha2(F.concat_ws("\x01", *parts), 256))


def profiles(contacts: DataFrame, row_id: str) -> DataFrame:
    """Distinct contact profiles with their smallest id and number of copies, so
    copies of one contact meet the other side once."""
    values = ("email", "name", "phone")
    return (
        with_profile(contacts)
        .groupBy("profile")
        .agg(
            *(F.first(v).alias(v) for v in values),
            F.min(row_id).alias(row_id),
            F.count(F.lit(1)).alias("copies"),
        )
        .withColumns(name_parts())
        .withColumns(_signals())
    )


def name_parts(name: str = "name", prefix: str = "") -> dict[str, Column]:
    """First and last word of a cleaned name; a single word is a first name."""
    words = F.split(F.col(name), r"\s+")
    return {
        f"{prefix}first_name": F.get(words, F.lit(0)),
        f"{prefix}last_name": F.when(F.size(words) > 1, F.element_at(words, -1)),
    }


def _name_signals(prefix: str = "") -> dict[str, Column]:
    def sound(name: str) -> Column:
        return F.when(F.length(name) > 0, S.sound_code(F.col(name)))

    return {
        f"{prefix}first_sound": sound(f"{prefix}first_name"),
        f"{prefix}last_sound": sound(f"{prefix}last_name"),
        f"{prefix}first_full": S.canonical_name(F.col(f"{prefix}first_name")),
    }


def _signals() -> dict[str, Column]:
    """What blocks and scores compare, worked out once per profile, not per pair."""
    gmail = F.col("email").contains("@gmail.com")
    return {
        "email_key": F.when(gmail, F.regexp_replace("email", r"\.", "")).otherwise(F.col("email")),
        "phone_key": F.coalesce(S.last_digits(F.col("phone")), F.nullif(F.col("phone"), F.lit(""))),
        **_name_signals(),
    }


# ---- edit distance by rare pieces -------------------------------------------
#
# Two texts within d edits share all but 2 d of the different two-character pieces of
# either. In any one order of all pieces, the first that they share is then among the first
# 2 d + 1 of both. So texts meet on those, and with the rare pieces in front few others do.
# Texts of 2 d different pieces or less may share none and need another key.


def _pieces(text: str) -> Column:
    """The different pieces of two characters; a single character is a piece."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1)))
    pieces = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(2))))
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


def frequent_pieces(rows: DataFrame, text: str) -> list[str]:
    """The pieces that most rows have, the most frequent last."""
    pieces = rows.filter(F.length(text) > 0).select(F.explode(_pieces(text)).alias("piece"))
    counted = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    top = counted.orderBy(F.desc("n"), "piece").limit(FREQUENT).collect()
    return [r["piece"] for r in reversed(top)]


def _by_rarity(pieces: Column, frequent: list[str]) -> Column:
    order = F.array(*map(F.lit, frequent)).cast("array<string>")
    placed = F.transform(pieces, lambda p: F.struct(F.array_position(order, p).alias("at"), p.alias("p")))
    return F.transform(F.array_sort(placed), lambda x: x["p"])


def _near_keys(ordered: Column, edits: Column) -> Column:
    """Keys of which any two texts share one, if at most ``edits`` of both apart, from
    pieces with the rare ones in front. The key of texts with too few pieces is empty."""
    few = F.when(F.size(ordered).between(1, 2 * edits), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.slice(ordered, F.lit(1), 2 * edits + 1), few)


def _without_two(text: str) -> Column:
    """The text without any two of its characters, any one, and whole."""
    cut = lambda t: F.transform(
        F.sequence(F.lit(0), F.length(t)),
        lambda i: F.concat(F.substring(t, F.lit(1), F.greatest(i - 1, F.lit(0))), F.substring(t, i + 1, F.length(t))),
    )
    return F.array_distinct(F.flatten(F.transform(cut(F.col(text)), cut)))


def _hashes(label: str, values: Column, *names: str) -> Column:
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    hashed = F.transform(values, lambda v: F.xxhash64(F.lit(label), *names, v))
    return F.when(known, hashed).otherwise(F.array().cast("array<bigint>"))


# ---- names -------------------------------------------------------------------


def _name_keys(inner: str, outer: str) -> Column:
    """Keys that two names share if equal, within two edits, one inside the other (the inner
    one's rarest piece is in the outer one), or nicknames before one last name."""
    name, ordered = F.col("name"), F.col("ordered")
    few = F.size(ordered) <= 2 * S.NAME_EDITS
    short = F.length("name") <= SHORT_NAME
    none = F.array().cast("array<string>")
    single = F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda i: F.substring(name, i, F.lit(1)))
    inside = F.array_distinct(F.concat(ordered, single))
    return F.concat(
        _hashes("equal", F.array(name)),
        _hashes("near", F.slice(ordered, 1, 2 * S.NAME_EDITS + 1)),
        _hashes("short", F.when(few & short, _without_two("name")).otherwise(none)),
        _hashes("few", F.when(few & (F.length("name") > SHORT_NAME - S.NAME_EDITS), F.array(F.lit(""))).otherwise(none)),
        _hashes(inner, F.slice(ordered, 1, 1)),
        _hashes(outer, F.when(F.length("name") > 1, inside).otherwise(none)),
        _hashes("nickname", F.array(F.col("first_full")), "last_name"),
    )


def near_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """``in_name, gold_name, name_score, phonetic_score`` of all pairs of names that agree in
    part. Names are few against contacts, so they are compared once per pair of names."""
    frequent = frequent_pieces(right, "name")

    def side(rows: DataFrame, own: str, inner: str, outer: str) -> DataFrame:
        names = rows.select("name").distinct().withColumns(name_parts()).withColumns(_name_signals())
        names = names.withColumn("ordered", _by_rarity(_pieces("name"), frequent))
        keys = F.array_distinct(_name_keys(inner, outer))
        return durable(names.select(F.col("name").alias(own), F.explode(keys).alias("key")), "name-keys")

    pairs = salted_join(side(left, "in_name", "a", "b"), side(right, "gold_name", "b", "a"), "key", "in_name", "gold_name")
    pairs = pairs.select("in_name", "gold_name").distinct()
    for prefix in ("in_", "gold_"):
        pairs = pairs.withColumns(name_parts(f"{prefix}name", prefix)).withColumns(_name_signals(prefix))
    scores = pair_scores()
    found = pairs.select("in_name", "gold_name", *(scores[n].alias(n) for n in ("name_score", "phonetic_score")))
    return durable(found, "name-pairs").filter("name_score > 0")


# ---- pairs -------------------------------------------------------------------


def with_blocks(profile_rows: DataFrame, frequent: list[str]) -> DataFrame:
    """Add ``blocks``: hashes of which two profiles with unlike names share one if their
    score may reach the limit. By the weights such a pair has one phone and either two
    e-mails or one sound; or both sounds and e-mails an eighth apart at most. (By ``gmail``
    rule also: both sounds and one e-mail but for dots.)"""
    length = F.length("email")
    rows = profile_rows.withColumn("ordered", _by_rarity(_pieces("email"), frequent))
    none = F.array().cast("array<string>")
    mail = F.when(F.col("email_key").isNotNull(), F.array(F.col("email_key"))).otherwise(none)
    # e-mails within an eighth of the longer are within a seventh of either
    eighth = _near_keys(F.col("ordered"), F.floor(F.coalesce(length, F.lit(0)) / 7).cast("int"))
    blank = F.array(F.lit(""))
    found = F.concat(
        _hashes("phone first", blank, "phone_key", "first_sound"),
        _hashes("phone last", blank, "phone_key", "last_sound"),
        _hashes("phone e-mails", F.when(F.col("email_key").isNotNull(), blank).otherwise(none), "phone_key"),
        _hashes("sounds e-mail", mail, "first_sound", "last_sound"),
        _hashes("sounds near", eighth, "first_sound", "last_sound"),
    )
    # four bytes do: hashes that clash bring pairs together whose score is then too low
    short = F.transform(found, lambda h: F.hash(h))
    return rows.withColumn("blocks", F.array_distinct(short)).drop("ordered")


def match_members(contacts: DataFrame, row_id: str) -> DataFrame:
    """``row_id, representative``: copies of a contact are matched once, by the smallest id
    among them; this table gives back all others."""
    rows = with_profile(contacts).select(row_id, "profile")
    first = rows.groupBy("profile").agg(F.min(row_id).alias("representative"))
    return join_unique(rows, first, "profile", bound=contacts).select(row_id, "representative")


SCORES = ("email_score", "name_score", "phone_score", "phonetic_score")


def scored_pairs(incoming: DataFrame, golden: DataFrame) -> DataFrame:
    """All pairs of profiles whose score reaches ``POSSIBLE_AT``: ids, numbers of copies,
    scores and rules.

    A pair whose names agree in part is found through its pair of names, any other one
    through a block. Names, blocks and pairs of names that very many rows share are split
    between tasks. Every pair is scored once, where it is found: pairs are many times the
    contacts, and no table of them is exchanged or stored.
    """
    return placed_pairs(incoming, golden)[0]


def placed_pairs(incoming: DataFrame, golden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``scored_pairs`` with ``gold_place``, the place of ``national_id`` in their order, and
    the table ``gold_place, national_id``."""
    left = durable(spread(profiles(incoming, "incoming_id"), "incoming_id"), "profiles")
    right = durable(_with_place(profiles(golden, "national_id"), "national_id"), "profiles")
    ids = ("incoming_id", "national_id")
    found = _unlike_names(left, right, *ids).unionByName(_like_names(left, right, *ids))
    return found, right.select(F.col("place").alias("gold_place"), "national_id")


def _with_place(rows: DataFrame, row_id: str) -> DataFrame:
    """Add ``place``, a number below ``PLACES`` that grows with ``row_id``: ten bits of the
    partition's number, 33 bits within it."""
    n = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 10)
    return rows.repartitionByRange(n, row_id).sortWithinPartitions(row_id).withColumn(
        "place", F.monotonically_increasing_id()
    )


def _side(rows: DataFrame, row_id: str, prefix: str, *columns: str) -> DataFrame:
    return rows.select(row_id, *(F.col(c).alias(f"{prefix}_{c}") for c in columns))


_FOUND = ("gold_place", "in_copies", "gold_copies", "email_score", "name_score", "phone_score", "phonetic_score")


def _unlike_names(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Pairs of a block. One that shares several blocks counts in the least of them, which
    both rows tell, so pairs need not meet again to be told apart."""
    frequent = frequent_pieces(right, "email")

    def blocks(rows: DataFrame, row_id: str, prefix: str, *more: str) -> DataFrame:
        keyed = durable(with_blocks(rows, frequent), "blocks")
        side = _side(keyed, row_id, prefix, "copies", "blocks", *COMPARED, *more)
        return side.withColumn("block", F.explode(f"{prefix}_blocks"))

    pairs = salted_join(
        blocks(left, left_id, "in"), blocks(right, right_id, "gold", "place"), "block", left_id, right_id
    )
    once = F.array_min(F.array_intersect("in_blocks", "gold_blocks")) == F.col("block")
    scores = pair_scores()
    name = scores.pop("name_score")
    # few pairs reach the limit without their names, so the costly conditions come after it
    reached = (_total(F.lit(0.0)) >= S.POSSIBLE_AT) & (name == 0) & once
    found = pairs.withColumns(scores).filter(reached).withColumn("name_score", F.lit(0.0))
    return _with_total(found.select(left_id, right_id, *_FOUND))


def _like_names(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    names = near_names(left, right)
    compared = ("copies", "name", "email", "email_key", "phone", "phone_key")
    mine = salted_join(_side(left, left_id, "in", *compared), names, "in_name", left_id, "gold_name")
    mine = durable(spread(mine.drop("in_name"), left_id, "gold_name"), "named")
    golden = _side(right, right_id, "gold", *compared, "place")
    pairs = salted_join(mine, golden, "gold_name", left_id, right_id)
    own = pair_scores()
    scored = pairs.withColumns({n: own[n] for n in ("email_score", "phone_score")})
    found = scored.filter(_total() >= S.POSSIBLE_AT)
    return _with_total(found.select(left_id, right_id, *_FOUND))


def match_candidates(incoming: DataFrame, golden: DataFrame) -> DataFrame:
    """The pairs of profiles that are no certain mismatch, with their numbers of copies."""
    return scored_pairs(incoming, golden).select("incoming_id", "national_id", "in_copies", "gold_copies")


def pair_scores(a: str = "in", b: str = "gold") -> dict[str, Column]:
    def both(field: str) -> tuple[Column, Column]:
        return F.col(f"{a}_{field}"), F.col(f"{b}_{field}")

    nickname = S.nickname_score(*both("first_name"), *both("first_full"))
    same_last = F.col(f"{a}_last_name") == F.col(f"{b}_last_name")
    return {
        "email_score": S.email_score(*both("email"), *both("email_key")),
        "name_score": F.greatest(
            S.name_score(*both("name")), F.when(same_last, nickname).otherwise(0.0)
        ),
        "phone_score": S.keyed_phone_score(*both("phone"), *both("phone_key")),
        "phonetic_score": S.sound_score(*both("first_sound"), *both("last_sound")),
    }


def match_score(pairs: DataFrame) -> DataFrame:
    """Weighted score of each given pair of profiles and the rules that contributed."""
    return _with_total(pairs.withColumns(pair_scores()))


def _total(name: Column | None = None) -> Column:
    total = (
        S.WEIGHT_EMAIL * F.col("email_score")
        + S.WEIGHT_NAME * (F.col("name_score") if name is None else name)
        + S.WEIGHT_PHONE * F.col("phone_score")
        + S.WEIGHT_PHONETIC * F.col("phonetic_score")
    )
    return F.round(total, 6)


def _with_total(scored: DataFrame) -> DataFrame:
    rules = F.concat_ws(
        ",",
        *(
            F.when(F.col(f"{r}_score") > 0, F.lit(r.upper()))
            for r in ("email", "name", "phone", "phonetic")
        ),
    )
    return scored.withColumns({"score": _total(), "matched_rules": rules})


def match_class(score: Column) -> Column:
    return (
        F.when(score >= S.DUPLICATE_AT, "DUPLICATE")
        .when(score >= S.POSSIBLE_AT, "POSSIBLE_DUPLICATE")
        .otherwise("NO_MATCH")
    )


def match_classify(scored: DataFrame) -> DataFrame:
    return scored.withColumn("match_type", match_class(F.col("score")))


def best_match(incoming: DataFrame, scored: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The best golden record for every incoming contact; NO_MATCH, with a score of 0, when
    none reaches ``POSSIBLE_AT``. Ties go to the smallest id; pairs are reduced by a partial maximum.

    With the ``places`` of golden ids (see ``placed_pairs``) a pair is one number, of which
    the least is kept by hashing; without, pairs are sorted first, which takes disk.
    """
    of = F.col("incoming_id").alias("representative")
    if places is None:
        order = F.struct(-F.col("score"), F.col("national_id"))
        best = scored.groupBy(of).agg(F.min_by(F.struct("national_id", "score"), order).alias("best"))
        best = best.select("representative", "best.*")
    else:
        missing = F.lit(MILLION) - F.round(F.col("score") * MILLION).cast("long")
        least = scored.groupBy(of).agg(F.min(missing * PLACES + F.col("gold_place")).alias("least"))
        score = (F.lit(MILLION) - F.floor(F.shiftright("least", 43))) / F.lit(float(MILLION))
        least = least.select("representative", F.col("least").bitwiseAND(PLACES - 1).alias("gold_place"), score.alias("score"))
        best = join_unique(least, places, "gold_place", bound=incoming).drop("gold_place")
    members = match_members(incoming, "incoming_id")
    joined = join_unique(members, best, "representative", how="left", bound=incoming)
    score = F.coalesce("score", F.lit(0.0))
    return joined.select(
        "incoming_id",
        F.when(score >= S.POSSIBLE_AT, F.col("national_id")).alias("national_id"),
        score.alias("score"),
        match_class(score).alias("match_type"),
    )


def review_queue(scored: DataFrame) -> DataFrame:
    """Pairs a person should look at, strongest first."""
    return (
        match_classify(scored)
        .filter(F.col("match_type") == "POSSIBLE_DUPLICATE")
        .select("incoming_id", "national_id", "score", "matched_rules")
        .orderBy(F.desc("score"), "incoming_id", "national_id")
    )
