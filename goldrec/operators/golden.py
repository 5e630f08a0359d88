"""The golden record: every customer's events, in order, folded into one row.

What the record holds before an event is a window over earlier events, not a
loop: the previous source and time are neighbours, a kept value is the last one
that won or else the first one seen. Only the capped phone list needs a true
fold, and that runs over phones alone, inside one array expression.

A customer with too many events for one task is cut into ordered chunks. The
same expressions run per chunk, seeded with what earlier chunks hand over.
``seed_*`` columns are the record before the first event of a group; an
existing golden snapshot seeds a new batch in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldrec.config import STRATEGIES, FieldRule, MasteringConfig
from goldrec.functions.phones import merge_phones, parse_phones, serialize_phones, some
from goldrec.functions.text import is_blank, mask_national_id, norm_national_id
from goldrec.operators import conflict
from goldrec.plans.chunks import assign_chunks, carried
from goldrec.plans.durable import durable
from goldrec.plans.skew import HotKeys, find_hot_keys, hot_rows

KEY = "national_id"
ORDER = ("event_ts", "event_id")
SCALARS = ("name", "email")
TRACE_ROWS = 100_000
BLOCK = 512

GOLDEN_COLUMNS = (
    "id",
    KEY,
    "name",
    "email",
    "phones",
    "confidence_score",
    "version",
    "created_at",
    "updated_at",
    "last_source_system",
)


def no_phones() -> Column:
    return F.array().cast("array<string>")


def golden_id(national_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("golden|"), national_id), 256)


# ---- inputs ---------------------------------------------------------------


def prepare(events: DataFrame) -> DataFrame:
    """Events with a cleaned key and a phone list, reduced to the columns the fold uses."""
    rows = events.filter(~is_blank(F.col(KEY))).withColumn(KEY, norm_national_id(F.col(KEY)))
    columns = [KEY, *ORDER, *SCALARS, "source_system"]
    if "processed_at" in rows.columns:
        columns.append("processed_at")
    return rows.select(*columns, parse_phones(F.col("phone")).alias("phones"))


def _seeded(rows: DataFrame, golden: DataFrame | None, hot: HotKeys | None = None) -> DataFrame:
    """Add the ``seed_*`` columns: the customer's golden row, or an empty record.
    Rows of hot customers get their one golden row by broadcast."""
    if golden is None:
        stamp = dict(rows.dtypes)["event_ts"]
        return rows.select(
            "*",
            F.lit(0).cast("bigint").alias("seed_version"),
            *(F.lit(None).cast(stamp).alias(c) for c in ("seed_created", "seed_ts")),
            *(F.lit(None).cast("string").alias(f"seed_{c}") for c in ("source", *SCALARS)),
            no_phones().alias("seed_phones"),
        )
    seeds = golden.select(
        KEY,
        F.col("version").alias("seed_version"),
        F.col("created_at").alias("seed_created"),
        F.col("updated_at").alias("seed_ts"),
        F.col("last_source_system").alias("seed_source"),
        *(F.col(c).alias(f"seed_{c}") for c in SCALARS),
        F.col("phones").alias("seed_phones"),
    )
    if hot is not None:
        seeds = hot.small(hot.hot(seeds))
    return rows.join(seeds, KEY, "left").withColumns(
        {
            "seed_version": F.coalesce("seed_version", F.lit(0)),
            "seed_phones": F.coalesce("seed_phones", no_phones()),
        }
    )


# ---- the expressions shared by every plan ---------------------------------


def _with_previous(rows: DataFrame, part: list[str], cfg: MasteringConfig) -> DataFrame:
    """Add ``rn, prev_source, prev_ts`` and one ``wins_<field>`` flag per field."""
    w = W.partitionBy(*part).orderBy(*ORDER)
    if cfg.clock == "event":
        clock = F.greatest(F.lag("event_ts").over(w), F.col("seed_ts"))
    else:
        clock = F.lag("processed_at").over(w)
    first = F.col("rn") == 1
    rows = rows.withColumns(
        {"rn": F.row_number().over(w), "_src": F.lag("source_system").over(w), "_ts": clock}
    ).withColumns(
        {
            "prev_source": F.when(first, F.col("seed_source")).otherwise(F.col("_src")),
            "prev_ts": F.when(first, F.col("seed_ts")).otherwise(F.col("_ts")),
        }
    )
    for f in _vouched_fields(cfg):
        if f"seed_vouched_{f}" not in rows.columns:
            rows = rows.withColumn(f"seed_vouched_{f}", _seed_vouched(f, cfg))
    return rows.withColumns(
        {f"wins_{f}": _wins(f, part, cfg) for f in _chosen_fields(cfg)}
    ).drop("_src", "_ts")


def _vouched_fields(cfg: MasteringConfig) -> list[str]:
    """Fields whose kept value is followed to the source that gave it."""
    if cfg.provenance == "record":
        return []
    rules = {f: cfg.rule(f) for f in _chosen_fields(cfg)}
    return [f for f, r in rules.items() if r.strategy == "TRUSTED_SOURCE" and r.trusted]


def _seed_vouched(field: str, cfg: MasteringConfig) -> Column:
    """A snapshot names its last source only, so that one stands for the field's."""
    trusted = F.coalesce(F.col("seed_source").isin(*cfg.rule(field).trusted), F.lit(False))
    return trusted & _seed(field).isNotNull()


def _vouching(field: str, cfg: MasteringConfig) -> Column:
    """The event is a trusted source's value for the field."""
    return conflict.is_trusted_event(cfg.rule(field)) & _value(field).isNotNull()


def _chosen_fields(cfg: MasteringConfig) -> list[str]:
    merged = cfg.rule("phone").strategy == "MERGE"
    return [*SCALARS] if merged else [*SCALARS, "phone"]


def _value(field: str) -> Column:
    return some(F.col("phones")) if field == "phone" else F.col(field)


def _seed(field: str) -> Column:
    return some(F.col("seed_phones")) if field == "phone" else F.col(f"seed_{field}")


def _wins(field: str, part: list[str], cfg: MasteringConfig) -> Column:
    if field not in _vouched_fields(cfg):
        return conflict.incoming_wins(cfg.rule(field))
    # A trusted source gave or confirmed the kept value once any trusted value was
    # seen: it wins over an untrusted one, equals it, or loses to a trusted one.
    trusted = _vouching(field, cfg)
    before = W.partitionBy(*part).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.max(trusted).over(before), F.lit(False))
    kept_trusted = seen | F.col(f"seed_vouched_{field}")
    return F.when(trusted == kept_trusted, conflict.is_later()).otherwise(trusted)


def _won(field: str) -> Column:
    """The value where it wins, else null."""
    return F.when(F.col(f"wins_{field}"), _value(field))


def _fold_phones(events: Column, start: Column, rule: FieldRule) -> Column:
    return F.aggregate(events, start, lambda kept, e: merge_phones(kept, e["phones"], rule))


def _ordered(*columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*ORDER, *columns)))


# ---- golden rows ----------------------------------------------------------


def golden_record(
    events: DataFrame,
    cfg: MasteringConfig = MasteringConfig(),
    golden: DataFrame | None = None,
    sizes: DataFrame | None = None,
    bound: DataFrame | None = None,
) -> DataFrame:
    """One row per customer in ``events``. ``golden`` seeds the fold. ``sizes``
    may be any cheaper table with at least these rows, used to look for hot
    customers; it defaults to ``events``. ``bound``: see ``find_hot_keys``."""
    rows = prepare(events)
    hot = _hot_customers(rows, sizes, bound)
    if hot is None:
        return _golden_cold(_seeded(rows, golden), cfg)
    cold_part = _golden_cold(_seeded(hot.cold(rows), golden), cfg)
    hot_part = _golden_hot(_seeded(hot.hot(rows), golden, hot), hot, cfg)
    return cold_part.unionByName(hot_part)


def _hot_customers(
    rows: DataFrame,
    sizes: DataFrame | None = None,
    bound: DataFrame | None = None,
    limit: int | None = None,
) -> HotKeys | None:
    if sizes is not None:
        named = sizes.filter(~is_blank(F.col(KEY)))
        rows = named.select(norm_national_id(F.col(KEY)).alias(KEY))
    return find_hot_keys(rows, KEY, limit=limit, bound=bound)


def _scalar_aggregates(cfg: MasteringConfig) -> list[Column]:
    """Aggregates with partial (map-side) results: no group is ever collected."""
    order = F.struct(*ORDER)
    out = [
        F.count(F.lit(1)).alias("n"),
        F.min("event_ts").alias("first_ts"),
        F.max_by("source_system", order).alias("last_source_system"),
    ]
    if cfg.clock == "event":
        out.append(F.max("event_ts").alias("last_ts"))
    else:
        out.append(F.max_by("processed_at", order).alias("last_ts"))
    for f in _chosen_fields(cfg):
        value, won = _value(f), F.col(f"wins_{f}")
        out.append(
            F.max_by(value, F.when(won & value.isNotNull(), order)).alias(f"won_{f}")
        )
        out.append(F.min_by(value, F.when(value.isNotNull(), order)).alias(f"first_{f}"))
    seeds = ("version", "created", "ts", *SCALARS, "phones")
    return [*out, *(F.first(f"seed_{c}").alias(f"seed_{c}") for c in seeds)]


def _finish(grouped: DataFrame, phones: Column, cfg: MasteringConfig) -> DataFrame:
    """Golden columns from the aggregates of one customer."""

    def kept(field: str) -> Column:
        return F.coalesce(f"won_{field}", _seed(field), f"first_{field}")

    last_ts = F.col("last_ts")
    if cfg.clock == "event":
        last_ts = F.greatest(last_ts, F.col("seed_ts"))
    if "phone" in _chosen_fields(cfg):
        phones = F.coalesce(kept("phone"), no_phones())
    return grouped.select(
        golden_id(F.col(KEY)).alias("id"),
        KEY,
        kept("name").alias("name"),
        kept("email").alias("email"),
        phones.alias("phones"),
        F.lit(100).cast("smallint").alias("confidence_score"),
        (F.col("seed_version") + F.col("n")).alias("version"),
        F.coalesce("seed_created", "first_ts").alias("created_at"),
        last_ts.alias("updated_at"),
        "last_source_system",
    )


def _golden_cold(rows: DataFrame, cfg: MasteringConfig) -> DataFrame:
    """Window and aggregate share one shuffle by customer."""
    rows = _with_previous(rows, [KEY], cfg)
    rule = cfg.rule("phone")
    if rule.strategy != "MERGE":
        return _finish(rows.groupBy(KEY).agg(*_scalar_aggregates(cfg)), no_phones(), cfg)
    step = F.when(_moves_phones(rule, [KEY]), F.struct(*ORDER, "phones"))
    grouped = (
        rows.withColumn("step", step)
        .groupBy(KEY)
        .agg(*_scalar_aggregates(cfg), F.array_sort(F.collect_list("step")).alias("steps"))
    )
    return _finish(grouped, _fold_phones(F.col("steps"), F.col("seed_phones"), rule), cfg)


def _moves_phones(rule: FieldRule, part: list[str]) -> Column:
    """False for events that cannot change the list: no phone, or the same single
    phone as the two events with phones before it. One repeat may still count: the
    first event cuts a list over the cap, and may cut the very phone it brings; the
    second one brings it back, and from then on the list holds it within the cap."""
    phones = F.col("phones")
    if rule.merge_type != "UNION":
        return F.size(phones) > 0
    window = f"over (partition by {', '.join(part)} order by {', '.join(ORDER)})"
    given = "case when size(phones) > 0 then phones end"
    last, before = (F.expr(f"lag({given}, {n}) ignore nulls {window}") for n in (1, 2))
    repeat = (F.size(phones) == 1) & (phones == last) & (phones == before)
    return (F.size(phones) > 0) & ~F.coalesce(repeat, F.lit(False))


def pre_rules(trace: DataFrame) -> DataFrame:
    """How many times each field met each case before a rule was needed."""
    cases = []
    for f, column in (("name", "name"), ("email", "email"), ("phone", "phones")):
        before, value = F.col(f"{column}_before"), F.col(column)
        if f == "phone":
            before, value = some(before), some(value)
        case = (
            F.when(before.isNull() & value.isNull(), "BOTH_NULL")
            .when(before.isNull(), "CURRENT_NULL")
            .when(value.isNull(), "INCOMING_NULL")
            .when(before == value, "EQUAL")
            .otherwise("CONFLICT")
        )
        cases.append(F.struct(F.lit(f).alias("field_name"), case.alias("outcome")))
    rows = trace.select(F.inline(F.array(*cases)))
    return rows.groupBy("field_name", "outcome").agg(F.count(F.lit(1)).alias("n"))


# ---- the trace: record state around every event ---------------------------


def golden_trace(
    events: DataFrame,
    cfg: MasteringConfig = MasteringConfig(),
    golden: DataFrame | None = None,
    sizes: DataFrame | None = None,
    bound: DataFrame | None = None,
) -> DataFrame:
    """One row per event: the record before and after it, CREATED or UPDATED, and
    the version."""
    rows = prepare(events)
    limit = min(TRACE_ROWS, hot_rows(rows.sparkSession))
    hot = _hot_customers(rows, sizes, bound, limit)
    if hot is None:
        return _trace_group(_seeded(rows, golden), [KEY], cfg)
    cold_part = _trace_group(_seeded(hot.cold(rows), golden), [KEY], cfg)
    hot_part = _trace_hot(_seeded(hot.hot(rows), golden, hot), hot, cfg)
    return cold_part.unionByName(hot_part)


def _trace_group(rows: DataFrame, part: list[str], cfg: MasteringConfig) -> DataFrame:
    """The trace of groups that fit one task, seeded by their ``seed_*`` columns."""
    rows = _with_previous(rows, part, cfg)
    w = W.partitionBy(*part).orderBy(*ORDER)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    before = w.rowsBetween(W.unboundedPreceding, -1)

    def kept(field: str, frame: WindowSpec) -> Column:
        return F.coalesce(
            F.last(_won(field), ignorenulls=True).over(frame),
            _seed(field),
            F.first(_value(field), ignorenulls=True).over(frame),
        )

    states = {}
    for f in _chosen_fields(cfg):
        states[f"{f}_before"], states[f"{f}_after"] = kept(f, before), kept(f, upto)
    rows = rows.withColumns(
        {
            **states,
            "version": F.col("seed_version") + F.col("rn"),
            "created_at": F.coalesce("seed_created", F.first("event_ts").over(upto)),
            "updated_at": F.greatest("event_ts", "prev_ts")
            if cfg.clock == "event"
            else F.col("processed_at"),
        }
    ).withColumn("action", F.when(F.col("version") == 1, "CREATED").otherwise("UPDATED"))
    if "phone_before" in states:
        rows = rows.withColumns(
            {
                "phones_before": F.coalesce("phone_before", no_phones()),
                "phones_after": F.coalesce("phone_after", no_phones()),
            }
        )
    else:
        rows = _with_phone_states(rows, part, cfg.rule("phone"))
    return rows.select(*TRACE_COLUMNS)


TRACE_COLUMNS = (
    KEY,
    *ORDER,
    "source_system",
    "name",
    "email",
    "phones",
    "prev_source",
    "prev_ts",
    "name_before",
    "name_after",
    "email_before",
    "email_after",
    "phones_before",
    "phones_after",
    "version",
    "created_at",
    "updated_at",
    "action",
)


def _with_phone_states(rows: DataFrame, part: list[str], rule: FieldRule) -> DataFrame:
    """Add ``phones_before, phones_after`` to every row of a group.

    The ordered group is cut into blocks; one pass finds the list at the start of
    each block, a second one walks each block. Keeping the blocks short keeps the
    growing result arrays short.
    """
    payload = [c for c in rows.columns if c not in ORDER and c not in part]
    grouped = rows.groupBy(*part).agg(
        _ordered(*payload).alias("evs"), F.first("seed_phones").alias("start")
    )
    evs = F.col("evs")

    def block(i: Column) -> Column:
        return F.slice(evs, i * BLOCK + 1, BLOCK)

    numbers = F.sequence(F.lit(0), F.floor((F.size(evs) - 1) / F.lit(BLOCK)).cast("int"))
    starts = F.aggregate(
        numbers,
        F.array("start"),
        lambda acc, i: F.concat(acc, F.array(_fold_phones(block(i), F.element_at(acc, -1), rule))),
    )
    blocks = F.transform(
        numbers, lambda i: F.struct(block(i).alias("evs"), F.get(F.col("starts"), i).alias("start"))
    )
    grouped = grouped.withColumn("starts", starts).select(*part, F.inline(blocks))

    empty = F.slice(
        F.transform(
            evs, lambda e: F.struct(e.alias("e"), F.col("start").alias("b"), F.col("start").alias("a"))
        ),
        1,
        0,
    )

    def walk(acc: Column, e: Column) -> Column:
        after = merge_phones(acc["state"], e["phones"], rule)
        row = F.struct(e.alias("e"), acc["state"].alias("b"), after.alias("a"))
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(row)).alias("out"))

    walked = F.aggregate(
        evs, F.struct(F.col("start").alias("state"), empty.alias("out")), walk, lambda acc: acc["out"]
    )
    return grouped.select(*part, F.inline(walked)).select(
        *part, "e.*", F.col("b").alias("phones_before"), F.col("a").alias("phones_after")
    )


# ---- hot customers --------------------------------------------------------


def _chunked(rows: DataFrame, hot: HotKeys, cfg: MasteringConfig) -> tuple[DataFrame, DataFrame]:
    """Rows of hot customers with ``chunk`` and the previous source and time handed
    over from earlier chunks; also one row per chunk."""
    clock = "event_ts" if cfg.clock == "event" else "processed_at"
    rows = durable(assign_chunks(rows, hot, "event_ts", then="event_id"))
    order = F.struct(*ORDER)
    vouched = _vouched_fields(cfg)
    chunks = rows.groupBy(KEY, "chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_ts").alias("first_ts"),
        F.max_by("source_system", order).alias("source"),
        F.max_by(clock, order).alias("ts"),
        *(F.max(_vouching(f, cfg)).alias(f"vouched_{f}") for f in vouched),
    )
    handed = carried(
        chunks,
        [KEY],
        c_n=F.sum("n"),
        c_created=F.min("first_ts"),
        c_source=F.last("source"),
        c_ts=F.last("ts"),
        **{f"c_vouched_{f}": F.max(f"vouched_{f}") for f in vouched},
    )
    later = F.col("chunk") > 0
    ts = F.greatest("c_ts", "seed_ts") if cfg.clock == "event" else F.col("c_ts")
    rows = rows.join(handed, [KEY, "chunk"])
    for f in vouched:
        earlier = F.coalesce(f"c_vouched_{f}", F.lit(False))
        rows = rows.withColumn(f"seed_vouched_{f}", _seed_vouched(f, cfg) | earlier)
    rows = rows.withColumns(
        {
            "seed_source": F.when(later, F.col("c_source")).otherwise(F.col("seed_source")),
            "seed_ts": F.when(later, ts).otherwise(F.col("seed_ts")),
        }
    )
    return rows, chunks.select(KEY, "chunk")


def _phone_chunks(rows: DataFrame, rule: FieldRule) -> DataFrame:
    """``(key, chunk, start, end)``: the phone list around each chunk with phones.

    A customer with no more phones than the cap never loses one, so its starts are
    known (``_uncut_starts``). Other chunks guess theirs from the chunk before them
    alone. All chunks fold at once, and only chunks whose start differs from what
    their predecessor really ends with are folded again. A list that is cut forgets
    its start quickly, so a few rounds do it.
    """
    part = [KEY, "chunk"]
    steps = F.when(_moves_phones(rule, part), F.struct(*ORDER, "phones"))
    blocks = durable(
        rows.withColumn("step", steps)
        .groupBy(*part)
        .agg(F.array_sort(F.collect_list("step")).alias("steps"), F.first("seed_phones").alias("base"))
        .filter(F.size("steps") > 0)
    )
    by_chunk = W.partitionBy(KEY).orderBy("chunk")

    def fold(starts: DataFrame) -> DataFrame:
        return (
            blocks.join(starts, part)
            .withColumn("end", _fold_phones(F.col("steps"), F.col("start"), rule))
            .select(*part, "base", "start", "end")
        )

    def handed_on(done: DataFrame) -> DataFrame:
        return done.withColumn("want", F.coalesce(F.lag("end").over(by_chunk), F.col("base")))

    alone = fold(blocks.select(*part, F.col("base").alias("start")))
    starts = handed_on(alone).select(*part, F.col("want").alias("start"))
    if rule.merge_type == "UNION":
        known = _uncut_starts(blocks, rule)
        starts = starts.join(known, part, "left").select(*part, F.coalesce("known", "start").alias("start"))
    state = durable(fold(starts))
    while True:
        checked = handed_on(state)
        wrong = checked.filter(F.col("want") != F.col("start"))
        if wrong.isEmpty():
            return state
        settled = checked.filter(F.col("want") == F.col("start")).drop("want")
        again = fold(wrong.select(*part, F.col("want").alias("start")))
        state = durable(settled.unionByName(again))


def _uncut_starts(blocks: DataFrame, rule: FieldRule) -> DataFrame:
    """``(key, chunk, known)`` for customers with no more distinct phones than the cap:
    the list at a chunk is the base and then the phones met before, by first appearance."""
    steps = blocks.select(KEY, "chunk", "base", F.explode("steps").alias("s"))
    seen = steps.select(KEY, "chunk", "base", *(f"s.{c}" for c in ORDER), F.posexplode("s.phones").alias("pos", "phone"))
    firsts = (
        seen.filter(~F.array_contains("base", F.col("phone")))
        .groupBy(KEY, "phone")
        .agg(F.min(F.struct(*ORDER, "pos", "chunk")).alias("at"), F.first("base").alias("base"))
    )
    few = firsts.groupBy(KEY).agg((F.count(F.lit(1)) + F.size(F.first("base"))).alias("n"))
    few = few.filter(F.col("n") <= rule.max_values).select(KEY)
    # at most as many phones a customer as the cap
    lists = firsts.join(few, KEY, "left_semi").groupBy(KEY)
    lists = lists.agg(F.array_sort(F.collect_list(F.struct("at", "phone"))).alias("met"))
    before = F.filter("met", lambda m: m["at"]["chunk"] < F.col("chunk"))
    known = F.concat("base", F.transform(before, lambda m: m["phone"]))
    return blocks.select(KEY, "chunk", "base").join(lists, KEY).select(KEY, "chunk", known.alias("known"))


def _golden_hot(rows: DataFrame, hot: HotKeys, cfg: MasteringConfig) -> DataFrame:
    rows, _ = _chunked(rows, hot, cfg)
    ruled = _with_previous(rows, [KEY, "chunk"], cfg)
    # Of the seeds only seed_ts differs between chunks, and any of its values gives
    # the same latest time.
    totals = ruled.groupBy(KEY).agg(*_scalar_aggregates(cfg))
    rule = cfg.rule("phone")
    if rule.strategy != "MERGE":
        return _finish(totals, no_phones(), cfg)
    ends = _phone_chunks(rows, rule).groupBy(KEY).agg(F.max_by("end", "chunk").alias("end"))
    totals = totals.join(ends, KEY, "left")
    return _finish(totals, F.coalesce("end", "seed_phones"), cfg)


def _trace_hot(rows: DataFrame, hot: HotKeys, cfg: MasteringConfig) -> DataFrame:
    part = [KEY, "chunk"]
    rows, chunks = _chunked(rows, hot, cfg)
    ruled = _with_previous(rows, part, cfg)
    order = F.struct(*ORDER)
    fields = _chosen_fields(cfg)
    ends = ruled.groupBy(*part).agg(
        *(F.max_by(_value(f), F.when(_won(f).isNotNull(), order)).alias(f"won_{f}") for f in fields),
        *(F.min_by(_value(f), F.when(_value(f).isNotNull(), order)).alias(f"first_{f}") for f in fields),
    )
    handed = {}
    for f in fields:
        handed[f"c_won_{f}"] = F.last(f"won_{f}", ignorenulls=True)
        handed[f"c_first_{f}"] = F.first(f"first_{f}", ignorenulls=True)
    rows = rows.join(carried(ends, [KEY], **handed), part)
    seeds = {
        f"seed_{f}": F.coalesce(f"c_won_{f}", f"seed_{f}", f"c_first_{f}") for f in SCALARS
    }
    rule = cfg.rule("phone")
    if rule.strategy == "MERGE":
        states = chunks.join(_phone_chunks(rows, rule).select(*part, "end"), part, "left")
        starts = carried(states, [KEY], c_phones=F.last("end", ignorenulls=True))
        rows = rows.join(starts, part)
        seeds["seed_phones"] = F.coalesce("c_phones", "seed_phones")
    else:
        seeds["seed_phones"] = F.coalesce(
            "c_won_phone", some(F.col("seed_phones")), "c_first_phone", no_phones()
        )
    seeds["seed_version"] = F.col("seed_version") + F.coalesce("c_n", F.lit(0))
    seeds["seed_created"] = F.coalesce("seed_created", "c_created")
    return _trace_group(rows.withColumns(seeds), part, cfg)


# ---- what the trace feeds -------------------------------------------------


def mastered_events(trace: DataFrame) -> DataFrame:
    """One change event per applied raw event, keyed by golden id."""
    return trace.select(
        F.sha2(F.concat(F.lit("mastered|"), F.col("event_id").cast("string")), 256).alias("event_id"),
        golden_id(F.col(KEY)).alias("golden_record_id"),
        KEY,
        F.col("name_after").alias("name"),
        F.col("email_after").alias("email"),
        serialize_phones(F.col("phones_after")).alias("phone"),
        "action",
        F.col("event_ts").alias("timestamp"),
    )


def golden_from_trace(trace: DataFrame) -> DataFrame:
    """The golden rows a trace ends with; partial aggregation, no second fold."""
    last = F.struct("version", *ORDER)
    picked = {
        "name": "name_after",
        "email": "email_after",
        "phones": "phones_after",
        "created_at": "created_at",
        "updated_at": "updated_at",
        "last_source_system": "source_system",
    }
    rows = trace.groupBy(KEY).agg(
        F.max("version").alias("version"),
        *(F.max_by(column, last).alias(name) for name, column in picked.items()),
    )
    return rows.withColumns(
        {"id": golden_id(F.col(KEY)), "confidence_score": F.lit(100).cast("smallint")}
    ).select(*GOLDEN_COLUMNS)


def golden_upsert(
    golden: DataFrame, events: DataFrame, cfg: MasteringConfig = MasteringConfig()
) -> DataFrame:
    """The snapshot after ``events``: touched customers fold on from their row,
    the others stay as they are."""
    touched = golden_record(events, cfg, golden)
    ids = prepare(events).select(KEY).distinct()
    kept = golden.join(ids, KEY, "left_anti").select(*GOLDEN_COLUMNS)
    return touched.select(*GOLDEN_COLUMNS).unionByName(kept)


def field_conflicts(trace: DataFrame, cfg: MasteringConfig = MasteringConfig()) -> DataFrame:
    """One row per event and field where both sides have a value and differ."""
    parts = []
    for f in ("name", "email", "phone"):
        rule = cfg.rule(f)
        column = "phones" if f == "phone" else f
        before, value, after = F.col(f"{column}_before"), F.col(column), F.col(f"{column}_after")
        if f == "phone":
            differs = (F.size(before) > 0) & (F.size(value) > 0) & (before != value)
            texts = [F.to_json(c) for c in (before, value, after)]
        else:
            differs = before.isNotNull() & value.isNotNull() & (before != value)
            texts = [before, value, after]
        if rule.strategy == "MERGE":
            winner = F.lit("MERGED")
        else:
            winner = F.when(conflict.incoming_wins(rule), "INCOMING").otherwise("CURRENT")
        entry = F.struct(
            F.lit(f).alias("field_name"),
            texts[0].alias("current_value"),
            texts[1].alias("incoming_value"),
            F.lit(rule.strategy).alias("strategy"),
            winner.alias("winner"),
            texts[2].alias("resolved_value"),
            conflict.reason(rule, texts[0], texts[1], F.size("phones_after")).alias("reason"),
        )
        parts.append(F.when(differs, entry))
    entries = F.array_compact(F.array(*parts))
    return trace.select(
        KEY,
        F.col("event_id"),
        F.col("event_ts"),
        F.col("prev_source").alias("current_source"),
        F.col("source_system").alias("incoming_source"),
        F.inline(entries),
    )


def conflict_log(conflicts: DataFrame) -> DataFrame:
    """The structured log: the id is masked, values are shown."""
    return conflicts.select(
        F.col("event_ts").alias("timestamp"),
        mask_national_id(F.col(KEY)).alias("national_id"),
        "field_name",
        "current_value",
        "incoming_value",
        "current_source",
        "incoming_source",
        "strategy",
        "resolved_value",
        "reason",
    )


def conflicts_by_strategy(conflicts: DataFrame) -> DataFrame:
    """Resolved conflicts per strategy, zero included."""
    # ``in`` per strategy keeps one pass and one output row per strategy.
    counts = conflicts.agg(
        *(F.count_if(F.col("strategy") == s).alias(s) for s in STRATEGIES)
    )
    pairs = F.array(*(F.struct(F.lit(s).alias("strategy"), F.col(s).alias("n")) for s in STRATEGIES))
    return counts.select(F.inline(pairs))


def most_frequent(events: DataFrame, field: str) -> DataFrame:
    """The value each customer gave most often, the first seen on a tie."""
    order = F.struct(*ORDER)
    rows = prepare(events).filter(F.col(field).isNotNull())
    counts = rows.groupBy(KEY, field).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    best = F.min_by(field, F.struct(-F.col("n"), F.col("o")))
    return counts.groupBy(KEY).agg(best.alias(field), F.sum("n").alias("seen"))
