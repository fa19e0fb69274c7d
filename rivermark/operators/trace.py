"""Forward traces from many seeds at once.

A state of a trace is the event that brought funds to a wallet, and every event
continues a trace at most once. The arrivals at a wallet, put in order, cut time
into spans, and a running minimum names the arrival that departures within a span
continue. Spans go to the departures, each of which lies in one span of a trace, so
departures are written where they are found and never moved. Where times are unknown or
a wallet is crowded, departures are ordered together with the arrivals instead.

The order in which a first-in-first-out walk would visit states is kept as ``place``, the
rank of a state in its level and trace by its parent's place and its own ``(time, sequence,
reference)``. Only traces that have budget left are ranked, so a queue is short.

The event table is written once in buckets of the sending wallet; a level brings its
wallets to the buckets and never moves the events again. Which events a trace has
claimed is known from the earliest expanded position at each wallet, a table of visited
wallets instead of the events of all earlier levels.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rivermark import scale
from rivermark.functions.predicates import _is, positive, spendable
from rivermark.operators.labels import claims_by_address, resolve
from rivermark.scale import Laid, by_some_keys, cut, dim_join, fits, none_hot, one_cell, passed, running_before, staged, staged_by, with_cells

MAX_HOPS = 8
MAX_EVENTS = 5000
PLACE = ["trace_id", "address"]
WALLET = ["network_key", "token_contract", "address"]
SENDER = ["network_key", "token_contract", "from_address"]
#: What an ending tells of a label.
LABEL = ("entity_name", "entity_type", "assertion_type", "address_role", "review_state", "source_reference")
#: Per trace and wallet: the earliest positions that were expanded.
CLAIMED = ("claimed_since", "timed_seq", "untimed_seq")
#: Where a span begins and ends and from when its departures are claimed: times and sequences.
SPAN = ("lo_t", "lo_q", "hi_t", "hi_q", "since_t", "since_q")
CELL_SECONDS = 3600
#: Departures that a walk follows or reports; the others are only counted, beforehand.
MOVING = "spendable OR unverified"
#: Columns whose values hardly repeat.
LONE = ("event_reference", "chain_sequence", "seq", "tx_hash", "arrival", "arrival_event_reference", "branch_path.list.element")
#: A wallet with more arrivals in a level of one trace has its arrivals and departures sorted together.
CROWD = 1000
# Coverage from best to worst.
COVERAGE = ("complete_within_scope", "partial", "failed")


@dataclass
class Trace:
    """The four tables of a set of traces, keyed by ``trace_id``; endings are put together when they are first read."""

    header: DataFrame
    observed: DataFrame
    ended: Callable[[], DataFrame]
    limitations: DataFrame

    @cached_property
    def endings(self) -> DataFrame:
        return self.ended()


IDENTITY = ["network_key", "event_reference"]
READ = ["token_contract", "from_address", "to_address", "amount_base_units", "block_time", "chain_sequence",
        "ordering_ambiguous", "event_kind", "execution_status", "confirmation_state"]


def _read(transfers: DataFrame, *more: str) -> DataFrame:
    # A table without transaction hashes can be walked too.
    tx = F.col("tx_hash") if "tx_hash" in transfers.columns else F.lit(None).cast("string")
    return transfers.select(*IDENTITY, *READ, tx.alias("tx_hash"), *more)


def _flagged(rows: DataFrame) -> DataFrame:
    # Amounts are looked at last, where the rest leaves a doubt.
    unknown = (
        _is("event_kind", "transfer") & ~_is("execution_status", "failed", "reverted") & ~_is("confirmation_state", "removed")
        & ~(_is("execution_status", "success") & _is("confirmation_state", "confirmed")) & positive()
    )
    return rows.withColumn("spendable", spendable()).withColumn("unverified", unknown)


def _once(rows: DataFrame) -> DataFrame:
    return _flagged(rows.groupBy(*IDENTITY).agg(F.min(F.struct(*READ, "tx_hash")).alias("r")).select(*IDENTITY, "r.*"))


def written(transfers: DataFrame, *more: str, passing: list[Callable] | None = None) -> DataFrame:
    """Events written once as the walk reads them, with the columns ``more`` beside them.

    A caller that reads the events for something else too, such as its seeds, passes the result to ``trace``,
    and ``passing`` with it if nothing reads them after the walk has.
    """
    return staged(_flagged(_read(transfers, *more)), passing, LONE)


def prepare(transfers: DataFrame) -> DataFrame:
    """Slim, identity-unique event table that the walk reads at every level.

    Of unequal rows with one identity the smallest stays, whatever the partitioning.
    """
    return _slim(_once(_read(transfers)))


def prepared(transfers: DataFrame, passing: list[Callable] | None = None) -> DataFrame:
    """``prepare``, written; only rows whose identity may occur twice are moved for it.

    Identities are counted by a hash, so a row that is alone by its hash has no copy.
    """
    known = {"spendable", "unverified"} <= set(transfers.columns)
    rows = transfers.select(*IDENTITY, *READ, "tx_hash", "spendable", "unverified") if known else written(transfers, passing=passing)
    by_hash = F.xxhash64(*IDENTITY).alias("_h")
    twice = cut(rows.groupBy(by_hash).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h"))
    if twice.isEmpty():
        return _slim(rows)
    if not fits(twice):
        return _slim(staged(_once(rows), passing))
    marked, few = rows.select("*", by_hash), F.broadcast(twice)
    alone = marked.join(few, "_h", "left_anti").drop("_h")
    return _slim(staged(alone.unionByName(_once(marked.join(few, "_h", "left_semi").drop("_h"))), passing))


def _slim(once: DataFrame) -> DataFrame:
    return once.select(
        "network_key", "token_contract", "event_reference", "from_address", "to_address",
        "amount_base_units", "block_time",
        F.coalesce("chain_sequence", F.lit("")).alias("seq"),
        (F.col("ordering_ambiguous") | F.col("chain_sequence").isNull()).alias("unordered"),
        "spendable", "unverified", "tx_hash",
    )


def locate_seeds(seeds: DataFrame, edges: DataFrame, cutoff: Column) -> DataFrame:
    """Seeds with their event.

    The event is looked up in the outgoing history of the seed's own address between its
    ``analysis_start`` and the cutoff; anywhere else it is unavailable, and the window is
    never widened.
    """
    found = edges.select(
        "network_key", "token_contract", F.col("event_reference").alias("seed_event_reference"),
        F.struct("event_reference", "from_address", "to_address", "amount_base_units", "block_time",
                 "seq", "spendable", "tx_hash",
                 *[c for c in ("looked", "follow", "service", "conflict", "candidate") if c in edges.columns]).alias("e"),
    )
    # Few seeds are brought to the events; the events are not moved for them. A reference stands
    # for one event, so many seeds meet them in a plain join.
    keys = ["network_key", "token_contract", "seed_event_reference"]
    begin = F.col("analysis_start") if "analysis_start" in seeds.columns else F.lit(None).cast("timestamp")
    wanted = seeds.select("trace_id", *keys, F.col("seed_address").alias("_from"), begin.alias("_start")).filter("seed_event_reference IS NOT NULL")
    hits = dim_join(found, wanted, keys, "inner", []).filter(
        (F.col("e.from_address") == F.col("_from")) & F.coalesce(F.col("e.block_time") <= cutoff, F.lit(True))
        & F.coalesce(F.col("e.block_time") >= F.col("_start"), F.lit(True))
    )
    joined = seeds.join(hits.select("trace_id", "e"), "trace_id", "left")
    return joined.withColumn(
        "state",
        F.when(F.col("seed_event_reference").isNull(), "discovery")
        .when(F.col("e").isNull(), "unavailable")
        .when(F.col("e.spendable"), "followed")
        .otherwise("rejected"),
    )


def _opens() -> Column:
    """Whether an event opens a state at its recipient."""
    whole = F.col("to_address").isNotNull() & F.col("network_key").isNotNull() & F.col("event_reference").isNotNull()
    return F.coalesce(F.col("spendable"), F.lit(False)) & whole


def _opened(edges: DataFrame, folded: DataFrame, few_claims: bool, cutoff: Column, small: bool, untimed: bool) -> DataFrame:
    """Events that open a state, with what awaits it, which is the same for every trace.

    ``looked`` counts the departures a state looks at, ``follow`` those that continue it;
    ``service``, ``conflict`` and ``candidate`` are the recipient's labels at the arrival.
    An arrival carries its event along, so that the events are not joined to the answers.
    """
    beside = ("network_key", "token_contract", "to_address", "block_time", "seq", "spendable")
    arrivals = edges.filter(_opens()).select(
        "network_key", "token_contract", F.col("to_address").alias("address"), F.col("block_time").alias("at"),
        F.col("seq").alias("at_seq"), F.struct(*[c for c in edges.columns if c not in beside]).alias("arrival"),
    )
    leaving = edges.withColumnRenamed("from_address", "address").filter(F.coalesce(F.col("block_time") <= cutoff, F.lit(True)))
    counts = _outlook(arrivals, leaving, WALLET, small, untimed)
    labelled = resolve(counts, folded, "address", F.coalesce("at", cutoff), [] if small else ["arrival.event_reference"], few_claims)
    return labelled.select(
        "network_key", "token_contract", F.col("address").alias("to_address"), F.col("at").alias("block_time"), F.col("at_seq").alias("seq"),
        F.lit(True).alias("spendable"), "arrival.*", "looked", "follow", *[_packed(c) for c in ("service", "candidate")], "conflict",
    )


def _with_outlook(edges: DataFrame, folded: DataFrame, few_claims: bool, cutoff: Column, small: bool, untimed: bool) -> DataFrame:
    """All events, those that open a state with what awaits it."""
    told = _opened(edges, folded, few_claims, cutoff, small, untimed)
    return told.unionByName(edges.filter(~_opens()), allowMissingColumns=True)


def _packed(name: str) -> Column:
    """A label as one text; few events have one, and every level reads all of them."""
    label = F.to_json(F.struct(*[F.col(f"{name}.{f}").cast("string").alias(f) for f in LABEL]))
    return F.when(F.col(name).isNotNull(), label).alias(name)


def _start(located: DataFrame, edges: DataFrame, folded: DataFrame, few_claims: bool, cutoff: Column, untimed: bool) -> DataFrame:
    """The first states: the arrival of a followed seed event, or a seed address alone."""
    begin = F.coalesce("analysis_start", F.timestamp_seconds(F.lit(0))) if "analysis_start" in located.columns else F.timestamp_seconds(F.lit(0))
    path = F.array("e.event_reference")
    place = ["trace_id", "network_key", "token_contract"]
    told = ["looked", "follow", "service", "conflict", "candidate"]
    used = F.lit(0).cast("long").alias("used")
    followed = located.filter("state = 'followed'").select(
        *place, F.coalesce("e.to_address", "seed_address").alias("address"), F.col("e.block_time").alias("at"), F.col("e.seq").alias("at_seq"),
        F.col("e.event_reference").alias("arrival"), F.col("e.tx_hash").alias("arrival_tx"), F.col("e.amount_base_units").alias("amount"),
        path.alias("branch_path"), F.lit(1).cast("long").alias("up"), used, *[F.col(f"e.{c}").alias(c) for c in told],
    )
    alone = located.filter("state = 'discovery'")
    if alone.isEmpty():
        return followed
    bare = cut(alone.select(
        *place, F.col("seed_address").alias("address"), begin.alias("at"), F.lit("").alias("at_seq"), F.lit("").alias("arrival"),
        F.lit(None).cast("string").alias("arrival_tx"), F.lit(None).cast("string").alias("amount"), F.slice(path, 1, 0).alias("branch_path"), F.lit(0).cast("long").alias("up"), used,
    ))
    counts = _outlook(bare, _touched(bare, edges, cutoff, fits(bare)), PLACE, False, untimed)
    known = resolve(bare, folded, "address", F.coalesce("at", cutoff), ["trace_id"], few_claims).join(
        counts.select("trace_id", "looked", "follow"), "trace_id", "left"
    )
    for c in ("service", "candidate"):
        known = known.withColumn(c, _packed(c))
    return followed.unionByName(cut(known.select(followed.columns)))


def _cells(rows: DataFrame, place: list[str], small: bool) -> DataFrame:
    if small:
        return one_cell(rows)
    return with_cells(rows, place, F.unix_seconds("t"), CELL_SECONDS)


def _parts(states: DataFrame, events: DataFrame, untimed: bool) -> list[tuple[DataFrame, DataFrame, bool]]:
    """Arrivals and departures that are compared by time, or by sequence where a time is unknown."""
    if not untimed:
        return [(states, events, True)]
    timed = states.filter("at IS NOT NULL")
    return [
        (timed, events.filter("block_time IS NOT NULL"), True), (timed, events.filter("block_time IS NULL"), False),
        (states.filter("at IS NULL"), events, False),
    ]


def _outlook(states: DataFrame, events: DataFrame, place: list[str], small: bool, untimed: bool) -> DataFrame:
    """Per arrival how many usable departures follow it and how many it looks at."""
    found = []
    kind = states.schema["arrival"].dataType
    for arrivals, departures, by_time in _parts(states, events, untimed):
        s = arrivals.select(*place, F.col("at").alias("t"), F.col("at_seq").alias("q"), F.lit(1).alias("kind"), "arrival",
                            F.lit(0).cast("long").alias("usable"), F.lit(0).cast("long").alias("any"))
        usable = F.col("spendable") & F.col("to_address").isNotNull()
        # The sequence of a departure that is only looked at tells nothing.
        e = departures.select(*place, F.col("block_time").alias("t"), F.when(usable, F.col("seq")).alias("q"), F.lit(0).alias("kind"),
                              F.lit(None).cast(kind).alias("arrival"), usable.cast("long").alias("usable"), F.lit(1).cast("long").alias("any"))
        rows = s.unionByName(e)
        # A departure sorts before an arrival of the same position: strictly after only.
        order = ["t", "q", "kind"] if by_time else ["q", "kind"]
        if small:
            marked = _counted(rows, place, order, by_time)
        else:
            rows = _cells(rows, place, False) if by_time else one_cell(rows)
            marked = running_before(rows, place, order, {"usable_before": (F.sum, F.col("usable"))})
            if by_time:
                # Every departure at or after the arrival's time is looked at.
                marked = running_before(marked.withColumn("_flip", -F.col("kind")), place, ["t", "_flip"], {"any_before": (F.sum, F.col("any"))})
            else:
                marked = marked.withColumn("any_before", F.lit(0).cast("long"))
            totals = rows.groupBy(*place).agg(F.sum("usable").alias("_usable"), F.sum("any").alias("_any"))
            marked = marked.join(totals, place, "left").withColumn("follow", F.col("_usable") - F.col("usable_before")).withColumn(
                "looked", F.col("_any") - F.col("any_before")
            )
        found.append(marked.filter("kind = 1").select(*place, F.col("t").alias("at"), F.col("q").alias("at_seq"), "arrival", "follow", "looked"))
    if len(found) == 1:
        out = found[0]
    else:
        whole = reduce(DataFrame.unionByName, found).groupBy(*place, "at", "at_seq", "arrival")
        out = whole.agg(F.sum("follow").alias("follow"), F.sum("looked").alias("looked"))
    # Nothing is known to leave from an incomplete place.
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in place])
    return out.withColumn("follow", F.when(whole, F.col("follow"))).withColumn("looked", F.when(whole, F.col("looked")))


def _counted(rows: DataFrame, place: list[str], order: list[str], by_time: bool) -> DataFrame:
    """What ``_outlook`` needs where no place is hot: all windows share one shuffle and one sort.

    The shuffle leaves out the asset, so labels of the address meet the rows without another.
    """
    rows = rows.repartition(*[c for c in place if c != "token_contract"])
    # The address tells most rows apart, so it is compared first. Rows run from the last to the
    # first, so what follows a row is what was met before it.
    place = place[::-1]
    back = Window.partitionBy(*place).orderBy(*[F.col(c).desc() for c in order])
    marked = rows.withColumn("follow", F.sum("usable").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if not by_time:
        return marked.withColumn("looked", F.sum("any").over(Window.partitionBy(*place)))
    # Every departure at or after the arrival's time is looked at.
    since = Window.partitionBy(*place).orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("looked", F.sum("any").over(since))


def _continued(live: DataFrame, touch: DataFrame, small: bool, untimed: bool) -> DataFrame:
    """Departures with ``parent``, the earliest-queued arrival before them, and ``tied``.

    Arrivals and departures of a wallet are put in one order, so a running minimum finds
    the parent. A departure is tied if it could only be told from an arrival of the same
    moment by an order that the chain does not give.
    """
    carried = [c for c in touch.columns if c not in PLACE]
    found = []
    for arrivals, departures, by_time in _parts(live, touch, untimed):
        event = F.struct(*carried).alias("event")
        e = departures.select(*PLACE, F.col("block_time").alias("t"), F.col("seq").alias("q"), F.lit(0).alias("kind"), event)
        s = arrivals.select(*PLACE, F.col("at").alias("t"), F.col("at_seq").alias("q"), F.lit(1).alias("kind"),
                            F.struct("place", "total", "branch_path").alias("state"))
        rows = s.unionByName(e, allowMissingColumns=True)
        rows = _cells(rows, PLACE, small) if by_time else one_cell(rows)
        marked = running_before(rows, PLACE, ["t", "q", "kind"] if by_time else ["q", "kind"], {"parent": (F.min, F.col("state"))})
        last = F.max(F.when(F.col("kind") == 1, F.col("q"))).over(Window.partitionBy(*PLACE, "_cell", "t")) if by_time else F.lit(None).cast("string")
        out = marked.withColumn("_last", last).filter("kind = 0").select(*PLACE, "event.*", "parent", (F.col("q") <= F.col("_last")).alias("_same"))
        found.append(out.withColumn("tied", F.coalesce(F.col("spendable") & F.col("unordered") & F.col("_same"), F.lit(False))).drop("_same"))
    if len(found) == 1:
        return found[0]
    rest = [c for c in carried if c != "event_reference"]
    joined = reduce(DataFrame.unionByName, found).groupBy(*PLACE, "event_reference").agg(
        F.first(F.struct(*rest)).alias("_event"), F.min("parent").alias("parent"), F.max("tied").alias("tied")
    )
    return joined.select(*PLACE, "event_reference", "_event.*", "parent", "tied")


def _reached(states: DataFrame, hop: int, stopped: Column) -> DataFrame:
    """Per state its depth and whether a budget stopped it; every state ends there or has one a hop further."""
    return states.select("trace_id", F.lit(hop).cast("long").alias("hop"), stopped.cast("int").alias("stopped"))


def _ending(cls: str, reason: Column | str | None, status: str, label: str | None = None) -> Column:
    """What an ending says; ``label`` is the packed label that it rests on."""
    return F.struct(
        F.lit(cls).alias("endpoint_class"), F.lit(status).alias("attribution_status"), F.lit(reason).cast("string").alias("boundary_reason"),
        (F.col(label) if label else F.lit(None)).cast("string").alias("label"),
    )


def _endings(states: DataFrame, hop: int, *told: Column) -> DataFrame:
    """Endings of ``states``; each of ``told`` is an ending or NULL."""
    rows = states.withColumn("_told", F.explode(F.array_compact(F.array(*told))) if len(told) > 1 else told[0])
    rows = rows.withColumn("_label", F.from_json("_told.label", ", ".join(f"{f} STRING" for f in LABEL)))
    return rows.select(
        "trace_id", "network_key", "token_contract", "address", "_told.endpoint_class", "_told.attribution_status", "_told.boundary_reason",
        F.lit(hop).cast("long").alias("hop_depth"), "branch_path",
        F.nullif("arrival", F.lit("")).alias("arrival_event_reference"), F.col("arrival_tx").alias("arrival_tx_hash"),
        F.col("amount").alias("observed_amount_base_units"), *[f"_label.{f}" for f in LABEL],
    )


def _where_they_lie(rows: DataFrame) -> DataFrame:
    """``rows`` written once; tables that lie by trace meet without being dealt out again."""
    with by_some_keys(rows.sparkSession):
        return staged(rows, lone=LONE)


def _touched(live: DataFrame, edges: Laid | DataFrame, cutoff: Column, small: bool | None, claimed: DataFrame | None = None, only: str = "true") -> DataFrame:
    """Departures from the wallets of ``live``, once per trace and wallet; ``only`` names those that matter.

    ``taken`` says whether an earlier level of the trace claimed the event. What is claimed is
    brought to the wallets before these meet the events, so no event is moved for it.
    """
    start = live.groupBy("trace_id", "network_key", "token_contract", "address").agg(
        F.min("at").alias("since"), F.max(F.col("at").isNull()).alias("open")
    )
    taken = F.lit(False)
    if claimed is not None:
        start = start.join(claimed, PLACE, "left")
        after = F.when(F.col("block_time").isNull(), F.col("seq") > F.col("timed_seq")).otherwise(
            F.struct(F.col("block_time").alias("t"), F.col("seq").alias("q")) > F.col("claimed_since")
        )
        taken = F.coalesce(after, F.lit(False)) | F.coalesce(F.col("seq") > F.col("untimed_seq"), F.lit(False))
    start = start.withColumnRenamed("address", "from_address")
    if isinstance(edges, Laid):
        out = edges.join(start, small, only)
    else:
        out = dim_join(edges.filter(only), start, SENDER, "inner", ["event_reference"], small)
    out = out.withColumnRenamed("from_address", "address")
    return out.filter(
        F.coalesce(F.col("open") | (F.col("block_time") >= F.col("since")), F.lit(True))
        & F.coalesce(F.col("block_time") <= cutoff, F.lit(True))
    ).withColumn("taken", taken).drop("since", "open", *CLAIMED)


def _claimed(
    expanded: DataFrame, before: DataFrame | None, passing: list[Callable] | None = None, alive: DataFrame | None = None, few: bool | None = None
) -> DataFrame:
    """Per trace and wallet the earliest positions from which departures are claimed.

    All departures strictly after an expanded state are claimed by some state of its level,
    so the earliest expanded positions of a wallet tell which of its events are. Claims of
    traces that are not ``alive`` any more go; ``few`` says whether these fit a broadcast.
    """
    timed = F.col("at").isNotNull()
    own = expanded.select(
        *PLACE, F.when(timed, F.struct(F.col("at").alias("t"), F.col("at_seq").alias("q"))).alias("claimed_since"),
        F.when(timed, F.col("at_seq")).alias("timed_seq"), F.when(~timed, F.col("at_seq")).alias("untimed_seq"),
    )
    parts = [own] if before is None else [own, before]
    if alive is not None:
        parts = [dim_join(p, alive, ["trace_id"], "left_semi", [], few) for p in parts]
    rows = parts[0] if before is None else _by_trace(reduce(DataFrame.unionByName, parts))
    return staged_by(rows.groupBy(*PLACE).agg(*[F.min(c).alias(c) for c in CLAIMED]), ["trace_id"], passing)


def _by_trace(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out as the states are, so that a join with these moves nothing more."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "trace_id")


def _spans(live: DataFrame, claimed: DataFrame | None) -> DataFrame:
    """Stretches of time at each wallet of a trace, with the arrival that departures in them continue.

    A departure lies in the span after ``lo`` and up to ``hi``, the next arrival. The first
    arrival also opens a span without ``parent``, of departures at its own time that do not follow it.
    """
    pos = F.struct(F.col("at").alias("t"), F.col("at_seq").alias("q"))
    # In the order of the claims' keys, so that meeting them sorts nothing again.
    turn = Window.partitionBy("trace_id", *reversed(WALLET)).orderBy("at", "at_seq", "place")
    rows = live.select("trace_id", *WALLET, "at", "at_seq", "place", "total", "branch_path").select(
        "trace_id", *WALLET, "total", pos.alias("lo"), F.lead(pos).over(turn).alias("hi"), F.lag("place").over(turn).isNull().alias("_first"),
        F.min(F.struct("place", "branch_path")).over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("parent"),
    )
    if claimed is None:
        rows = rows.withColumn("claimed_since", F.lit(None).cast(rows.schema["lo"].dataType))
    else:
        rows = rows.join(claimed.select(*PLACE, "claimed_since"), PLACE, "left")
    own = F.struct("lo", "hi", "parent")
    before = F.struct(
        F.struct(F.col("lo.t").alias("t"), F.lit(None).cast("string").alias("q")).alias("lo"), F.col("lo").alias("hi"),
        F.lit(None).cast(rows.schema["parent"].dataType).alias("parent"),
    )
    span = F.explode(F.when(F.col("_first"), F.array(before, own)).otherwise(F.array(own))).alias("_span")
    # Plain columns, which are compared without building a value for each pair.
    ends = [F.col(f"{c}.{f}").alias(f"{n}_{f}") for c, n in (("_span.lo", "lo"), ("_span.hi", "hi"), ("claimed_since", "since")) for f in "tq"]
    return rows.select("trace_id", *WALLET, "total", "claimed_since", span).select("trace_id", *WALLET, "total", *ends, "_span.parent")


def _followed(live: DataFrame, edges: Laid, cutoff: Column, small: bool, claimed: DataFrame | None) -> DataFrame:
    """What ``_touched`` and ``_continued`` find where all times are known, written where the events are."""
    met = edges.join(_spans(live, claimed).withColumnRenamed("address", "from_address"), small, MOVING).withColumnRenamed("from_address", "address")
    t, q = F.col("block_time"), F.col("seq")
    later = (t > F.col("lo_t")) | ((t == F.col("lo_t")) & (F.col("lo_q").isNull() | (q > F.col("lo_q"))))
    upto = F.col("hi_t").isNull() | (t < F.col("hi_t")) | ((t == F.col("hi_t")) & (q <= F.col("hi_q")))
    met = met.filter(later & upto & F.coalesce(t <= cutoff, F.lit(True)))
    taken = (t > F.col("since_t")) | ((t == F.col("since_t")) & (q > F.col("since_q")))
    return met.withColumn("taken", F.coalesce(taken, F.lit(False))).withColumn(
        "tied", F.coalesce(F.col("spendable") & F.col("unordered") & (F.col("hi_t") == t), F.lit(False))
    )


def trace(
    seeds: DataFrame, transfers: DataFrame, claims: DataFrame, cutoff: Column,
    max_hops: int = MAX_HOPS, max_events: int = MAX_EVENTS, passing: list[Callable] | None = None,
) -> Trace:
    """Walk forward from every seed, level by level.

    ``seeds``: ``trace_id, network_key, token_contract, seed_address,
    seed_event_reference`` (NULL for address discovery), optional
    ``analysis_start``. At each state the budgets are tested first, then the
    labels at the arrival time, then the departures. ``passing`` removes the written
    ``transfers`` once they are laid out.
    """
    passing = [] if passing is None else passing
    slim = prepared(transfers, passing)
    seeds = cut(seeds)
    folded = cut(claims_by_address(claims))
    few_claims = fits(folded)
    rows, bare = slim.agg(F.count(F.lit(1)), F.sum(F.col("block_time").isNull().cast("long"))).first()
    untimed = bool(bare)
    # A wallet's rows in a trace are some of its arrivals and departures in the ledger.
    ends = [slim.select("network_key", "token_contract", F.col(c).alias("address")) for c in ("from_address", "to_address")]
    calm = 2 * rows <= scale.HOT_ROWS or none_hot(ends[0].unionByName(ends[1]), WALLET)
    # Written between its two shuffles, so that only one of them is on disk at a time.
    outlook: list[Callable] = []
    opened = staged(_opened(slim, folded, few_claims, cutoff, calm, untimed), outlook, LONE)
    moving = F.coalesce(F.expr(MOVING), F.lit(False))
    # Departures that are only counted are not laid out; a seed may still be one of them.
    rest = slim.filter(moving & ~_opens())
    edges = Laid(opened.unionByName(rest, allowMissingColumns=True), SENDER, ["block_time"], "event_reference", calm, LONE)
    passed(outlook)
    try:
        located = cut(locate_seeds(seeds, edges.df.unionByName(slim.filter(~moving), allowMissingColumns=True), cutoff))
        first = _start(located, slim, folded, few_claims, cutoff, untimed)
        passed(passing)
        return _walk(located, first, edges, cutoff, max_hops, max_events, untimed, calm, fits(seeds))
    finally:
        edges.drop()


def _budgeted(states: DataFrame, max_events: int) -> DataFrame:
    """States of traces with budget left, with their ``place`` in the queue, ``late``, whether the
    event budget was used up before their turn, and ``total``.

    A trace below its budget has looked at fewer than ``max_events`` events, and each of its
    states is one of them, so its queue holds at most that many rows.
    """
    # Dealt out by trace once: ranks, budgets and the order of arrivals are all made there.
    states = _by_trace(states)
    looked = F.when(F.col("service").isNull(), F.coalesce("looked", F.lit(0))).otherwise(F.lit(0))
    turn = Window.partitionBy("trace_id").orderBy("up", "at", "at_seq", "arrival")
    queue = turn.rowsBetween(Window.unboundedPreceding, -1)
    rows = states.withColumn("_looks", looked.cast("long")).withColumn("place", F.rank().over(turn).cast("long"))
    rows = rows.withColumn("late", F.col("used") + F.coalesce(F.sum("_looks").over(queue), F.lit(0)) >= max_events)
    whole = Window.partitionBy("trace_id")
    return rows.withColumn("total", F.col("used") + F.sum(F.when(~F.col("late"), F.col("_looks")).otherwise(F.lit(0))).over(whole))


def _walk(
    located: DataFrame, states: DataFrame, edges: Laid, cutoff: Column, max_hops: int, max_events: int, untimed: bool, calm: bool,
    few_traces: bool,
) -> Trace:
    claimed: DataFrame | None = None
    expanded: DataFrame | None = None
    observed: list[DataFrame] = []
    endings: list[DataFrame | Callable[[], DataFrame]] = []
    limits: list[DataFrame] = []
    used: list[DataFrame] = []
    reached: list[DataFrame] = []
    seized: list[Callable] = []

    for hop in range(max_hops + 1):
        if hop == max_hops:
            endings.append(_endings(states, hop, _ending("boundary", "hop_limit", "unresolved")))
            reached.append(_reached(states, hop, F.lit(True)))
            break
        # A trace whose budget was used up at the level before ends where it stands.
        spent = states.filter(F.col("used") >= max_events)
        endings.append(_endings(spent, hop, _ending("boundary", "event_limit", "unresolved")))
        reached.append(_reached(spent, hop, F.lit(True)))
        states = staged_by(_budgeted(states.filter(F.col("used") < max_events), max_events), ["trace_id"], lone=LONE)
        is_live = ~F.col("late") & F.col("service").isNull()
        size = F.octet_length("address") + F.octet_length("trace_id") + F.octet_length(F.array_join("branch_path", ">")) + 128
        count, going, looks, held = states.agg(
            F.count(F.lit(1)), F.sum(is_live.cast("long")), F.sum(F.when(is_live, F.col("_looks"))), F.sum(F.when(is_live, size))
        ).first()
        if count == 0:
            break
        reached.append(_reached(states, hop, F.col("late")))
        used.append(states.groupBy("trace_id").agg(F.max("total").alias("total")))
        late = F.when(F.col("late"), _ending("boundary", "event_limit", "unresolved"))
        served = F.when(~F.col("late") & F.col("service").isNotNull(), _ending("known_service", "service_boundary", "supported", "service"))
        open_ = states.filter("NOT late")
        limits.append(
            open_.filter("conflict").select("trace_id", F.lit("conflicting_service_labels").alias("code"), "address",
                                            F.lit(None).cast("string").alias("event_reference"))
        )
        if not going:
            endings.append(_endings(states, hop, late, served))
            break
        live = open_.filter("service IS NULL")

        if expanded is not None:
            # A level's claims hold those of all levels before.
            before, seized = seized, []
            claimed = _claimed(expanded, claimed, seized, live.select("trace_id").distinct(), few_traces)
            passed(before)
        expanded = live
        small = going <= scale.BROADCAST_ROWS and held <= scale.BROADCAST_BYTES
        if untimed or live.groupBy("trace_id", *WALLET).count().agg(F.max("count")).first()[0] > CROWD:
            touch = _touched(live, edges, cutoff, small, claimed, MOVING)
            # Of an event that is taken only a tie can still be told.
            touch = touch.filter("unverified OR (spendable AND (unordered OR NOT taken))")
            # What the states look at is an upper bound of the departures they touch.
            walked = _continued(live, touch, calm or looks + count <= scale.HOT_ROWS, untimed)
            walked = walked.withColumn("total", F.col("parent.total")).withColumn("parent", F.when(F.col("parent").isNotNull(), F.struct("parent.place", "parent.branch_path")))
        else:
            # Spans are wide, so fewer of them are worth a copy for every task.
            walked = _followed(live, edges, cutoff, small and going <= scale.BROADCAST_ROWS // 10, claimed)
        fresh = F.col("spendable") & F.col("parent").isNotNull()
        walked = walked.withColumn("fresh", fresh & ~F.col("taken")).filter("fresh OR unverified OR tied")
        walked = walked.select(
            *[c for c in walked.columns if c not in ("parent", "taken", "spendable", "unordered", "total", *SPAN)],
            F.when(F.col("fresh"), F.concat("parent.branch_path", F.array("event_reference"))).alias("branch_path"),
            F.col("parent.place").alias("up"), F.col("total").alias("used"), F.lit(hop + 1).cast("long").alias("hop_depth"),
        )
        walked = _where_they_lie(walked)
        for flag, code in (("unverified", "execution_or_finality_unverified"), ("tied", "ambiguous_ordering")):
            limits.append(walked.filter(flag).select("trace_id", F.lit(code).alias("code"), "address", "event_reference"))

        fresh = walked.filter("fresh")
        observed.append(fresh)
        ranked, states = states, fresh.filter("to_address IS NOT NULL").select(
            "trace_id", "network_key", "token_contract", F.col("to_address").alias("address"),
            F.col("block_time").alias("at"), F.col("seq").alias("at_seq"),
            F.col("event_reference").alias("arrival"), F.col("tx_hash").alias("arrival_tx"), F.col("amount_base_units").alias("amount"),
            "branch_path", "up", "used", "looked", "follow", "service", "conflict", "candidate",
        )
        endings.append(_endings(ranked, hop, late, served))
        # Only states that were expanded meet the parents that go on; those of a large level do so once.
        won = fresh.filter("to_address IS NOT NULL").select("trace_id", F.col("up").alias("place"))
        many = going > scale.BROADCAST_ROWS
        won = (_by_trace(won) if many else won).distinct().withColumn("_won", F.lit(True))
        ended = F.when(F.coalesce("follow", F.lit(0)) == 0, "no_outgoing_activity")
        hint = F.when(F.col("candidate").isNotNull(), _ending("deposit_candidate", None, "candidate", "candidate"))
        quiet = F.when(F.col("_won").isNull(), _ending("unresolved", ended, "unresolved"))
        stopped = _endings(live.join(won, ["trace_id", "place"], "left"), hop, hint, quiet)
        endings.append(partial(_where_they_lie, stopped) if many else stopped)

    passed(seized)
    return _assemble(located, observed, endings, limits, used, reached)


def _assemble(located, observed, endings, limits, used, reached) -> Trace:
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    rejected = located.filter("state = 'rejected'").select(
        "trace_id", F.lit("seed_not_verified").alias("code"), F.col("seed_address").alias("address"),
        F.col("seed_event_reference").alias("event_reference"),
    )
    obs_cols = ["trace_id", "network_key", "token_contract", "event_reference", "from_address", "to_address",
                "amount_base_units", "block_time", "seq", "hop_depth", "branch_path", "tx_hash"]
    seed_rows = located.filter("state = 'followed'").select("trace_id", "network_key", "token_contract", "e.*").select(
        "*", F.lit(0).cast("long").alias("hop_depth"), F.array("event_reference").alias("branch_path")
    )
    walked = [
        o.withColumnRenamed("address", "from_address") for o in observed
    ]
    # Only verified events are observed.
    all_obs = union([seed_rows.select(*obs_cols), *[w.select(*obs_cols) for w in walked]]).withColumns(
        {"execution_status": F.lit("success"), "confirmation_state": F.lit("confirmed")}
    )
    all_lim = union([rejected, *limits]).distinct()
    all_end = lambda: union([e() if callable(e) else e for e in endings])
    # Limitations other than conflicts leave a trace partial; telling them apart needs no distinct rows.
    doubts = union([rejected, *limits]).filter("code <> 'conflicting_service_labels'").select("trace_id").distinct().withColumn("doubt", F.lit(1))
    far = union(reached).groupBy("trace_id").agg(F.max("hop").alias("hops_used"), F.max("stopped").alias("budget"))
    seen = union(used).groupBy("trace_id").agg(F.max("total").alias("events_examined")) if used else None
    header = located.select("trace_id", "network_key", "token_contract", "seed_address", "seed_event_reference", "state")
    header = header.join(far, "trace_id", "left").join(doubts, "trace_id", "left")
    header = header.join(seen, "trace_id", "left") if seen is not None else header.withColumn("events_examined", F.lit(None).cast("long"))
    partial = (F.coalesce("budget", F.lit(0)) == 1) | F.col("doubt").isNotNull()
    return Trace(
        header.select(
            "trace_id", "network_key", "token_contract", "seed_address", "seed_event_reference", "state",
            F.when(F.col("state") == "unavailable", "unavailable").when(partial, COVERAGE[1]).otherwise(COVERAGE[0]).alias("coverage_status"),
            F.when(F.col("state") == "followed", "established").otherwise("not_established").alias("case_flow_linkage"),
            F.coalesce("hops_used", F.lit(0)).cast("long").alias("hops_used"),
            F.coalesce("events_examined", F.lit(0)).cast("long").alias("events_examined"),
        ),
        all_obs, all_end, all_lim,
    )
