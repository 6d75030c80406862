"""Repair of conversations as a lightest derivation, found with Knuth's agenda.

A conversation should be an optional system turn followed by pairs of user and assistant turns. Rows are
kept, given another role, deleted, or new ones are put between them. Items say "the first i rows are
dealt with and the grammar is in state q". A deduction takes an item and an edit of the next row (or a
row put in) to the next item; its weight is the pair (cost, audit) of the whole derivation, audits
being the edits' initials. Deductions never make a pair smaller and keep the order of pairs (audits of equal cost and equal
rows are never one the beginning of the other, as a row put in costs something), so the agenda pops each
item with its lightest derivation, and stops when the goal is popped.

A conversation of any length is worked in segments of ``SEGMENT`` rows, each a span item for every
pair of states it may begin and end in; spans side by side are joined, ``FAN`` at a time and round by
round, by the same agenda. So no task holds more rows than a segment, or more spans than a round joins.
Equal rows of one turn travel as one row with a count, the first row of a kind among equals is found by a
minimum that is combined before the shuffle, and rows are sorted by range, so a conversation that holds a
third of all rows is dealt out like many. Only the digest of the repaired text, a hash over all its
rows in order, runs through one task a conversation, row by row, which nothing else can give.

Defined results: null ids are an id of their own; null roles and texts are one space; nulls first among
turns, rows of one turn by role, then text, copies side by side; an empty role fits
nowhere; a conversation without rows after damage has zeros, an empty audit and the hash of nothing;
repeated rows are duplicates like any; an empty table gives no rows; further columns are ignored; texts
may be of any length.
"""

import hashlib
import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.session import staged

from .common import mapped

SEGMENT = 512
FAN = 32
KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user's, after an assistant's; the goal's states.
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (START, ASSISTANT)
#: Initial to (state before, state after), and what a turn put in or renamed in a state must be.
TURNS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
GIVEN = TURNS["u"] + TURNS["a"]
ROLE = {USER: "user", ASSISTANT: "assistant"}
BLANK, DUPLICATE, TRUNCATED, FINE = "blank", "duplicate", "truncated", "fine"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times: the rows after damage, decided by a hash of id and turn. A row that
    is repeated has twice the times."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    return rows.where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with their fault, in stored order: conv_id, turn, role, text, times, fault, place.

    ``place`` grows along a conversation. Of ``times`` equal rows the first has the fault, the others are duplicates (or
    blank, like the first).
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    rows = staged(rows.withColumn("kind", F.unhex(F.md5(F.concat_ws(":", "role", "text").cast("binary")))), "turns")
    after = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy("conv_id", "kind").agg(F.min(after).alias("first"), F.count("*").alias("many")).where("many > 1")
    again = rows.alias("r").join(
        first.alias("f"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.kind") == F.col("f.kind")), "left"
    )
    earlier = F.col("first").isNotNull() & ~F.struct(F.col("turn").isNotNull(), F.col("turn")).eqNullSafe(F.col("first"))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(earlier, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise(FINE)
    )
    found = staged(again.select("r.conv_id", "turn", "role", "text", "times", fault.alias("fault")), "faults")
    order = ["conv_id", "turn", "role", "text"]
    return staged(
        found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ordered"
    )


def edits(initial, times, fault):
    """Edits of equal rows, as steps: lists of (state before, state after, cost, audit)."""
    drop = [(q, q, DELETE, "D") for q in range(4)]
    others = [[(q, q, DELETE * (times - 1), "D" * (times - 1)) for q in range(4)]] if times > 1 else []
    if fault in (BLANK, DUPLICATE):
        return [drop, *others]
    mend = MEND if fault == TRUNCATED else 0
    kept = [(p, q, KEEP + mend, "K") for p, q in TURNS.get(initial, ())]
    return [[*drop, *kept, *[(p, q, REROLE + mend, "R") for p, q in GIVEN]], *others]


def lightest(steps, start, goals=None, inserts=True):
    """Lightest (cost, audit) of every state after all ``steps``, from ``start``; with ``goals``, of the first goal popped.

    A deduction joins the popped item with an edit of its next step, or with a turn put in.
    """
    agenda, done, found = [(0, "", 0, start)], set(), {}
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(steps):
            found[state] = (cost, audit)
            if goals is not None and state in goals:
                return {state: (cost, audit)}
        else:
            for before, after, more, said in steps[i]:
                if before == state and (i + 1, after) not in done:
                    heapq.heappush(agenda, (cost + more, audit + said, i + 1, after))
        if inserts:
            for before, after in GIVEN:
                if before == state and (i, after) not in done:
                    heapq.heappush(agenda, (cost + INSERT, audit + "I", i, after))
    return found


def spans_of(steps, inserts=True):
    """Span items (state before, state after, cost, audit) of a segment or of spans side by side."""
    return [(p, q, *best) for p in range(4) for q, best in lightest(steps, p, inserts=inserts).items()]


def best_of(steps, inserts=True):
    """(cost, audit) of the whole conversation."""
    return min(lightest(steps, START, GOALS, inserts).values())


def illegal_pair(a, b):
    return a + b not in ("su", "ua", "au")


SPAN = "array<struct<before:int,after:int,cost:long,audit:string>>"
COUNTED = "blank long, duplicate long, truncated long, illegal long, first string, last string"


def _segment(rows):
    """Counts and steps of rows (initial, times, fault) in order."""
    counts, steps, illegal, last = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, FINE: 0}, [], 0, None
    for initial, times, fault in rows:
        counts[fault] += 1
        counts[BLANK if fault == BLANK else DUPLICATE] += times - 1
        steps += edits(initial, times, fault)
        illegal += (times - 1) * illegal_pair(initial, initial)
        illegal += last is not None and illegal_pair(last, initial)
        last = initial
    return [counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, rows[0][0], last], steps


def _grouped(batches, keys):
    """Runs of rows with equal first ``keys`` columns, over batches in order."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and row[:keys] != key:
                yield key, held
                held = []
            key = row[:keys]
            held.append(row[keys:])
    if held:
        yield key, held


def _written(rows, schema, batch=1024):
    """Arrow batches of Python rows."""
    import pyarrow as pa

    held = []
    for row in rows:
        held.append(row)
        if len(held) == batch:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(spark, ddl):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _dealt(rows: DataFrame, function, keys, order, fields) -> DataFrame:
    """Rows whose ``keys`` are equal, in order, through ``function(key, rows)``, which yields rows."""
    schema = _arrow(rows.sparkSession, fields)

    def call(batches):
        return _written((out for key, held in _grouped(batches, len(keys)) for out in function(key, held)), schema)

    return mapped(rows.repartition(*keys).sortWithinPartitions(*keys, *order), call, fields)


def segments(rows: DataFrame) -> DataFrame:
    """conv_id, part, the counts, spans: one row per segment, numbered in order within its conversation.

    The part of a conversation of one segment is 0 and its spans hold only the best way from start to goal.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    per = rows.select("conv_id", "place", F.floor(F.col("place") / SEGMENT).alias("block"), F.substring("role", 1, 1).alias("initial"), "times", "fault")
    blocks = per.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    blocks = staged(blocks, "blocks")
    several = blocks.groupBy("conv_id").agg(F.count("*").alias("parts"), F.min("block").alias("low"))
    numbered = per.alias("p").join(several.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")))
    numbered = numbered.select("p.conv_id", "block", "parts", "place", "initial", "times", "fault")

    def work(key, held):
        conv, block, parts = key
        counts, steps = _segment([row[1:] for row in held])
        spans = [(START, ASSISTANT, *best_of(steps))] if parts == 1 else spans_of(steps)
        yield conv, block, parts, *counts, [dict(zip(("before", "after", "cost", "audit"), s)) for s in spans]

    fields = f"conv_id {kind}, block long, parts long, {COUNTED}, spans {SPAN}"
    return staged(_dealt(numbered, work, ["conv_id", "block", "parts"], ["place"], fields), "segments")


def joined(found: DataFrame) -> DataFrame:
    """One row per conversation with its counts, cost and audit, from its segments."""
    from pyspark.sql import Window

    kind = found.schema["conv_id"].dataType.simpleString()
    names = [f.split()[0] for f in COUNTED.split(", ")]
    done = [found.where("parts = 1")]
    # One narrow row per segment: numbers for those of conversations of several.
    rest = found.where("parts > 1").withColumn("part", F.row_number().over(Window.partitionBy("conv_id").orderBy("block")) - 1)
    rest = rest.select("conv_id", F.col("part").cast("long").alias("part"), "parts", *names, "spans")
    rest = staged(rest, "parts") if not rest.isEmpty() else None
    while rest is not None:

        def work(key, held):
            conv, group, parts = key
            left = -(-parts // FAN)
            counts = [sum(row[1 + k] for row in held) for k in range(4)]
            counts[3] += sum(illegal_pair(a[6], b[5]) for a, b in zip(held, held[1:]))
            steps = [[(s["before"], s["after"], s["cost"], s["audit"]) for s in row[7]] for row in held]
            spans = [(START, ASSISTANT, *best_of(steps, False))] if left == 1 else spans_of(steps, False)
            yield conv, group, left, *counts, held[0][5], held[-1][6], [dict(zip(("before", "after", "cost", "audit"), s)) for s in spans]

        grouped = rest.select("conv_id", F.floor(F.col("part") / FAN).alias("group"), "parts", "part", *names, "spans")
        fields = f"conv_id {kind}, part long, parts long, {COUNTED}, spans {SPAN}"
        rest = staged(_dealt(grouped, work, ["conv_id", "group", "parts"], ["part"], fields), "parts")
        done.append(rest.where("parts = 1"))
        rest = rest.where("parts > 1")
        if rest.isEmpty():
            rest = None
    out = None
    for part in done:
        part = part.select("conv_id", *names[:4], F.col("spans")[0]["cost"].alias("cost"), F.col("spans")[0]["audit"].alias("audit"))
        out = part if out is None else out.unionByName(part)
    return out


def _replay(rows: DataFrame, audits: DataFrame, function, fields) -> DataFrame:
    """Repaired rows of every conversation through ``function``: it gets an iterator of (conversation, rows), rows
    being an iterator of (role, text, edit). A conversation's audit comes first, then its rows one by one."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    header = audits.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("times"), F.lit("").alias("fault"))
    feed = header.unionByName(rows.select("conv_id", "place", "role", "text", "times", "fault"))
    schema = _arrow(rows.sparkSession, fields)

    def turns(batches):
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def conversation(audit, source):
        """``source`` yields the rows; the first row of the next conversation is left in ``ahead``."""
        state, at = START, 0
        follow = {SYSTEM: USER, START: USER, ASSISTANT: USER, USER: ASSISTANT}

        def put_in():
            nonlocal state, at
            while at < len(audit) and audit[at] == "I":
                state = follow[state]
                at += 1
                yield ROLE[state], "", "I"

        yield from put_in()
        for role, text, times in source:
            for _ in range(times):
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = dict(TURNS[role[:1]])[state]
                    yield role, text, "K"
                elif edit == "R":
                    state = follow[state]
                    yield ROLE[state], text, "R"
                yield from put_in()

    def call(batches):
        feed = turns(batches)
        ahead = next(feed, None)
        while ahead is not None:
            conv, audit, following = ahead[0], ahead[3], [None]

            def source():
                for row in feed:
                    if row[1] < 0:
                        following[0] = row
                        return
                    yield row[2], row[3], row[4]

            yield from function(conv, conversation(audit, source()))
            ahead = following[0]

    order = feed.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return mapped(order, lambda batches: _written(call(batches), schema), fields)


def analysed(rows: DataFrame):
    """(rows in order, conv_id with counts, cost and audit) of damaged rows."""
    rows = ordered(rows)
    return rows, staged(joined(segments(rows)), "audits")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text, edit: the repaired conversations of rows (conv_id, turn, role, text, times)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows, audits = analysed(rows)

    def listed(conv, turns):
        for place, (role, text, edit) in enumerate(turns):
            yield conv, place, role, text, edit

    return _replay(rows, audits, listed, f"conv_id {kind}, place long, role string, text string, edit string")


def report(conversations: DataFrame) -> DataFrame:
    """Damage, diagnosis and repair of every conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows, audits = analysed(damaged(conversations))

    def digest(conv, turns):
        whole = hashlib.sha256()
        for k, (role, text, _) in enumerate(turns):
            whole.update(("\n" * (k > 0) + f"{role}:{text}").encode())
        yield conv, whole.hexdigest()

    digests = _replay(rows, audits, digest, f"conv_id {kind}, repaired_sha256 string")
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    found = conversations.select("conv_id").distinct()
    for part in (gaps, audits, digests):
        found = found.alias("x").join(part.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")), "left")
        found = found.select("x.*", *[F.col(f"y.{c}") for c in part.columns if c != "conv_id"])
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(
        "conv_id",
        *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
