"""Repair of the structure of conversations: the cheapest edits that give a wanted order of roles.

The method is a backward cost-to-go over (turn, state of the grammar) and a greedy walk forward that takes the ASCII-least
edit among those on a cheapest path.  One conversation may hold a third of all rows, so nothing but its result is ever in one
task.  Rows are sorted by ranges over all conversations and cut into pieces of at most 256 rows of one conversation; a piece
is known by a letter a row.  Where a conversation has one piece, that is all.  Else each piece gives its 4 x 4 matrix of
least costs between states, a conversation's matrices are folded from the back into the cost-to-go at the end of each piece,
each piece gives the state in which the walk leaves it for each state in which it may enter, and these are folded from the
front.  Edits and texts are then made piece by piece; only the hash, which is a chain, reads a long conversation's pieces one
after another, as a stream.  A fold holds a small row for each piece, less than the audit string that the result has anyway.

Defined results: null roles and texts, and null ids in the hashed name, are one space; rows without conv_id are a
conversation.  Rows of equal turn are taken by the first 64 characters of role and text, then by a digest of both, so
equal rows stand together; a null turn comes first.  A role whose first letter is not s, u or a can't be kept.  An empty
table gives no rows.  Other columns are dropped; ids do not leave Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import discard, parts, reach_workers, written

#: Rows of a piece, as a power of two.
_PIECE_BITS = 8
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_FAR = 1 << 60

# States of (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a.  The next user or assistant turn is given by the state.
_THEN = (2, 2, 3, 2)
_NAME = ("user", "user", "assistant", "user")
_INITIALS = "sua"
_AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Cost-to-go when no rows are left: what must be inserted.
_END = (0, 2 * INSERT, INSERT, 0)


def _letter(initial: Column, gone: Column, truncated: Column) -> Column:
    """A row's letter: a to l for the initials s, u, a and others, each sound, truncated or to be deleted."""
    which = F.when(initial == "s", 0).when(initial == "u", 3).when(initial == "a", 6).otherwise(9)
    return F.char(97 + which + F.when(gone, 2).when(truncated, 1).otherwise(0))


def _meaning(letter: str) -> tuple[str, int]:
    which, fault = divmod(ord(letter) - 97, 3)
    return (_INITIALS + "o")[which], fault


def _to_go(rows: str, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least costs from each state before each row, and after the last, where they are end."""
    found = [end]
    for letter in reversed(rows):
        initial, fault = _meaning(letter)
        rest, now = found[-1], []
        for s in range(4):
            best = DELETE + rest[s]
            if fault != 2:
                extra = TRUNCATED * fault
                best = min(best, REROLE + extra + rest[_THEN[s]], *(KEEP + extra + rest[t] for t in [_AFTER[s].get(initial)] if t is not None))
            now.append(best)
        found.append(tuple(min(now[s], INSERT + now[_THEN[s]], 2 * INSERT + now[_THEN[_THEN[s]]]) for s in range(4)))
    return found[::-1]


@lru_cache(1 << 14)
def _walk(rows: str, state: int, end: tuple[int, ...], last: bool) -> tuple[str, int, int]:
    """The ASCII-least cheapest edits from state, their cost, and the state behind them; `last` adds what the end needs."""
    to_go, out, cost, i = _to_go(rows, end), [], 0, 0
    while i < len(rows) or last and to_go[i][state]:
        now = to_go[i][state]
        initial, fault = _meaning(rows[i]) if i < len(rows) else ("", 2)
        kept = _AFTER[state].get(initial) if fault != 2 else None
        extra = TRUNCATED * fault
        if i < len(rows) and DELETE + to_go[i + 1][state] == now:
            edit, price, then = "D", DELETE, state
        elif INSERT + to_go[i][_THEN[state]] == now:
            edit, price, then = "I", INSERT, _THEN[state]
        elif kept is not None and KEEP + extra + to_go[i + 1][kept] == now:
            edit, price, then = "K", KEEP + extra, kept
        else:
            edit, price, then = "R", REROLE + extra, _THEN[state]
        out.append(edit)
        cost, state, i = cost + price, then, i + (edit != "I")
    return "".join(out), cost, state


@F.pandas_udf(ArrayType(LongType()))
def _matrix(rows: pd.Series) -> pd.Series:
    """Least costs from each state before the rows to each one behind them, row by row of the matrix."""
    unit = [tuple(0 if t == u else _FAR for u in range(4)) for t in range(4)]

    def of(r: str) -> list[int]:
        columns = [_to_go(r, end)[0] for end in unit]
        return [min(columns[t][s], _FAR) for s in range(4) for t in range(4)]

    return rows.map(of)


@F.pandas_udf(ArrayType(LongType()))
def _exits(rows: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([[_walk(r, s, tuple(map(int, e)), False)[2] for s in range(4)] for r, e in zip(rows, end)])


def _ends(group: pd.DataFrame) -> pd.DataFrame:
    """The cost-to-go at the end of each of a conversation's pieces."""
    group, now, out = group.sort_values("piece", ascending=False), _END, []
    for m in group["matrix"]:
        out.append(list(now))
        now = tuple(min(int(m[4 * s + t]) + now[t] for t in range(4)) for s in range(4))
    return pd.DataFrame({"piece": group["piece"], "end": out})


def _starts(group: pd.DataFrame) -> pd.DataFrame:
    """The state in which each of a conversation's pieces is entered."""
    group, now, out = group.sort_values("piece"), 0, []
    for exits in group["exits"]:
        out.append(now)
        now = int(exits[now])
    return pd.DataFrame({"piece": group["piece"], "start": out})


@F.pandas_udf(StructType().add("audit", StringType()).add("cost", LongType()))
def _edits(rows: pd.Series, start: pd.Series, end: pd.Series, last: pd.Series) -> pd.DataFrame:
    found = [_walk(r, int(s), tuple(map(int, e)), bool(z))[:2] for r, s, e, z in zip(rows, start, end, last)]
    return pd.DataFrame(found, columns=["audit", "cost"])


@F.pandas_udf(StringType())
def _lines(roles: pd.Series, texts: pd.Series, audit: pd.Series, start: pd.Series) -> pd.Series:
    """The repaired rows; null if there are none."""

    def of(role, text, edits: str, state: int) -> str | None:
        out, i = [], 0
        for e in edits:
            if e == "I":
                out.append(f"{_NAME[state]}:")
            elif e != "D":
                out.append(f"{role[i] if e == 'K' else _NAME[state]}:{text[i]}")
            if e != "D":
                state = _AFTER[state][role[i][0]] if e == "K" else _THEN[state]
            i += e != "I"
        return "\n".join(out) if out else None

    return pd.Series([of(r, t, e, int(s)) for r, t, e, s in zip(roles, texts, audit, start)], dtype=object)


def _streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of conversations whose pieces come one after another."""
    conv, state, begun = None, None, False
    for frame in frames:
        done = []
        for c, text in zip(frame["conv"], frame["text"]):
            if c != conv:
                if conv is not None:
                    done.append((conv, state.hexdigest()))
                conv, state, begun = c, hashlib.sha256(), False
            if text is not None:
                state.update((("\n" if begun else "") + text).encode())
                begun = True
        yield pd.DataFrame(done, columns=["conv", "sha"])
    if conv is not None:
        yield pd.DataFrame([(conv, state.hexdigest())], columns=["conv", "sha"])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that a hash of each row's name decides."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(fate == 4, "user").otherwise(space("role"))
    times = F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return conversations.where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def _ordered(rows: DataFrame) -> DataFrame:
    """rows in order of conversation and turn as a table, with _id rising in that order and the faults of each row alone."""
    n = parts(rows.sparkSession)
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64), F.col("digest"), F.col("_any")]
    keyed = rows.withColumn("digest", digest).withColumn("_any", F.monotonically_increasing_id())  # parts equal rows among ranges
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    faults = keyed.withColumn("blank", end == "").withColumn("truncated", ~end.isin(".", "!", "?"))
    return written(faults.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_any").withColumn("_id", F.monotonically_increasing_id()), "turns")


def _pieces(turns: DataFrame) -> DataFrame:
    """A row for each piece: conv_id, chunk, its letters, its counts, and its place among the conversation's pieces."""
    slim = turns.select("conv_id", "turn", "_id", "digest", "blank", "truncated", F.substring("role", 1, 1).alias("initial"))
    firsts = slim.groupBy("conv_id", "digest").agg(F.min("_id").alias("_id")).select("_id", F.lit(True).alias("first"))
    known = slim.join(firsts, "_id", "left").withColumn("duplicate", ~F.col("blank") & F.col("first").isNull())
    cut = known.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("truncated"))
    row = F.struct("_id", _letter(F.col("initial"), F.col("blank") | F.col("duplicate"), F.col("truncated")).alias("letter"), "initial")
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    groups = cut.groupBy("conv_id", F.shiftright("_id", _PIECE_BITS).alias("chunk")).agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.min("_id").alias("piece"), count("blank"), count("duplicate"), count("truncated"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"))
    initials = F.transform("rows", lambda x: x["initial"])
    pairs = F.transform(F.sequence(F.lit(1), F.size("rows")), lambda i: F.array_join(F.slice(initials, i, 2), ""))
    legal = F.array(*map(F.lit, ("su", "ua", "au")))
    bad = F.size(F.filter(F.slice(pairs, 1, F.size("rows") - 1), lambda p: ~F.array_contains(legal, p))).cast("long")
    flat = groups.select("*", F.array_join(F.transform("rows", lambda x: x["letter"]), "").alias("letters"), bad.alias("bad"),
                         F.element_at(initials, 1).alias("head"), F.element_at(initials, -1).alias("tail")).drop("rows")
    whole, along = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("piece")
    joint = F.concat(F.lag("tail").over(along), F.col("head"))
    seam = F.coalesce((~joint.isin("su", "ua", "au")).cast("long"), F.lit(0))
    shared = F.coalesce((F.lag("high").over(along) == F.col("low")).cast("long"), F.lit(0))
    return flat.select("conv_id", "chunk", "piece", "letters", "blank", "duplicate", "truncated", "low", "high", (F.col("turns") - shared).alias("turns"),
                       (F.col("bad") + seam).alias("illegal"), F.min("piece").over(whole).alias("conv"), (F.max("piece").over(whole) == F.col("piece")).alias("last"), F.count("*").over(whole).alias("n"))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id and, of its rows, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    reach_workers(rows.sparkSession)
    turns = _ordered(rows)
    pieces = written(_pieces(turns), "pieces")
    end = F.array(*(F.lit(x).cast("long") for x in _END))
    many = pieces.where("n > 1").select("conv", "piece", "letters")
    ends = written(many.withColumn("matrix", _matrix("letters")).groupBy("conv").applyInPandas(_ends, "piece long, end array<long>"), "ends")
    exits = many.join(ends, "piece").select("conv", "piece", _exits("letters", "end").alias("exits"))
    starts = ends.join(exits.groupBy("conv").applyInPandas(_starts, "piece long, start long"), "piece")
    known = pieces.join(starts, "piece", "left").withColumn("start", F.coalesce("start", F.lit(0))).withColumn("end", F.coalesce("end", end))
    plan = written(known.withColumn("e", _edits("letters", "start", "end", "last")).select("*", "e.*").drop("e", "letters", "end"), "plan")
    discard(ends, pieces)

    chunk = F.shiftright("_id", _PIECE_BITS).alias("chunk")
    fields = ["audit", "start", "conv", "piece", "n"]
    of_rows = turns.select("conv_id", chunk, F.struct("_id", "role", "text").alias("row"), F.lit(None).cast(plan.select(F.struct(*fields)).schema[0].dataType).alias("plan"))
    of_plan = plan.select("conv_id", "chunk", F.lit(None).cast(of_rows.schema["row"].dataType).alias("row"), F.struct(*fields).alias("plan"))
    both = of_rows.unionByName(of_plan).groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("row")).alias("rows"), F.max("plan").alias("plan"))
    field = lambda name: F.transform("rows", lambda x: x[name])
    told = both.select("plan.*", _lines(field("role"), field("text"), F.col("plan.audit"), F.col("plan.start")).alias("text"))
    alone = F.when(F.col("n") == 1, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    told = written(told.select("conv", "piece", "n", alone.alias("sha"), F.when(F.col("n") > 1, F.col("text")).alias("text")), "told")
    chained = told.where("n > 1").select("conv", "piece", "text").repartition("conv").sortWithinPartitions("conv", "piece").mapInPandas(_streamed, "conv long, sha string")
    shas = told.where("n = 1").select("conv", "sha").unionByName(chained)

    total = lambda c: F.sum(c).alias(c)
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "")
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps")
    sums = plan.groupBy("conv_id", "conv").agg(gaps, total("blank"), total("duplicate"), total("truncated"), total("illegal"), total("cost"), audit.alias("audit"))
    return sums.join(shas, "conv").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def audited(conversations: DataFrame) -> DataFrame:
    """repair() of the damaged rows, with a row for every conv_id of the conversations themselves."""
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "_conv")
    ids = conversations.select("conv_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
