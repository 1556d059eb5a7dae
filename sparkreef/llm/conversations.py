"""Conversation structure repair: cheapest edits that make roles alternate, by a fold over sorted turns.

Window functions mark each turn's fault, a conversation's turns are gathered as sorted structs, and
``aggregate()`` folds them, carrying one (cost, audit) struct for each of four states: nothing kept
yet, after the system turn, after a user's, after an assistant's. Equal costs fall to the audit that
sorts first, as structs compare field by field. All of it stays in Spark's JVM, with one shuffle by
conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an edit costs; an undeleted truncated turn adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: More than any conversation's edits cost.
NEVER = 10**12

#: Faults, in the order in which equal turns stand: a first occurrence comes before its repetition.
SOUND, CUT_OFF, DUPLICATE, BLANK = range(4)

WORD_CHARACTER = r"[^\x20\x09-\x0D]"

#: The fold's audit tells apart whom an edit names: I and J insert, R and S rerole to, a user and an
#: assistant. The state fixes which, so that audits sort like those with I and R alone.
_EDIT = {"user": {"insert": "I", "rerole": "R"}, "assistant": {"insert": "J", "rerole": "S"}}


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``turns`` with known faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a turn, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a
    user's. Nulls, in the key as well as in role and text, are one space. Other columns are left out.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("fault"),
    ).where("fault <> 0")
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fault == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _marked(turns: DataFrame) -> DataFrame:
    """Each turn's first fault, and whether its role doesn't follow from the one before."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.repartition("conv_id")  # both windows and the groups are served by this one shuffle
    in_order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    said = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    last = F.regexp_extract("text", rf"({WORD_CHARACTER})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(said > 1, DUPLICATE).when(~last.rlike("[.!?]"), CUT_OFF).otherwise(SOUND)
    before = F.lag(F.substring("role", 1, 1)).over(Window.partitionBy("conv_id").orderBy(*in_order))
    pair = F.concat(before, F.substring("role", 1, 1))
    return rows.withColumn("fault", fault).withColumn("illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)))


def _after(state: Column, cost, edits) -> Column:
    """``state`` with further edits at a cost."""
    cost, edits = (x if isinstance(x, Column) else F.lit(x) for x in (cost, edits))
    return F.struct((state["cost"] + cost).cast("long").alias("cost"), F.concat(state["audit"], edits).alias("audit"))


def _step(states: Column, turn: Column) -> Column:
    """The four states behind one more turn.

    An insertion stands right before the turn that needs it, behind all deletions before that turn,
    as D sorts before I; one is enough, as two leave the state as it was.
    """
    nothing, system, user, assistant = (states[x] for x in ("nothing", "system", "user", "assistant"))
    kept = F.when(turn["fault"] >= DUPLICATE, NEVER).otherwise(F.when(turn["fault"] == CUT_OFF, TRUNCATED).otherwise(0))
    initial = F.substring(turn["role"], 1, 1)

    def said(state: Column, role: str, inserted: str | None = None) -> Column:
        own = initial == role[0]
        first, extra = (_EDIT[inserted]["insert"], INSERT) if inserted else ("", 0)
        letter = F.when(own, "K").otherwise(_EDIT[role]["rerole"])
        return _after(state, kept + F.when(own, extra).otherwise(extra + REROLE), F.concat(F.lit(first), letter))

    def deleted(state: Column) -> Column:
        return _after(state, DELETE, "D")

    opened = _after(nothing, kept + F.when(initial == "s", 0).otherwise(NEVER), "K")
    return F.struct(
        deleted(nothing).alias("nothing"),
        F.least(deleted(system), opened).alias("system"),
        F.least(
            deleted(user), said(nothing, "user"), said(system, "user"), said(assistant, "user"), said(user, "user", "assistant")
        ).alias("user"),
        F.least(
            deleted(assistant), said(user, "assistant"), *(said(x, "assistant", "user") for x in (nothing, system, assistant))
        ).alias("assistant"),
    )


def _folded(turns: Column) -> Column:
    """(cost, audit) of the cheapest edits of sorted turns, with the fold's own letters."""
    unmet = F.struct(F.lit(NEVER).cast("long").alias("cost"), F.lit("").alias("audit"))
    start = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    states = F.struct(start.alias("nothing"), *(unmet.alias(x) for x in ("system", "user", "assistant")))

    def end(folded: Column) -> Column:
        return F.least(
            folded["nothing"], folded["assistant"], _after(folded["user"], INSERT, "J"), _after(folded["system"], 2 * INSERT, "IJ")
        )

    return F.aggregate(turns, states, _step, end)


def _repaired(turns: Column, audit: Column) -> Column:
    """The ``role:text`` of what the edits leave, in order."""
    edits = F.regexp_extract_all(audit, F.lit("[IJ]*[DKRS]|[IJ]+$"), F.lit(0))

    def lines(turn: Column, edit: Column) -> Column:
        added = F.transform(
            F.array(F.substring(edit, 1, 1), F.substring(edit, 2, 1)), lambda c: F.when(c == "I", "user:").when(c == "J", "assistant:")
        )
        own = F.substring(edit, -1, 1)
        role = F.when(own == "K", turn["role"]).when(own == "R", "user").when(own == "S", "assistant")
        return F.filter(F.concat(added, F.array(F.concat(role, F.lit(":"), turn["text"]))), lambda x: x.isNotNull())

    return F.flatten(F.zip_with(turns, edits, lines))


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of ``turns`` (conv_id, turn, role, text): its faults and cheapest repair.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, and repaired, the array
    of ``role:text`` that the edits leave. Turns are in order of turn (nulls first), then role and
    text; null roles and texts are one space. Edits keep a turn (K), give it to the user or the
    assistant (R), delete it (D, required if blank or a repetition) or insert an empty one (I), so
    that role initials are ``(s?(ua)+)?``; a role without an initial of s, u or a can't be kept.
    Rows that repeat are repetitions, null ids one conversation; other columns are ignored, whatever
    their names; no rows give none. A conversation's turns and its repair have to fit a row.
    """
    marked = _marked(turns)
    count = lambda fault: F.sum(F.when(F.col("fault") == fault, 1).otherwise(0)).cast("long")
    at = F.col("turn").cast("decimal(20,0)")
    grouped = marked.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "fault"))).alias("turns"),
        count(BLANK).alias("blank"),
        count(DUPLICATE).alias("duplicate"),
        count(CUT_OFF).alias("truncated"),
        F.sum(F.col("illegal").cast("long")).alias("illegal"),
        F.max(at).alias("last"),
        F.min(at).alias("first"),
    )
    distinct = F.size(F.array_distinct(F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull())))
    gaps = F.coalesce(F.col("last") - F.col("first") + 1 - distinct, F.lit(0))
    folded = grouped.select("*", gaps.try_cast("long").alias("gaps"), _folded(F.col("turns")).alias("best"))
    return folded.select(
        "conv_id",
        "gaps",
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        F.col("best.cost").alias("cost"),
        F.translate("best.audit", "JS", "IR").alias("audit"),
        _repaired(F.col("turns"), F.col("best.audit")).alias("repaired"),
    )


def with_every(mended: DataFrame, ids: DataFrame, **without: Column) -> DataFrame:
    """``mended`` with a row for each conv_id of ``ids``; where no turn is left, ``without`` or else zero and empty."""
    every = ids.select(F.col("conv_id").alias("every_id")).distinct()
    none = {"bigint": F.lit(0).cast("long"), "string": F.lit(""), "array<string>": F.array().cast("array<string>")}
    columns = [(name, without.get(name, none.get(kind))) for name, kind in mended.dtypes if name != "conv_id"]
    joined = every.join(mended.withColumn("turns_left", F.lit(True)), F.col("every_id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(
        F.col("every_id").alias("conv_id"), *(F.when(F.col("turns_left"), F.col(name)).otherwise(value).alias(name) for name, value in columns)
    )
