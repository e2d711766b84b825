"""Operator 13 - conversation structure repair by a fold in Spark SQL (DataFrame functions only).

A conversation's turns should be an optional system turn, then user and assistant in turns, ending with the assistant.  Each
turn is kept (free), given another role (1) or deleted (2), and empty turns may be put in anywhere (5); blank turns and repeats
have to go, and a truncated turn that stays costs 5 more.  The cheapest edits are found, of equally cheap ones those whose
letters (D, I, K, R: delete, insert, keep, re-role) come first.

Fault flags come from windows: a turn is a duplicate if its role and text were seen before, and illegal if its role may not
follow the one before it.  The turns of a conversation are collected and sorted, and ``aggregate`` carries four (cost, audit)
structs through them, the cheapest way to have repaired the turns so far and to stand at the start, after the system turn, after a
user's or after an assistant's; ``least`` picks among ways that end alike.  Two audits of one cost that end alike are never
the beginning of one another, so what comes first stays first whatever is appended.

One exchange, by conversation: the windows and the collecting share it.  A conversation is one row, as its digest needs all its
texts; in a long one audits would be copied at each turn, so turns are folded in slices of SLICE, those after the first from each
of the four standings, and the slices' results are chained.  That changes no result and keeps copying down to a slice.

Edge cases: a null role or text is a single space; turns are taken in order of turn (null first), role and text; rows that repeat
in full are turns each, all but one of them duplicates; roles count by their first character, and a turn whose role begins with
none of s, u, a can only be deleted or re-roled; null conv_ids are one conversation; a conversation without rows that take part has
zeros, an empty audit and the digest of nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fingerprints import bind

SLICE = 256
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The standings, in the order in which structs hold them.
STANDINGS = ("start", "system", "user", "assistant")
NEVER = 1 << 40


def text_or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn``: ``times`` is 0 for a dropped row and 2 for a repeated one."""
    kind = F.crc32(F.concat(text_or_space("conv_id"), F.lit(":"), text_or_space("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", text_or_space("role").alias("role"), text_or_space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))


def flagged(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation, with ``fault`` (blank, duplicate, truncated or null) and ``illegal``; rows taken 0 times have neither."""
    there = rows.repartition("conv_id").select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("times") > 1, F.sequence(F.lit(1), "times")).otherwise(F.array("times"))).alias("nth"))
    there = there.withColumn("there", F.col("nth") > 0)
    same = Window.partitionBy("conv_id", "there", "role", "text").orderBy("turn", "nth")
    order = Window.partitionBy("conv_id", "there").orderBy("turn", "role", "text", "nth")
    initial = F.left("role", F.lit(1))
    inked = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    out = there.withColumn("copy", F.row_number().over(same)).withColumn("before", F.lag(initial).over(order))
    fault = F.when(inked == "", "blank").when(F.col("copy") > 1, "duplicate").when(~F.right(inked, F.lit(1)).isin(".", "!", "?"), "truncated")
    follows = F.concat("before", initial).isin("su", "ua", "au")
    return out.select("conv_id", "turn", "role", "text", "copy", "there", fault.alias("fault"), (F.col("before").isNotNull() & ~follows).alias("illegal"))


def then(way: Column, cost, letters: Column) -> Column:
    return F.struct((way["cost"] + cost).alias("cost"), F.concat(way["audit"], letters).alias("audit"))


def standings(*ways: Column) -> Column:
    return F.struct(*[w.alias(n) for w, n in zip(ways, STANDINGS, strict=True)])


def only(at: str) -> Column:
    """The four structs of someone who stands at one place, free of charge."""
    return standings(*[F.struct(F.lit(0 if n == at else NEVER).cast("long").alias("cost"), F.lit("").alias("audit")) for n in STANDINGS])


def with_inserts(s: Column) -> Column:
    """Empty turns put in: at most two of them are ever needed to stand anywhere."""
    user = F.least(s["user"], then(s["start"], INSERT, F.lit("I")), then(s["system"], INSERT, F.lit("I")), then(s["assistant"], INSERT, F.lit("I")))
    return bind(user, lambda u: standings(s["start"], s["system"], u, F.least(s["assistant"], then(u, INSERT, F.lit("I")))))


def step(s: Column, turn: Column) -> Column:
    """One turn: deleted, or kept or re-roled where that is allowed; ``s`` has had its inserts."""
    may_stay = ~F.coalesce(turn["fault"].isin("blank", "duplicate"), F.lit(False))
    extra = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)

    def one(ready: Column) -> Column:
        # A way that is not allowed is null, which ``least`` skips.
        stay = lambda way, right: F.when(may_stay, F.when(turn["initial"] == right, then(way, extra, F.lit("K"))).otherwise(then(way, extra + REROLE, F.lit("R"))))
        system = F.when(may_stay & (turn["initial"] == "s"), then(s["start"], extra, F.lit("K")))
        return standings(
            then(s["start"], DELETE, F.lit("D")),
            F.least(then(s["system"], DELETE, F.lit("D")), system),
            F.least(then(s["user"], DELETE, F.lit("D")), stay(ready, "u")),
            F.least(then(s["assistant"], DELETE, F.lit("D")), stay(s["user"], "a")),
        )

    return bind(F.least(s["start"], s["system"], s["assistant"]), lambda ready: bind(one(ready), with_inserts))


def fold(turns: Column, start: Column) -> Column:
    return F.aggregate(turns, start, step)


def repaired_by(turns: Column, size: int = SLICE) -> Column:
    """(cost, audit) of the cheapest repair of an array of structs with ``initial`` and ``fault``."""
    later = F.filter(F.sequence(F.lit(0), F.floor(F.greatest(F.size(turns) - 1, F.lit(0)) / size).cast("int")), lambda i: i > 0)
    first = fold(F.slice(turns, 1, size), with_inserts(only("start")))
    # Inserts before a slice have been made by the slice before it.
    each = F.transform(later, lambda i: bind(F.slice(turns, i * size + 1, F.lit(size)), lambda part: F.array(*[fold(part, only(n)) for n in STANDINGS])))

    def chained(s: Column, ways: Column) -> Column:
        reach = lambda end: F.least(*[then(s[n], ways[k][end]["cost"], ways[k][end]["audit"]) for k, n in enumerate(STANDINGS)])
        return standings(*[reach(n) for n in STANDINGS])

    return bind(F.aggregate(each, first, chained), lambda s: F.least(s["start"], s["assistant"]))


def edited(turns: Column, audit: Column) -> Column:
    """array<struct<role, text>>: the turns after the edits that ``audit`` spells."""
    each = F.filter(F.regexp_extract_all(audit, F.lit("I*[DKR]|I+$"), F.lit(0)), lambda t: t != "")
    letters = F.flatten(F.transform(each, lambda t, i: F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.struct(c.alias("edit"), i.alias("at")))))

    def built(kept: Column) -> Column:
        alone = F.when((F.get(kept, F.lit(0))["edit"] == "K") & F.startswith(F.get(turns, F.get(kept, F.lit(0))["at"])["role"], F.lit("s")), 1).otherwise(0)

        def row(e: Column, k: Column, offset: Column) -> Column:
            role = F.when(e["edit"] == "K", F.get(turns, e["at"])["role"]).when((k - offset) % 2 == 0, "user").otherwise("assistant")
            return F.struct(role.alias("role"), F.when(e["edit"] == "I", "").otherwise(F.get(turns, e["at"])["text"]).alias("text"))

        return bind(alone, lambda offset: F.transform(kept, lambda e, k: row(e, k, offset)))

    return bind(F.filter(letters, lambda c: c["edit"] != "D"), built)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) -> conv_id, gaps, counts of faults, cost, audit and ``repaired``, the edited turns."""
    there = F.col("there")
    turn = F.struct("turn", "role", "text", "copy", F.left("role", F.lit(1)).alias("initial"), "fault")
    faults = [F.count(F.when(there & (F.col("fault") == f), 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    whole = flagged(rows).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(there, turn))).alias("turns"),
        *faults,
        F.count(F.when(there & F.col("illegal"), 1)).alias("illegal"),
    )
    turns = F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull())
    gaps = bind(turns, lambda t: F.when(F.size(t) > 0, F.array_max(t) - F.array_min(t) + 1 - F.size(F.array_distinct(t))).otherwise(0))
    out = whole.select("*", gaps.cast("long").alias("gaps"), bind(F.col("turns"), lambda t: repaired_by(t)).alias("best"))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), "turns").withColumn("repaired", bind(F.col("turns"), lambda t: edited(t, F.col("audit"))))


def digest(turns: Column) -> Column:
    """Lower-case hex of ``role:text`` of the turns, one below the other."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").cast("binary"), 256)

