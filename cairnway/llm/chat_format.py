"""Operator 1 - chat formatting with a grammar round trip (DataFrame functions only).

Grammar of a rendered conversation::

    conversation := turn*
    turn         := "<|im_start|>" role ["<|esc|>"] LF body "<|im_end|>" LF

The parser is deterministic: it cuts at every ``<|im_start|>``, takes the header up to the first LF and the body up to the
first ``<|im_end|>``.  A turn is first rendered as it is, parsed again and compared with its source.  Turns that do not come
back identical are rendered once more with role and body escaped (backslash doubled, ``<|`` broken up, LF of a role
spelled out) and a ``<|esc|>`` mark in the header; an escaped turn holds no control string, so the second round always ends
in identity.  The rendered conversation is then parsed as a whole, and ``round_trip`` says whether every turn's digest
still equals that of its source.

Edge cases: null text or role counts as empty; a conversation's turns are ordered by (turn, role, rendered text),
so ties and repeated rows have one order and are all kept; null ``conv_id`` is a conversation of its own; an empty table gives an empty
result; further columns are ignored.  A conversation is one row: its rendered text has to fit into one task's memory, whatever
the number of conversations; its turns' texts may be of any length up to that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, ESC = "<|im_start|>", "<|im_end|>", "<|esc|>"


def escape(text: Column) -> Column:
    """Reversible: afterwards neither ``<|`` nor a line feed of a role can be read as control."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`: drop the backslash before each escaped character."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def render_turn(role: Column, text: Column, escaped: bool) -> Column:
    head = F.concat(escape_role(role), F.lit(ESC)) if escaped else role
    return F.concat(F.lit(START), head, F.lit("\n"), escape(text) if escaped else text, F.lit(END + "\n"))


def parse_segment(segment: Column) -> Column:
    """What follows one ``<|im_start|>`` -> struct(role, text, body, escaped, head_chars, whole)."""
    head = F.substring_index(segment, "\n", 1)
    rest = F.substr(segment, F.length(head) + 2)
    body = F.substring_index(rest, END, 1)
    escaped = F.endswith(head, F.lit(ESC))
    name = F.when(escaped, unescape_role(F.left(head, F.length(head) - len(ESC)))).otherwise(head)
    return F.struct(
        name.alias("role"),
        F.when(escaped, unescape(body)).otherwise(body).alias("text"),
        F.length(body).alias("body_chars"),
        F.length(head).alias("head_chars"),
        escaped.alias("escaped"),
        (F.concat(head, F.lit("\n"), body, F.lit(END + "\n")) == segment).alias("whole"),
    )


def parse(formatted: Column) -> Column:
    """A rendered conversation -> array of parsed turns; text before the first turn makes a turn that is not whole."""
    cut = F.split(formatted, r"<\|im_start\|>", -1)
    turns = F.when(F.size(cut) > 1, F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.transform(turns, parse_segment)


def masked(formatted: str, runs: str) -> Column:
    """The texts under the loss mask: cut out of ``formatted`` by the runs' character offsets alone, and unescaped.

    One pass carries the offset along, and cuts are made only where the mask is set.
    """
    step = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,chars:int,escaped:boolean>>").alias("cuts"))

    def walk(state: Column, r: Column) -> Column:
        start = state["at"] + r["before"]
        cut = F.array(F.struct(start.alias("at"), r["chars"].alias("chars"), r["escaped"].alias("escaped")))
        return F.struct((start + r["chars"] + r["after"]).alias("at"), F.when(r["in_loss"], F.concat(state["cuts"], cut)).otherwise(state["cuts"]).alias("cuts"))

    cuts = F.aggregate(F.col(runs), step, walk)["cuts"]
    text = lambda c: F.substr(F.col(formatted), c["at"], c["chars"])
    return F.transform(cuts, lambda c: F.when(c["escaped"], unescape(text(c))).otherwise(text(c)))


def format_conversations(rows: DataFrame, assistant: str = "assistant") -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) -> one row per conversation.

    Columns: conv_id, formatted, turns (array of role and text, parsed back), loss_runs (the loss mask as runs of characters:
    in order over ``formatted``: ``before`` and ``after`` are control, ``chars`` the body, ``in_loss`` whether it counts),
    round_trip.  One shuffle, of the rendered turns by conversation.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    raw = render_turn(F.col("role"), F.col("text"), False)
    back = parse(F.col("raw"))
    same = (F.size(back) == 1) & back[0]["whole"] & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text"))
    clash = F.contains(F.col("text"), F.lit("<|")) | F.contains(F.col("role"), F.lit("<|")) | F.contains(F.col("role"), F.lit("\n"))
    rows = rows.withColumn("raw", F.when(clash, raw))  # without "<|" and LF in the role, the grammar is unambiguous
    shown = F.when(~clash, raw).when(same, F.col("raw")).otherwise(render_turn(F.col("role"), F.col("text"), True))
    turn = F.struct("turn", "role", shown.alias("shown"), F.xxhash64("role", "text").alias("digest"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("source"))
    out = grouped.select("conv_id", F.array_join("source.shown", "").alias("formatted"), F.col("source.digest").alias("digests"))
    out = out.withColumn("parsed", parse(F.col("formatted")))
    digests = F.transform("parsed", lambda t: F.xxhash64(t["role"], t["text"]))
    runs = F.transform(
        "parsed",
        lambda t: F.struct(
            (t["head_chars"] + len(START) + 1).alias("before"), t["body_chars"].alias("chars"), F.lit(len(END) + 1).alias("after"), (t["role"] == assistant).alias("in_loss"), t["escaped"].alias("escaped")
        ),
    )
    return out.select(
        "conv_id",
        "formatted",
        F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
        runs.alias("loss_runs"),
        ((digests == F.col("digests")) & F.forall("parsed", lambda t: t["whole"])).alias("round_trip"),
    )
