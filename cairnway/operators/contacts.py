"""A per-user contact store over immutable tables: constraint checks, patches and the deletion state machine as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

C = F.col
#: Labels that a user may hold once among live contacts, and columns that a patch may change.
UNIQUE = ("Home", "Work")
EDITABLE = ("label", "name", "call_sign", "phone", "email", "category", "notes", "lat", "lon", "osm_type", "osm_id", "address", "show_proximity")


def live(contacts: DataFrame) -> DataFrame:
    return contacts.where(C("deleted_at").isNull())


def matches(text: str, columns: list[str]) -> Column:
    """Substring in any of the columns, ASCII case aside; wildcards in the text are plain characters."""
    plain = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return reduce(lambda a, b: a | b, [F.coalesce(C(c).ilike(f"%{plain}%"), F.lit(False)) for c in columns])


def _taken(contacts: DataFrame) -> DataFrame:
    return live(contacts).where(C("label").isin(*UNIQUE)).select("user_id", "label").distinct()


def listed(contacts: DataFrame, users: DataFrame, category: str | None = None, search: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """Live contacts of the users asked for (user_id), of a category, that any of the searches (text, columns) finds; by label."""
    rows = live(contacts).join(users.select("user_id").distinct(), "user_id", "left_semi")
    rows = rows if category is None else rows.where(C("category") == category)
    return (rows.where(reduce(lambda a, b: a | b, [matches(t, c) for t, c in search])) if search else rows).orderBy("user_id", "label", "id")


def checked_inserts(contacts: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ``error``: conflict where the user holds the unique label already, or an earlier row of the batch takes it."""
    nth = F.when(C("label").isin(*UNIQUE), F.row_number().over(Window.partitionBy("user_id", "label").orderBy("id"))).otherwise(1)
    out = new.withColumn("nth", nth).join(_taken(contacts).withColumn("taken", F.lit(True)), ["user_id", "label"], "left")
    return out.withColumn("error", F.when(F.coalesce(C("taken"), F.lit(False)) | (C("nth") > 1), "conflict")).drop("taken", "nth")


def patched(contacts: DataFrame, patch: DataFrame, columns: list[str], now: str) -> DataFrame:
    """Apply ``patch`` (id, columns) to live rows; other than editable columns are refused."""
    if bad := set(columns) - set(EDITABLE):
        raise ValueError(f"not editable: {sorted(bad)}")
    new = patch.select("id", F.lit(True).alias("__hit"), *[C(c).alias(f"__{c}") for c in columns])
    out = contacts.join(new, "id", "left")
    hit = F.coalesce(C("__hit"), F.lit(False)) & C("deleted_at").isNull()
    kept = [c for c in contacts.columns if c != "updated_at"]
    before = C("updated_at") if "updated_at" in contacts.columns else F.lit(None).cast("string")
    return out.select(*[F.when(hit, F.coalesce(f"__{c}", c)).otherwise(C(c)).alias(c) if c in columns else C(c) for c in kept], F.when(hit, F.lit(now)).otherwise(before).alias("updated_at"))


def apply_actions(contacts: DataFrame, actions: DataFrame, now: str) -> DataFrame:
    """delete, restore and purge by id; only deleted rows are restored or purged.

    ``restore_as`` in ``actions`` (optional) is the label to restore under.  A restored unique label may clash neither with
    a live one nor with one that a smaller id restores in the same batch.
    """
    out = contacts.join(actions, "id", "left")
    back = F.coalesce((C("act") == "restore") & C("deleted_at").isNotNull(), F.lit(False))
    if "restore_as" in actions.columns:
        out = out.withColumn("label", F.when(back, F.coalesce("restore_as", "label")).otherwise(C("label"))).withColumn("back", back)
    else:
        out = out.withColumn("back", back)
    nth = F.row_number().over(Window.partitionBy("user_id", "label", "back").orderBy("id"))
    out = out.withColumn("nth", F.when(C("back") & C("label").isin(*UNIQUE), nth).otherwise(1))
    out = out.join(_taken(contacts).withColumn("taken", F.lit(True)), ["user_id", "label"], "left")
    clash = C("back") & (F.coalesce(C("taken"), F.lit(False)) | (C("nth") > 1))
    out = out.where(~F.coalesce((C("act") == "purge") & C("deleted_at").isNotNull(), F.lit(False)))
    state = F.when(C("act") == "delete", F.coalesce("deleted_at", F.lit(now))).when((C("act") == "restore") & ~clash, F.lit(None).cast("string")).otherwise(C("deleted_at"))
    return out.withColumn("error", F.when(clash, "conflict")).withColumn("deleted_at", state).drop("act", "taken", "back", "nth", "restore_as")
