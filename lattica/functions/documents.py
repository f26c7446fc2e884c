"""JSON documents: comparison in a form that neither key order nor number spelling changes, and their fields one by one.

A field is a leaf of a document: a scalar, or an empty object or list. Its path has a step for each level, `/key` for
a member and `#0` for a place in a list; `~`, `/` and `#` in a key are written ~0, ~1 and ~2. A document that is a
scalar has one field of the empty path. A missing document, and text that is no JSON, has no fields.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from ..plans.lineage import cut


def canonical(json: Column) -> Column:
    """Keys in order, equal numbers alike. With spark.sql.variant.allowDuplicateKeys, the last of equal keys counts."""
    return F.to_json(F.parse_json(json))


def changed(old: Column, new: Column) -> Column:
    return ~canonical(old).eqNullSafe(canonical(new))


def fields(rows: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """A row for each key of the object in column `json`: key and value as text."""
    return rows.select(*keep, F.explode(F.from_json(F.col(json), "map<string,string>")).alias("key", "value"))


def differences(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field, old_value, new_value of every column that differs between two versions of a row, nulls being values."""
    a, b = old.alias("a"), new.alias("b")
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("string").alias("old_value"), F.col(f"b.{c}").cast("string").alias("new_value")) for c in columns))
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select(F.col(f"a.{key}").alias(key), F.explode(pairs).alias("p")).select(key, "p.*")
    return both.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


_SIGNS = (("~", "~0"), ("/", "~1"), ("#", "~2"))


def escaped(key: Column) -> Column:
    return reduce(lambda k, sign: F.replace(k, F.lit(sign[0]), F.lit(sign[1])), _SIGNS, key)


def unescaped(step: Column) -> Column:
    return reduce(lambda k, sign: F.replace(k, F.lit(sign[1]), F.lit(sign[0])), _SIGNS[::-1], step)


def depth(json: Column) -> Column:
    """Levels of objects and lists in a text of JSON; 0 for a scalar."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(json, r"\\.", ""), r'"[^"]*"', ""), r"[^\[\]{}]", "")
    signs = F.filter(F.split(bare, ""), lambda c: c != "")
    count = lambda s, c: F.struct((s["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("most"))
    return F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), count)["most"]


def leaves(rows: DataFrame, json: str, keep: Sequence[str], levels: int | None = None) -> DataFrame:
    """keep, path, value (JSON text): the fields of each row's document.

    One generator for each level of the deepest document, in one pass; `levels`, if known, spares the look for it.
    """
    if levels is None:
        levels = rows.agg(F.max(depth(F.to_json(F.try_parse_json(json))))).first()[0] or 0
    at = rows.select(*keep, F.struct(F.lit("").alias("path"), F.try_parse_json(json).alias("v")).alias("_at")).filter("_at.v is not null")
    here, v = F.col("_at.path"), F.col("_at.v")
    members = F.transform(F.map_entries(v.try_cast("map<string,variant>")), lambda e: F.struct(F.concat(here, F.lit("/"), escaped(e["key"])).alias("path"), e["value"].alias("v")))
    places = F.transform(v.try_cast("array<variant>"), lambda x, i: F.struct(F.concat(here, F.lit("#"), i.cast("string")).alias("path"), x.alias("v")))
    below = F.coalesce(*(F.when(F.size(x) > 0, x) for x in (members, places)), F.array("_at"))
    for _ in range(levels):
        at = at.select(*keep, F.explode(below).alias("_at"))
    return at.select(*keep, "_at.path", F.coalesce(F.to_json("_at.v"), F.lit("null")).alias("value"))


def _kind(old: Column, new: Column) -> Column:
    return F.when(old.isNull(), "added").when(new.isNull(), "removed").otherwise("changed").alias("change_kind")


def field_changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, path, change_kind (added, removed, changed), old_value, new_value of the fields (leaves) that differ between two states of documents."""
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in (*keys, "path")]
    both = old.alias("o").join(new.alias("n"), same, "full_outer").filter(~F.col("o.value").eqNullSafe(F.col("n.value")))
    return both.select(*(F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in (*keys, "path")), _kind(F.col("o.value"), F.col("n.value")), F.col("o.value").alias("old_value"), F.col("n.value").alias("new_value"))


def history(rows: DataFrame, entity: str, order: Sequence[Column], json: str) -> DataFrame:
    """entity, revision_no, path, change_kind, old_value, new_value: what each version of an entity's document changed in the one before; the first adds all.

    Versions meet by entity and number, so an entity with very many of them is spread like others.
    """
    versions = cut(numbered(rows.select(entity, json, F.struct(*order).alias("_order")).filter(F.col(entity).isNotNull()), [entity], [F.col("_order")], "revision_no").drop("_order"))
    levels = versions.agg(F.max(F.when(F.try_parse_json(json).isNotNull(), depth(F.col(json))))).first()[0] or 0
    keys = [entity, "revision_no"]
    # The two documents of a change meet in one task, so their fields need not be shuffled.
    before = versions.select(entity, (F.col("revision_no") + 1).alias("revision_no"), F.col(json).alias("_old"))
    pairs = versions.select(*keys, F.col(json).alias("_new")).join(before.hint("merge"), keys, "left")
    sides = pairs.select(*keys, F.explode(F.array(*(F.struct(F.lit(new).alias("new"), F.col(c).alias("document")) for new, c in ((False, "_old"), (True, "_new"))))).alias("_side"))
    found = leaves(sides.select(*keys, F.col("_side.new").alias("_is_new"), F.col("_side.document").alias("_document")), "_document", [*keys, "_is_new"], levels)
    both = found.groupBy(*keys, "path").agg(*(F.max(F.when(F.col("_is_new") == new, F.col("value"))).alias(n) for new, n in ((False, "old_value"), (True, "new_value"))))
    return both.filter(~F.col("old_value").eqNullSafe(F.col("new_value"))).select(*keys, "path", _kind(F.col("old_value"), F.col("new_value")), "old_value", "new_value")


def replayed(changes: DataFrame, entity: str, upto: Column | None = None) -> DataFrame:
    """entity, document: the JSON that the changes (as of history) up to a revision lead to; entities whose fields are all gone are left out."""
    some = changes if upto is None else changes.filter(F.col("revision_no") <= upto)
    last = some.groupBy(entity, "path").agg(F.max_by("new_value", "revision_no").alias("value"))
    return rebuilt(last.filter("value is not null"), [entity])


def rebuilt(fields: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep, document: JSON with sorted keys from the fields (keep, path, value) of documents; each document is put together in one task, from its deepest level up."""
    steps = F.regexp_count("path", F.lit("[/#]"))
    rows = cut(fields.select(*keep, "path", "value").repartition(*keep))
    for level in range(rows.agg(F.max(steps)).first()[0] or 0, 0, -1):
        deep = steps == level
        step = F.regexp_extract("path", "[^/#]*$", 0)
        member = F.substring(F.to_json(F.array(unescaped(step))), F.lit(2), F.length(F.to_json(F.array(unescaped(step)))) - 2)
        part = F.struct(F.when(F.col("path").rlike("#[^/#]*$"), step.cast("long")).alias("place"), unescaped(step).alias("key"), member.alias("member"), "value")
        above = rows.withColumn("_own", F.when(~deep, F.col("value"))).withColumn("_part", F.when(deep, part)).withColumn("path", F.when(deep, F.regexp_replace("path", "[/#][^/#]*$", "")).otherwise(F.col("path")))
        own = above.groupBy(*keep, "path").agg(F.max("_own").alias("_own"), F.array_sort(F.collect_list("_part")).alias("_parts"))
        of_list = F.concat(F.lit("["), F.array_join(F.transform("_parts", lambda p: p["value"]), ","), F.lit("]"))
        of_object = F.concat(F.lit("{"), F.array_join(F.transform("_parts", lambda p: F.concat(p["member"], F.lit(":"), p["value"])), ","), F.lit("}"))
        rows = own.select(*keep, "path", F.coalesce("_own", F.when(F.get("_parts", F.lit(0))["place"].isNotNull(), of_list).otherwise(of_object)).alias("value"))
    return rows.select(*keep, F.col("value").alias("document"))
