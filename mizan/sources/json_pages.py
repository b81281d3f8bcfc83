"""JSON pages of a source: detail pages of nested widgets, list pages of rows, records in arrays, read as VARIANT.

A body that is no JSON, or no page of its kind, is kept with readable false; what is inside is read piece by piece, so a
broken row never hides its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of widgets.
GROUP, SINGLE, SCORE, SELECTOR, POST = "GROUP_INFO_ROW", "UNEXPANDABLE_ROW", "SCORE_ROW", "SELECTOR_ROW", "POST_ROW"
MODAL = "$.data.action.payload.modal_page.widget_list"


def said(value: Column, path: str) -> Column:
    """A string at a path of a variant; null for anything else."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def items(df: DataFrame, source: Column, name: str) -> DataFrame:
    """df, once for each item of an array in a variant, with the item as `name` and its place as `name`_pos; rows without
    an array there go."""
    each = df.withColumn("__of", source).filter(F.startswith(F.schema_of_variant("__of"), F.lit("ARRAY")))
    tvf = df.sparkSession.tvf.variant_explode(F.col("__of").outer())
    return each.lateralJoin(tvf.select(F.col("pos").alias(f"{name}_pos"), F.col("value").alias(name))).drop("__of")


def parsed(pages: DataFrame, key: str, body: str, root: str) -> DataFrame:
    """(key, v, readable): readable if the body is an object with an array at root."""
    v = F.try_parse_json(F.col(body))
    some = pages.select(F.col(key).alias("key"), v.alias("v"))
    kind = F.schema_of_variant(F.try_variant_get("v", f"$.{root}", "variant"))
    return some.withColumn("readable", F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False)))


def detail_rows(pages: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, kind, label, text) of every row of detail pages: `labelled` rows of groups and single ones, `scored`
    ones, and `broken` rows that lack a label or a text, or have others than strings.

    Sections hold widgets, a selector's modal page holds widgets too; that is as deep as they go, so each depth is one
    explode. place: section, widget, widget in the modal (-1 outside) and item (-1 for a row of its own). Null, empty and
    unreadable bodies have no rows; see parsed()."""
    sections = items(parsed(pages, key, body, "sections").filter("readable"), F.try_variant_get("v", "$.sections", "variant"), "section").drop("v")
    outer = items(sections, F.try_variant_get("section", "$.widgets", "variant"), "widget")
    inner = items(outer.filter(said(F.col("widget"), "$.widget_type") == SELECTOR), F.try_variant_get("widget", MODAL, "variant"), "modal")
    both = outer.select("key", "section_pos", "widget_pos", F.lit(-1).alias("modal_pos"), "widget").unionByName(inner.select("key", "section_pos", "widget_pos", "modal_pos", F.col("modal").alias("widget")))
    kinded = both.withColumn("type", said(F.col("widget"), "$.widget_type"))
    grouped = items(kinded.filter(F.col("type") == GROUP), F.try_variant_get("widget", "$.data.items", "variant"), "item")
    place = lambda last: F.array("section_pos", "widget_pos", "modal_pos", last)
    row = lambda kind, v, label, text, last: (F.col("key"), place(last).alias("place"), F.lit(kind).alias("kind"), said(v, label).alias("label"), said(v, text).alias("text"))
    one = F.lit(-1)
    every = grouped.select(*row("labelled", F.col("item"), "$.title", "$.value", F.col("item_pos")))
    every = every.unionByName(kinded.filter(F.col("type") == SINGLE).select(*row("labelled", F.col("widget"), "$.data.title", "$.data.value", one)))
    every = every.unionByName(kinded.filter(F.col("type") == SCORE).select(*row("scored", F.col("widget"), "$.data.title", "$.data.descriptive_score", one)))
    broken = F.col("label").isNull() | F.col("text").isNull()
    return every.withColumn("kind", F.when(broken, "broken").otherwise(F.col("kind")))


def list_rows(pages: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, token, title, state) of the post rows of list pages: `own` before the first widget that is no post row,
    `suggested` after it, and `broken` for own rows without a token of letters, digits, - and _."""
    widgets = items(parsed(pages, key, body, "list_widgets").filter("readable"), F.try_variant_get("v", "$.list_widgets", "variant"), "widget")
    typed = widgets.select("key", F.col("widget_pos").alias("pos"), (F.coalesce(said(F.col("widget"), "$.widget_type"), F.lit("")) == POST).alias("post"), said(F.col("widget"), "$.data.token").alias("token"), said(F.col("widget"), "$.data.title").alias("title"))
    end = typed.filter("not post").groupBy("key").agg(F.min("pos").alias("__end"))
    both = typed.filter("post").join(end, "key", "left")
    state = F.when(F.col("pos") > F.col("__end"), "suggested").when(F.coalesce(F.col("token").rlike("^[A-Za-z0-9_-]{4,}$"), F.lit(False)), "own").otherwise("broken")
    return both.select("key", "pos", "token", "title", state.alias("state"))


def found_values(pages: DataFrame, key: str, body: str, outer: str, inner: str, field: str) -> DataFrame:
    """(key, value): the strings at `field` of the items of array `inner` of the items of array `outer`."""
    first = items(parsed(pages, key, body, outer).filter("readable"), F.try_variant_get("v", f"$.{outer}", "variant"), "a").drop("v")
    second = items(first, F.try_variant_get("a", f"$.{inner}", "variant"), "b")
    return second.select("key", said(F.col("b"), f"$.{field}").alias("value")).filter("value is not null")


def records(rows: DataFrame, key: str, body: str, fields: str) -> DataFrame:
    """(key, fields...): one row for each object of a JSON array, by a DDL of its fields; a field that is missing or of
    another kind is null. Bodies that are no array have no rows."""
    parsed_rows = rows.select(F.col(key).alias("key"), F.from_json(body, f"array<struct<{fields}>>", {"mode": "PERMISSIVE"}).alias("r"))
    return parsed_rows.select("key", F.inline("r"))
