"""Checklists: progress, key dates, localised fields; and consistency checks of translations.

Null texts and missing fields count as empty, null dates as none; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import placeholders


def progress(steps: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, completed, percent: which of ``steps`` (step) are in ``done`` (keys, step), for each of its keys."""
    total = steps.agg(F.count("*").alias("total"))
    hit = done.select(*keys, "step").distinct().join(F.broadcast(steps.select("step", F.lit(1).alias("hit"))), "step", "left")
    counts = hit.groupBy(*keys).agg(F.count("hit").alias("completed")).join(F.broadcast(total))
    percent = F.when(F.col("total") > 0, F.round(100 * F.col("completed") / F.col("total"))).otherwise(0.0)
    return counts.select(*keys, "total", "completed", percent.cast("int").alias("percent"))


def progress_lists(steps: DataFrame, done: DataFrame, every: DataFrame, keys: list[str]) -> DataFrame:
    """keys, flow_id, total, completed, remaining (steps in their order), percent for each row of ``every`` (keys) and each flow.

    ``steps``: flow_id, step_ord, step, a small constant table; ``done``: keys, flow_id, step, repeated rows count once,
    steps that the flow hasn't got don't count. A key without any step has the flow at 0 %.
    """
    flows = steps.groupBy("flow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_ord", "step"))), lambda x: x["step"]).alias("steps"))
    have = done.groupBy(*keys, "flow_id").agg(F.collect_set("step").alias("have"))
    both = every.select(*keys).distinct().join(F.broadcast(flows)).join(have, [*keys, "flow_id"], "left")
    done_now = lambda x: F.array_contains(F.coalesce("have", F.array().cast("array<string>")), x)
    lists = both.select(*keys, "flow_id", F.size("steps").alias("total"), F.filter("steps", done_now).alias("completed"), F.filter("steps", lambda x: ~done_now(x)).alias("remaining"))
    percent = F.when(F.col("total") > 0, F.round(100 * F.size("completed") / F.col("total"))).otherwise(0.0)
    return lists.withColumn("percent", percent.cast("int"))


def flow_summary(title: Column, due: Column, dates: Column, labels: dict[str, str]) -> Column:
    """The report of a checklist over the columns total, completed, remaining and percent; ``dates``: array of (id, iso)."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(labels["none"])
    days = F.array_join(F.transform(dates, lambda d: F.concat(d["id"], F.lit(": "), d["iso"])), "; ")
    return F.concat_ws(
        "\n",
        F.format_string(f"%s: %d/%d {labels['complete']} (%d%%).", title, F.size("completed"), F.col("total"), F.col("percent")),
        F.concat(F.lit(f"{labels['due']}: "), F.coalesce(F.nullif(due, F.lit("")), F.lit(labels["not_set"])), F.lit(".")),
        F.concat(F.lit(f"{labels['completed']}: "), listed("completed"), F.lit(".")),
        F.concat(F.lit(f"{labels['remaining']}: "), listed("remaining"), F.lit(".")),
        F.concat(F.lit(f"{labels['key_dates']}: "), F.when(days != "", days).otherwise(labels["not_calculated"]), F.lit(".")),
    )


def localized_values(values: Column, base: str) -> Column:
    """The texts of a field in all languages: of the keys ``base`` and ``base_*`` of a map."""
    return F.map_values(F.map_filter(values, lambda k, _: (k == base) | k.startswith(f"{base}_")))


def translated(strings: DataFrame, wanted: DataFrame, source: str = "en") -> DataFrame:
    """lang, key_path, text of ``wanted`` (lang, key_path): in that language, else in the source language, else the key itself."""
    own = strings.select("lang", "key_path", F.col("value").alias("_own"))
    base = strings.where(F.col("lang") == source).select("key_path", F.col("value").alias("_base"))
    both = wanted.join(own, ["lang", "key_path"], "left").join(base, "key_path", "left")
    return both.select("lang", "key_path", F.coalesce("_own", "_base", "key_path").alias("text"))


def read_states(rows: DataFrame) -> DataFrame:
    """flow_key, notice_date, due_date, done (map) of stored ``rows`` (flow_key, json); what is no JSON object counts as empty."""
    kind = "struct<noticeDate:string,dueDate:string,done:map<string,boolean>>"
    s = rows.withColumn("_s", F.from_json("json", kind, {"mode": "PERMISSIVE"}))
    none = F.create_map().cast("map<string,boolean>")
    return s.select("flow_key", F.coalesce("_s.noticeDate", F.lit("")).alias("notice_date"), F.coalesce("_s.dueDate", F.lit("")).alias("due_date"), F.coalesce("_s.done", none).alias("done"))


def stored_states(states: DataFrame) -> DataFrame:
    """The inverse of ``read_states``."""
    one = F.struct(F.col("notice_date").alias("noticeDate"), F.col("due_date").alias("dueDate"), "done")
    return states.select("flow_key", F.to_json(one).alias("json"))


def valid_date(text: Column) -> Column:
    """A date written as YYYY-MM-DD that exists; else null."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def key_dates(notice: Column) -> Column:
    """array of (id, iso): 30 days before, 7 days before, the day itself; empty without a date."""
    iso = lambda days: F.date_format(F.date_sub(notice, days), "yyyy-MM-dd")
    rows = F.array(*[F.struct(F.lit(name).alias("id"), iso(days).alias("iso")) for name, days in (("reminder_30", 30), ("reminder_7", 7), ("target_date", 0))])
    return F.when(notice.isNotNull(), rows).otherwise(F.array().cast("array<struct<id:string,iso:string>>"))


def pick_localized(values: Column, base: str, language: str) -> Column:
    """Of a map of fields the one in the language, else in English, else the bare one, else empty."""
    found = [F.nullif(F.try_element_at(values, F.lit(k)), F.lit("")) for k in (f"{base}_{language}", f"{base}_en", base)]
    return F.coalesce(*found, F.lit(""))


def key_parity(strings: DataFrame, source: str = "en") -> DataFrame:
    """lang, key_path, problem of ``strings`` (lang, key_path, value): missing, extra, or with other placeholders than the source."""
    base = strings.where(F.col("lang") == source).select("key_path", F.col("value").alias("_base"))
    langs = strings.where(F.col("lang") != source).select("lang").distinct()
    wanted = base.join(F.broadcast(langs))
    both = wanted.join(strings.where(F.col("lang") != source), ["lang", "key_path"], "full_outer")
    problem = F.when(F.col("value").isNull(), "missing").when(F.col("_base").isNull(), "extra").when(placeholders(F.col("value")) != placeholders(F.col("_base")), "placeholders")
    return both.withColumn("problem", problem).where("problem is not null").select("lang", "key_path", "problem")


def flat_keys(tree: dict, above: str = "") -> list[tuple[str, str]]:
    """Dotted paths and values of a nested catalogue; lists are leaves."""
    return [x for k, v in tree.items() for x in (flat_keys(v, f"{above}{k}.") if isinstance(v, dict) else [(above + k, str(v))])]


def incomplete_fields(items: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """item_id, lang, field of ``items`` (item_id, fields: map) whose ``*_en`` field has no text in a language."""
    one = items.select("item_id", "fields", F.explode("fields").alias("name", "text")).where(F.col("name").endswith("_en"))
    base = F.regexp_replace("name", "_en$", "")
    each = one.select("item_id", "fields", base.alias("field"), F.explode(F.array(*map(F.lit, languages))).alias("lang"))
    return each.where(F.trim(F.coalesce(F.try_element_at("fields", F.concat("field", F.lit("_"), "lang")), F.lit(""))) == "").select("item_id", "lang", "field")
