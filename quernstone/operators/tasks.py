"""Decisions on what a user types or taps: ordered rules over intent scores, links, reminders, consent and error texts.

All are expressions over columns of one row. Null texts count as empty, null scores and flags as none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.operators.checklist import valid_date
from quernstone.operators.intent import exact_score

#: Fixed value: the score from which an intent asks for an action.
ACTION = 4
DATE = r"(^|[^0-9A-Za-z_])([0-9]{4}-[0-9]{2}-[0-9]{2})($|[^0-9A-Za-z_])"
#: Days before the due date that a reminder may have, and those of quick reminders.
REMINDER_DAYS, QUICK_DAYS = (30, 7, 0), (14, 7, 30)


def any_term(query: Column, terms: tuple[str, ...]) -> Column:
    """Whether a normalised query has one of the normalised terms as a phrase."""
    return reduce(lambda a, b: a | b, [exact_score(query, F.lit(t)) > 0 for t in terms], F.lit(False))


def first_intent(query: Column, rules: list[tuple[tuple[str, ...], str]], otherwise: str) -> Column:
    """The value of the first rule one of whose terms is a phrase of the normalised query."""
    return reduce(lambda w, r: w.when(any_term(query, r[0]), r[1]), rules, F.when(F.lit(False), "")).otherwise(otherwise)


def date_in(text: Column) -> Column:
    """The first stretch of a text that is written like a date; null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), DATE, 2), F.lit(""))


def task_action(text: Column, plain: Column, scores: dict[str, Column], flow: Column, step: Column, plus: Column) -> Column:
    """What a typed command asks for; null if it is no command.

    ``scores``: an integer column for each of open, summary, checklist, summary_phrase, question, date_noun, date_verb,
    undo, mark, all, clear, reminder, create, link, resource, privacy, capability; ``flow`` and ``step``: the checklist
    and step that the text names, or null; ``plus``: whether the plan has checklist automation.
    """
    s = {k: F.coalesce(v, F.lit(0)) for k, v in scores.items()}
    wants = {k: v >= ACTION for k, v in s.items()}
    has, said = {k: v >= 1 for k, v in s.items()}, date_in(text)
    named, literal, asks = flow.isNotNull(), said.isNotNull(), has["question"]
    opens = wants["open"] & ~asks
    summary = (named & wants["summary"]) | wants["checklist"] | wants["summary_phrase"]
    asks_date = named & has["date_noun"] & asks & ~literal
    date = named & ((literal & (has["date_verb"] | has["date_noun"])) | (~asks & has["date_verb"] & has["date_noun"]))
    undo, mark = named & wants["undo"], named & wants["mark"] & ~asks
    clear, reminder = named & wants["clear"] & wants["checklist"], named & wants["reminder"] & wants["create"]
    days = F.when(plain.contains("30"), "reminder_30").when(plain.contains("7"), "reminder_7").otherwise("reminder_0")
    every = has["all"] & mark & ~undo
    return (
        F.when((summary | reminder | asks_date | date | undo | mark | clear) & ~F.coalesce(plus, F.lit(False)), "requires_plus")
        .when(opens & named, "open_flow")
        .when(opens & has["link"], "open_link")
        .when(opens & has["resource"], "open_resources")
        .when(opens & has["privacy"], "open_privacy")
        .when(opens & has["reminder"], "open_reminders")
        .when(summary & named, "summary")
        .when(summary, "progress")
        .when(reminder, days)
        .when(asks_date, "date_query")
        .when(date & valid_date(said).isNull(), "need_date")
        .when(date, "save_date")
        .when(every, "mark_all")
        .when((mark | undo) & step.isNull(), "need_step")
        .when(undo, "undo_step")
        .when(mark, "mark_step")
        .when(clear, "clear")
        .when(wants["capability"], "capabilities")
    )


def reminder_time(due: Column, days: Column) -> Column:
    """Nine in the morning so many days before a date; null without a date or with other numbers of days than those allowed."""
    day = F.date_sub(due, days)
    at = F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), F.lit(9), F.lit(0), F.lit(0))
    return F.when(days.isin(list(REMINDER_DAYS)), at)


def reminder_status(due: Column, days: Column, now: Column) -> Column:
    at = reminder_time(due, days)
    return F.when(due.isNull(), "no_date").when(at.isNull(), "no_such_reminder").when(at <= now, "past").otherwise("set")


def quick_reminders(now: Column) -> Column:
    """array of (seconds, at): the reminders that are offered without a date."""
    return F.array(*[F.struct(F.lit(d * 86_400).alias("seconds"), (now + F.expr(f"interval {d} days")).alias("at")) for d in QUICK_DAYS])


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def clamped_day(year: Column, month: Column, day: Column) -> Column:
    """The day, or the month's last one if it has fewer."""
    return F.least(day, days_in_month(year, month))


def year_choices(year: Column, around: int = 10) -> Column:
    return F.sequence(year - around, year + around)


def consent_given(accepted: Column, version: Column, current: int = 1) -> Column:
    return F.coalesce(accepted & (version == current), F.lit(False))


def shared_context(context: Column, plus: Column, share: Column) -> Column:
    """The checklist context, if the plan has it and the user shares it; else empty."""
    return F.when(F.coalesce(plus & share, F.lit(False)), F.coalesce(context, F.lit(""))).otherwise("")


def error_message(status: Column, code: Column, message: Column) -> Column:
    """The key of the text for a failed request, or the message that came with it."""
    return F.when((status == 401) | (code == "invalid_api_key"), "ai.configInvalid").when((status == 429) | (code == "insufficient_quota"), "ai.quotaIssue").when(code == "sensitive_identifier", "privacy.consentSensitive").otherwise(F.coalesce(message, F.lit("ai.requestFailed")))
