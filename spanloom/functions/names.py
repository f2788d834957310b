"""Names of tools, tasks and apps in one spelling, and words of a text; each with the same expression for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = " \t\r\n "
#: Words for an app that is not known, without blanks, ``-`` and ``_`` (fixed values).
UNKNOWN_APPS = ("unknown", "n/a", "na", "none", "null", "nil", "notknown", "notavailable", "unspecified", "undefined", "?")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tool_name(c: Column | str) -> Column:
    """The text before the first ``(``, trimmed, lower-cased; null if that is blank."""
    return F.nullif(F.lower(F.btrim(F.substring_index(_col(c), "(", 1), F.lit(_SPACE))), F.lit(""))


def tool_name_sql(c: str) -> str:
    return f"nullif(lower(trim(split_part({c}, '(', 1), ' \t\r\n ')), '')"


def names_in(actions: Column | str) -> Column:
    """The names of an array of actions or tools, in order, without those that have none."""
    return F.filter(F.transform(_col(actions), tool_name), lambda x: x.isNotNull())


def tools_of_record() -> Column:
    """A record's tools, sorted: the names in ``tools_used``, or, if that is null or empty, those of its actions."""
    own = F.size(F.coalesce(F.col("tools_used"), F.array())) > 0
    actions = F.coalesce(F.col("spans.action"), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(names_in(F.when(own, F.col("tools_used")).otherwise(actions))))


TASK = r"^([\p{L}]+)[^\p{L}\p{N}]*0*([0-9]+)"


def task_key(c: Column | str) -> Column:
    """Prefix word and number of a task id, whatever its case, separators, blanks, leading zeros and closing mark.

    Null and blank give null; an id of another form equals only itself, but for case and outer blanks.
    """
    t = F.lower(F.btrim(_col(c), F.lit(_SPACE)))
    known = F.concat_ws("-", F.regexp_extract(t, TASK, 1), F.regexp_extract(t, TASK, 2))
    return F.when(t.rlike(TASK), known).otherwise(F.nullif(t, F.lit("")))


def task_key_sql(c: str) -> str:
    t = f"lower(trim({c}, ' \t\r\n '))"
    return f"CASE WHEN regexp_matches({t}, '{TASK}') THEN regexp_extract({t}, '{TASK}', 1) || '-' || regexp_extract({t}, '{TASK}', 2) ELSE nullif({t}, '') END"


def app_key(c: Column | str) -> Column:
    """An app's name without case, blanks, ``-`` and ``_``; null if blank or a word for "not known"."""
    t = F.lower(F.regexp_replace(_col(c), "[\\s _-]+", ""))
    return F.when((t != "") & ~t.isin(*UNKNOWN_APPS), t)


def app_key_sql(c: str) -> str:
    t = f"lower(regexp_replace({c}, '[\\s _-]+', '', 'g'))"
    return f"CASE WHEN {t} <> '' AND {t} NOT IN ({', '.join(repr(x) for x in UNKNOWN_APPS)}) THEN {t} END"


def split_key(c: Column | str) -> Column:
    """The name of a split, trimmed, in lower case."""
    return F.lower(F.btrim(_col(c), F.lit(_SPACE)))


def split_key_sql(c: str) -> str:
    return f"lower(trim({c}, ' \t\r\n '))"


def words(c: Column | str) -> Column:
    """The longest runs of letters and digits of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words_sql(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"
