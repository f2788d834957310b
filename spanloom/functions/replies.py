"""Ranked tool names out of a model's reply, and the tool list that is shown to it."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LIST_KEYS = ("tools", "tool_names", "result", "ranked", "output")
_NAME_KEYS = ("name", "tool_name", "tool")
_FENCE = re.compile(r"\A`*(?:json\b)?\s*(.*?)\s*`*\Z", re.S | re.I)


def _json(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _name(item) -> str | None:
    if isinstance(item, dict):
        item = next((item[k] for k in _NAME_KEYS if isinstance(item.get(k), str) and item[k].strip()), None)
    if isinstance(item, (int, float)) and not isinstance(item, bool):
        return str(item)
    return item if isinstance(item, str) and item.strip() else None


def ranked_names(reply: str | None) -> list[str]:
    """Distinct names in order: of the JSON in the reply, of its first bracketed part, or of all quoted strings."""
    text = (reply or "").strip()
    if text.startswith("```"):
        text = _FENCE.match(text)[1]
    value = _json(text)
    if value is None and 0 <= text.find("[") < text.rfind("]"):
        value = _json(text[text.find("[") : text.rfind("]") + 1])
    if isinstance(value, dict):
        value = next((value[k] for k in _LIST_KEYS if k in value), None)
    names = [n for n in map(_name, value) if n] if isinstance(value, list) else []
    return list(dict.fromkeys(names or re.findall(r'"([^"]+)"', text)))


def ranked_names_of(reply: Column | str) -> Column:
    """The same as a column."""
    return F.pandas_udf(lambda s: s.map(ranked_names), "array<string>")(reply)


def tool_line(name: str, description: str, n_params: Column, width: int = 120) -> Column:
    """``- name: description [n args]``; a long description ends at a word within ``width`` characters."""
    d = F.trim(F.coalesce(F.col(description), F.lit("")))
    head = F.substring(d, 1, width)
    cut = F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)\A(.*) [^ ]*\z", 1), F.lit("")), head)
    return F.concat(F.lit("- "), F.col(name), F.lit(": "), F.when(F.length(d) > width, F.concat(cut, F.lit("…"))).otherwise(d), F.lit(" ["), n_params.cast("string"), F.lit(" args]"))
