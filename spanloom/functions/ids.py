"""Trace and span ids in one notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = " \t\r\n"


def canonical_id(col: Column | str, n_bytes: int) -> Column:
    """An id as lower-case hexadecimal, however its bytes were written.

    Hexadecimal in any case, with ``0x``, with dashes or blanks around it, and base64 of ``n_bytes`` bytes (plain
    or URL-safe, padded or not) give the same text. Null and blank give null. Text in no such notation is kept,
    trimmed and lower-cased, so that it equals only itself.
    """
    t = F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(_SPACE))
    n_hex, n_b64 = 2 * n_bytes, -(-4 * n_bytes // 3)
    plain = F.lower(t)
    bare = F.replace(F.regexp_replace(plain, "^0x", ""), F.lit("-"), F.lit(""))
    core = F.rtrim(F.translate(t, "-_=", "+/ "))
    b64 = F.lower(F.hex(F.unbase64(F.rpad(core, -(-n_b64 // 4) * 4, "="))))
    hexa = f"^[0-9a-f]{{{n_hex}}}$"
    return (  # unhex gives null for what isn't hexadecimal, at a fraction of a pattern's cost
        F.when((F.length(t) == n_hex) & F.unhex(t).isNotNull(), plain)
        .when(F.length(t) == 0, F.lit(None).cast("string"))
        .when(bare.rlike(hexa), bare)
        .when(t.rlike(f"^[A-Za-z0-9+/_-]{{{n_b64}}}={{0,2}}$"), b64)
        .otherwise(plain)
    )


def parent_id(col: Column | str, n_bytes: int = 8) -> Column:
    """Like ``canonical_id``, and null too where all bytes are zero: such a parent means none."""
    x = canonical_id(col, n_bytes)
    return F.when(x.rlike("^0+$"), F.lit(None).cast("string")).otherwise(x)


def canonical_id_sql(col: str, n_bytes: int) -> str:
    """The same as a DuckDB expression."""
    n_hex, n_b64 = 2 * n_bytes, -(-4 * n_bytes // 3)
    t = f"trim({col}, ' \t\r\n')"
    bare = f"replace(regexp_replace(lower({t}), '^0x', ''), '-', '')"
    core = f"rtrim(translate({t}, '-_', '+/'), '=')"
    pad = "=" * (-(-n_b64 // 4) * 4 - n_b64)
    return (
        f"CASE WHEN {t} = '' THEN NULL WHEN regexp_full_match({bare}, '[0-9a-f]{{{n_hex}}}') THEN {bare} "
        f"WHEN regexp_full_match({t}, '[A-Za-z0-9+/_-]{{{n_b64}}}={{0,2}}') THEN lower(hex(from_base64({core} || '{pad}'))) "
        f"ELSE lower({t}) END"
    )
