"""Repairs for messy text, as built-in SQL expressions that stay in codegen.

The text functions take SQL expression text (usually a column name) and return a Column: one parsed
expression per column keeps building a plan with dozens of repaired columns cheap.

Rules that look at a text several times accept ``prepared=True`` for text that is already stripped and
lower-cased. Table cleaners prepare in one projection and decide in the next, so that each value is
stripped once and not once per branch.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens import schema as s

# what a text strip removes besides the plain space
_BLANKS = r"' \t\n\r\u000B\u000C\u001C\u001D\u001E\u001F\u0085 '"
_NUMBER = r"r'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def _col(c: Column | str) -> Column:
    return F.col(quoted(c)) if isinstance(c, str) else c


def quoted(name: str) -> str:
    """Column reference that is safe for names such as ``#_of_Connection``."""
    return name if name.replace("_", "a").isalnum() and not name[0].isdigit() else f"`{name}`"


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(expr: str, values: Iterable[str]) -> str:
    return f"{expr} in ({', '.join(map(_literal, values))})"


def _strip(c: str) -> str:
    return f"btrim({c}, {_BLANKS})"


def _strip_lower(c: str) -> str:
    return f"lower({_strip(c)})"


def _lookup(expr: str, table: Mapping[str, str]) -> str:
    pairs = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in table.items())
    return f"try_element_at(map({pairs}), {expr})"


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


# --- text -----------------------------------------------------------------------


def strip(c: str) -> Column:
    return F.expr(_strip(c))


def strip_upper(c: str) -> Column:
    return F.expr(f"upper({_strip(c)})")


def strip_lower(c: str) -> Column:
    return F.expr(_strip_lower(c))


def normalise_key(c: str) -> Column:
    """Key as trimmed text; blank keys are missing."""
    return F.expr(f"nullif({_strip(f'cast({c} as string)')}, '')")


def null_token_to_null(c: str, tokens: Sequence[str] = s.NULL_TOKENS) -> Column:
    return F.expr(f"case when not {_in(c, tokens)} then {c} end")


def values_to_null(c: str, values: Iterable[str]) -> Column:
    return F.expr(f"case when not {_in(c, values)} then {c} end")


def iso_order(c: str) -> Column:
    """Stripped date text with day-first dates turned into year-month-day."""
    iso = f"regexp_replace({_strip(c)}, r'{s.DAY_FIRST_SHAPE}', '$3-$2-$1$4')"
    return F.expr(f"regexp_replace({iso}, r'{s.YEAR_FIRST_SLASHES}', '$1-$2-$3$4')")


def parse_iso_order(c: str) -> Column:
    """Timestamp from the text of :func:`iso_order`; the shape is checked before parsing.

    The source dates name no zone, so the result has none either: 28 days stay 28 days in every
    session time zone.
    """
    named = f"initcap(regexp_replace({c}, '[ -]+', ' '))"
    return F.expr(
        f"case when {c} rlike r'{s.ISO_SHAPE}' then try_cast({c} as timestamp_ntz) "
        f"when {c} rlike r'{s.NAMED_MONTH_SHAPE}' "
        f"then cast(try_to_timestamp({named}, 'd MMM yyyy') as timestamp_ntz) end"
    )


def parse_dayfirst(df: DataFrame, *columns: str) -> DataFrame:
    """Date text columns become timestamps; text that is no day-first or ISO date becomes null."""
    return df.withColumns({c: iso_order(quoted(c)) for c in columns}).withColumns(
        {c: parse_iso_order(quoted(c)) for c in columns}
    )


def to_number(c: str) -> Column:
    """Double from text; the pattern keeps out spellings such as ``1d`` or ``NaN``."""
    return F.expr(_number(c))


def _number(c: str) -> str:
    return f"case when {c} rlike {_NUMBER} then try_cast({c} as double) end"


def serial_date_number(c: str) -> Column:
    """Spreadsheet day numbers stay numbers; dates written as text become null."""
    return to_number(c)


def coerce_score(c: str) -> Column:
    """Score text; ``Not Discussed`` and blanks are not numbers and so become null."""
    return to_number(c)


def to_nullable_int(c: str) -> Column:
    return F.expr(f"try_cast({_number(c)} as int)")


def coerce_count_fill0(c: str) -> Column:
    return F.expr(f"coalesce({_number(c)}, 0D)")


def map_auto_renewal(c: str, strict: bool = True) -> Column:
    """Yes/No from the short spellings; ``strict=False`` also reads Yes, YES, No, NO."""
    yes = s.AUTO_RENEWAL_YES + ([] if strict else s.AUTO_RENEWAL_YES_LENIENT)
    no = s.AUTO_RENEWAL_NO + ([] if strict else s.AUTO_RENEWAL_NO_LENIENT)
    text = _strip(c)
    return F.expr(f"case when {_in(text, yes)} then 'Yes' when {_in(text, no)} then 'No' end")


def clean_yes_no(
    c: str, not_discussed_as_null: bool = False, prepared: bool = False
) -> Column:
    no = s.FLAG_NO + ([] if not_discussed_as_null else s.FLAG_NOT_DISCUSSED)
    text = c if prepared else _strip_lower(c)
    return F.expr(
        f"case when {_in(text, s.FLAG_YES)} then 'Yes' when {_in(text, no)} then 'No' end"
    )


def extract_yes_no(c: str, prepared: bool = False) -> Column:
    """Yes/No from remarks: exact spellings, then the opening word, then the first 30 characters."""
    text = c if prepared else _strip_lower(c)
    opening = f"substring({text}, 1, 30)"
    return F.expr(
        f"case when {_in(text, s.EXTRACT_NULL)} then null "
        f"when {_in(text, s.EXTRACT_NO)} then 'No' "
        f"when startswith({text}, 'yes') then 'Yes' "
        f"when startswith({text}, 'no') then 'No' "
        f"when {opening} rlike r'(?U)\\byes\\b' then 'Yes' "
        f"when {opening} rlike r'(?U)\\bno\\b' then 'No' end"
    )


def whitelist_sentiment(c: str) -> Column:
    return F.expr(f"case when {_in(c, s.CALL_SENTIMENTS)} then {c} end")


def map_email_sentiment(c: str) -> Column:
    return F.expr(_lookup(_strip_lower(c), s.EMAIL_SENTIMENT))


def normalise_direction(c: str) -> Column:
    return F.expr(_lookup(_strip_lower(c), s.DIRECTIONS))


def is_yes_loose(c: str) -> Column:
    """1 when the raw text reads yes in any case."""
    return F.expr(f"case when {_strip_lower(c)} = 'yes' then 1 else 0 end")


def yes_no_to_int(c: str) -> Column:
    return F.expr(f"case {c} when 'Yes' then 1 when 'No' then 0 end")


# --- values ---------------------------------------------------------------------


def lookup(c: Column, table: Mapping[str, object]) -> Column:
    """Exact-key lookup in a small fixed table, null for other keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def month_of(c: Column | str) -> Column:
    return F.month(_col(c))


def clip(c: Column | str, lower: float | None = None, upper: float | None = None) -> Column:
    """Bounded value; null stays null (``least``/``greatest`` alone would return the bound)."""
    c = _col(c)
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(c.isNotNull(), out)


def finite(c: Column | str) -> Column:
    """Null for NaN and the infinities."""
    c = _col(c)
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(c) & (F.abs(c) != inf), c)


def ratio_change(new: Column | str, old: Column | str) -> Column:
    """(new - old) / old, null when the base is missing or zero."""
    new, old = _col(new), _col(old)
    return F.try_divide(new - old, old)
