"""Table cleaners: projections only, no row is dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from renewlens import schema as s
from renewlens.functions import scalars as fn


def conform(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Add expected columns that the input lacks as null text; keep everything else."""
    have = set(df.columns)
    missing = [c for c in columns if c not in have]
    return df.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else df


def _is_text(types: T.StructType, name: str) -> bool:
    return isinstance(types[name].dataType, T.StringType)


def _on(names: Iterable[str], rule: Callable[[str], Column]) -> dict[str, Column]:
    return {c: rule(c) for c in names}


def _numbers(df: DataFrame, names: Iterable[str]) -> dict[str, Column]:
    """Typed columns are only cast; text is parsed."""
    return {
        c: fn.to_number(fn.quoted(c)) if _is_text(df.schema, c) else F.col(fn.quoted(c)).cast("double")
        for c in names
    }


def _dates(df: DataFrame, names: Iterable[str]) -> DataFrame:
    text = [c for c in names if _is_text(df.schema, c)]
    typed = {c: F.col(c).cast("timestamp_ntz") for c in names if c not in text}
    df = df.withColumns(typed) if typed else df
    return fn.parse_dayfirst(df, *text) if text else df


def _ints(df: DataFrame, names: Iterable[str]) -> dict[str, Column]:
    return {c: fn.to_nullable_int(c) if _is_text(df.schema, c) else F.col(c).cast("int") for c in names}


def clean_billings(df: DataFrame, strict: bool = True) -> DataFrame:
    df = _dates(conform(df, s.BILLING_COLUMNS), s.BILLING_DATES)
    return df.withColumns({
        "Co_Ref": fn.normalise_key("Co_Ref"),
        **_ints(df, ["Renewal_Year"]),
        **_numbers(df, s.BILLING_NUMBERS),
        "Current_Auto_Renewal_Flag": fn.map_auto_renewal("Current_Auto_Renewal_Flag", strict),
        **_on(["Band", "Prospect_Outcome"], fn.strip),
        "Payment_Method": fn.strip_upper("Payment_Method"),
    })


def clean_cc_calls(df: DataFrame, not_discussed_as_null: bool = False) -> DataFrame:
    df = _dates(conform(df, s.CC_COLUMNS), ["Call_Date"])
    df = df.withColumns(_on(s.CC_FLAGS, fn.strip_lower))
    return df.withColumns({
        "Co_Ref": fn.normalise_key("Co_Ref"),
        **_ints(df, ["Call_Year"]),
        **_numbers(df, s.CC_SCORES),
        "cc_contractor_sentiment_clean": fn.whitelist_sentiment("cc_contractor_sentiment"),
        **_on(s.CC_FLAGS, lambda c: fn.clean_yes_no(c, not_discussed_as_null, prepared=True)),
        "Direction": fn.strip("Direction"),
    })


def clean_emails(df: DataFrame, not_discussed_as_null: bool = False) -> DataFrame:
    df = conform(df, s.EMAIL_COLUMNS).withColumns(_on(s.EMAIL_FLAGS, fn.strip_lower))
    return df.withColumns({
        "Co_Ref": fn.normalise_key("Co_Ref"),
        **_ints(df, ["year"]),
        "crm_contractor_sentiment_clean": fn.map_email_sentiment("crm_contractor_sentiment"),
        **_numbers(df, ["crm_contractor_sentiment_score"]),
        "crm_agent_chase_count": fn.coerce_count_fill0("crm_agent_chase_count"),
        **_on(s.EMAIL_FLAGS, lambda c: fn.clean_yes_no(c, not_discussed_as_null, prepared=True)),
        "Time_to_Renewal": fn.strip("Time_to_Renewal"),
    })


def clean_renewal_calls(df: DataFrame) -> DataFrame:
    """Outcome-revealing columns stay raw on purpose, apart from the ambiguous decision value."""
    df = _dates(conform(df, s.RC_COLUMNS), ["Call_Date"])
    df = df.withColumns(_on(s.RC_FLAGS, fn.strip_lower))
    return df.withColumns({
        "Co_Ref": fn.normalise_key("Co_Ref"),
        **_ints(df, ["Call_Year"]),
        **_numbers(df, ["Call_Number"]),
        "Call_Direction": fn.normalise_direction("Call_Direction"),
        **_on(s.RC_FLAGS, lambda c: fn.extract_yes_no(c, prepared=True)),
        "Membership_Renewal_Decision": fn.values_to_null("Membership_Renewal_Decision", ["Yes/No"]),
    })


def clean_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    cleaners = {
        "billings": clean_billings,
        "cc_calls": clean_cc_calls,
        "emails": clean_emails,
        "renewal_calls": clean_renewal_calls,
    }
    return {name: cleaners[name](df) for name, df in raw.items()}
