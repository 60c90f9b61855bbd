"""Row-level derivations.  All are built-in expressions; nulls follow each docstring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampling weights of the two policies.
IPS_WEIGHTS = {"random": 1.0, "standard": 0.9963}
#: Ordinal of a user's activity; all else is 0.
ACTIVITY = {"full_active": 3, "high_active": 2, "middle_active": 1, "UNKNOWN": 0}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clipped_ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole in [0, 1]; 0 where either is null or the whole is 0."""
    ratio = col(part).cast("double") / F.nullif(col(whole).cast("double"), F.lit(0.0))
    return F.least(F.greatest(F.coalesce(ratio, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def flag(c: Column | str) -> Column:
    """Binary column as a byte, null as 0."""
    return F.coalesce(col(c).cast("byte"), F.lit(0).cast("byte"))


def ordinal(c: Column | str, levels: dict[str, int] = ACTIVITY) -> Column:
    """Level of a category; unlisted and null are 0."""
    out = F.lit(0)
    for name, level in levels.items():
        out = F.when(col(c) == name, level).otherwise(out)
    return out.cast("int")


def log_count(c: Column | str) -> Column:
    """log1p of a count, null as 0."""
    return F.log1p(F.coalesce(col(c).cast("double"), F.lit(0.0)))


def parse_tags(c: Column | str) -> Column:
    """Whole numbers of a comma-joined text; parts that are no digits are dropped, null gives none."""
    parts = F.split(F.coalesce(col(c).cast("string"), F.lit("")), ",")
    return F.transform(F.filter(parts, lambda x: F.trim(x).rlike("^[0-9]+$")), lambda x: F.trim(x).cast("int"))


def aspect_ratio(width: Column | str, height: Column | str) -> Column:
    """width / height; 1 where that is unknown."""
    return F.coalesce(col(width).cast("double") / F.nullif(col(height).cast("double"), F.lit(0.0)), F.lit(1.0))


def seconds(ms: Column | str) -> Column:
    return F.coalesce(col(ms).cast("double") / 1000, F.lit(0.0))


def ips_weight(is_random: Column | str, weights: dict[str, float] = IPS_WEIGHTS, enabled: bool = True) -> Column:
    """Weight of a row by its policy; 1 for all where weighting is off."""
    if not enabled:
        return F.lit(1.0)
    return F.when(col(is_random) == 1, weights["random"]).otherwise(weights["standard"])


def tab_share(tab: Column | str) -> Column:
    return F.coalesce(col(tab).cast("double"), F.lit(0.0)) / 14


def edge_attributes(play: Column | str, long_view: Column | str, tab: Column | str, ips: Column | str) -> Column:
    """[play ratio, long view, tab share, weight]."""
    return F.array(col(play).cast("double"), F.coalesce(col(long_view).cast("double"), F.lit(0.0)), tab_share(tab), col(ips).cast("double"))


def sigmoid(z: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(z)))


def clamp(index: Column | str, n: Column | int) -> Column:
    """Index held within 0 .. n - 1."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.greatest(F.lit(0), F.least(col(index), n - 1))


def present(df: DataFrame, names: tuple[str, ...] | list[str]) -> list[str]:
    """Those of the names that are columns of ``df``, in the given order."""
    have = set(df.columns)
    return [c for c in names if c in have]


def keep(df: DataFrame, names: tuple[str, ...] | list[str]) -> DataFrame:
    """Those of the named columns that are there, in the given order."""
    return df.select(*present(df, names))


def fill_unknown(df: DataFrame, names: tuple[str, ...] | list[str], value: str = "unknown") -> DataFrame:
    """Null categories become ``unknown``; absent columns are skipped."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(value)) for c in present(df, names)})


def number(c: Column | str) -> Column:
    """Double of a text; what is no number becomes null."""
    return col(c).try_cast("double")


def label(c: Column | str) -> Column:
    """Integer label of a text; what is no number is 0."""
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0)).cast("int")
