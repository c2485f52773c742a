"""Scalar functions on columns: weights, bands, labels, keys, rules and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phi(d: Column, theta: float, eps: float, alpha: float) -> Column:
    """((theta + eps) / (d + eps)) ** alpha."""
    return F.pow((F.lit(theta) + eps) / (d + eps), F.lit(alpha))


def mixed_weight(d: Column, alphas: list[float], eps: float) -> Column:
    """Mean over alphas of the power weights."""
    parts = F.transform(F.array(*[F.lit(a) for a in alphas]), lambda a: F.pow(d + eps, -a))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / float(len(alphas))


def band(x: Column, low: Column, high: Column, n: int) -> Column:
    """Equal-width band 0 .. n-1; the upper end belongs to the last."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - low) / (high - low) * n).cast("int")))


def fidelity(rho: Column) -> Column:
    """A correlation clipped to [0, 1]; NULL stays NULL."""
    return F.when(rho.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), rho)))


def fold_angle(degrees: Column) -> Column:
    return F.least(F.pmod(degrees, F.lit(180.0)), 180.0 - F.pmod(degrees, F.lit(180.0)))


def first_difference(a: Column, b: Column) -> Column:
    """The number of binary digits of a xor b: the level at which two leaves part."""
    x = a.bitwiseXOR(b)
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def alpha_of(text: Column) -> Column:
    """The number in ``alpha=1.5 (...)``; NULL without one."""
    found = F.regexp_extract(text, r"alpha=([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(found != "", found.cast("double"))


def label_of(name: Column) -> Column:
    """``some_name_k7`` as ``Some Name k=7``."""
    words = F.transform(F.split(name, "_"), lambda w: F.when(w.rlike("^k[0-9]+$"), F.concat(F.lit("k="), F.substring(w, 2, 99))).otherwise(F.initcap(w)))
    return F.array_join(words, " ")


def content_key(values: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the sorted, comma-joined values."""
    return F.substring(F.sha2(F.array_join(F.sort_array(values), ","), 256), 1, 16)


def rule_level(nn_ratio: Column, rule: Column) -> Column:
    """Applies a JSON rule: ``two_threshold`` (t1, t2, low, mid, high) or ``log_linear`` (a, b), clipped to [0, 3]."""
    r = F.from_json(rule, "variant string, t1 double, t2 double, low double, mid double, high double, a double, b double")
    x = F.log(nn_ratio)
    step = F.when(x < r["t1"], r["low"]).when(x < r["t2"], r["mid"]).otherwise(r["high"])
    value = F.when(r["variant"] == "two_threshold", step).when(r["variant"] == "log_linear", r["a"] + r["b"] * x).otherwise(F.raise_error(F.lit("unknown rule")).cast("double"))
    return F.least(F.lit(3.0), F.greatest(F.lit(0.0), value))


def smallest_alpha(r: Column, tau: float, grid: list[float]) -> Column:
    """The smallest positive alpha of the grid with r ** alpha <= tau; NULL if there is none."""
    return F.array_min(F.filter(F.array(*[F.lit(a) for a in grid]), lambda a: (a > 0) & (F.pow(r, a) <= tau)))


def hms(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def escape_tex(text: Column) -> Column:
    return F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")


def near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


def finite_positive(*columns: str) -> Column:
    """Whether all columns are above 0 and finite; NULL isn't."""
    parts = [F.coalesce((F.col(c) > 0) & ~F.isnan(F.col(c).cast("double")) & (F.col(c) < float("inf")), F.lit(False)) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def name_parts(df: DataFrame, column: str, pattern: str, groups: dict[str, str]) -> DataFrame:
    """Rows whose text matches the whole pattern, with its groups as typed columns; an empty group is NULL."""
    whole = f"^(?:{pattern})$"
    part = lambda k: F.nullif(F.regexp_extract(column, whole, k), F.lit(""))
    return df.filter(F.col(column).rlike(whole)).select("*", *[part(k + 1).cast(t).alias(n) for k, (n, t) in enumerate(groups.items())])


def recode(value: Column, names: dict[str, str]) -> Column:
    """The value's new name; values that aren't listed stay."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def eligible(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Every condition as a column, and ``eligible`` where all hold; an unknown condition doesn't."""
    flagged = df.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in conditions.items()})
    every = F.forall(F.array(*[F.col(k) for k in conditions]), lambda c: c)
    return flagged.withColumn("eligible", every)


def oriented(metric: Column, value: Column, lower_is_better: list[str]) -> Column:
    """The value with its sign changed where less is better, so that more is better everywhere."""
    return F.when(metric.isin(lower_is_better), -value).otherwise(value)


#: Digits as words. Fixed values.
DIGITS = ["Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine"]

#: Whole numbers from 10 to 20 as words. Fixed values.
TEENS = ["Ten", "Eleven", "Twelve", "Thirteen", "Fourteen", "Fifteen", "Sixteen", "Seventeen", "Eighteen", "Nineteen", "Twenty"]


def number_words(x: Column) -> Column:
    """A level as letters for a name: 0.25 is ``ZeroPointTwoFive``, 3 is ``Three``, 10 is ``Ten``; NULL where it isn't finite."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")
    spoken = F.transform(F.split(text, ""), lambda c: F.when(c == ".", "Point").when(c == "-", "Minus").otherwise(F.get(F.array(*[F.lit(w) for w in DIGITS]), c.cast("int"))))
    teen = F.get(F.array(*[F.lit(w) for w in TEENS]), (x - 10).cast("int"))
    return F.when(x.between(10, 20) & (x == F.floor(x)), teen).when(F.abs(x) < float("inf"), F.array_join(spoken, ""))


def significant(x: Column, digits: int) -> Column:
    """A number as text with so many significant digits after its first, never fewer than all before the point; 0 is ``0``."""
    places = F.greatest(F.lit(0), digits - 1 - F.floor(F.log10(F.abs(x))).cast("int"))
    fixed = lambda k: F.format_string(f"%.{k}f", F.bround(x, k))
    text = fixed(0)
    for k in range(1, digits + 12):
        text = F.when(places == k, fixed(k)).otherwise(text)
    return F.when(x == 0, "0").otherwise(text)


def composite_key(*columns: str) -> Column:
    """``a__b__c`` as text."""
    return F.concat_ws("__", *[F.col(c).cast("string") for c in columns])


def short_key(key: Column, prefixes: dict[str, str]) -> Column:
    """The key with its longest known prefix made short; a key without one is an error."""
    out = F.raise_error(F.concat(F.lit("unknown metric key: "), key)).cast("string")
    for prefix in sorted(prefixes, key=len):
        out = F.when(key.startswith(prefix), F.concat(F.lit(prefixes[prefix]), F.substring(key, len(prefix) + 1, 1000))).otherwise(out)
    return out


def eta(done: Column, total: Column, seconds: Column) -> Column:
    """``done/total (p %), ETA H:MM:SS`` by the mean time so far; no estimate before the first is done."""
    left = F.when(done > 0, hms(seconds / done * (total - done))).otherwise(F.lit("?"))
    return F.concat(done.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), F.floor(100 * done / total).cast("string"), F.lit(" %), ETA "), left)
