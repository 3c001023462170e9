"""Column-expression helpers (F1-F9), clocks and money rules.

Everything here returns a ``Column`` built from built-in Spark functions, so
it stays inside whole-stage code generation. No Python UDF.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ----------------------------------------------------------------- clocks

TS_FORMAT = "%Y-%m-%d %H:%M:%S.%f"


def as_datetime(x: str | dt.datetime | dt.date) -> dt.datetime:
    if isinstance(x, dt.datetime):
        return x
    if isinstance(x, dt.date):
        return dt.datetime(x.year, x.month, x.day)
    return dt.datetime.fromisoformat(str(x))


def ts_lit(x: str | dt.datetime) -> Column:
    """A zone-free (timestamp_ntz) literal, whatever the session's default type."""
    return F.lit(as_datetime(x).strftime(TS_FORMAT)).cast("timestamp_ntz")


def months_back(x: str | dt.datetime, months: int) -> dt.datetime:
    """``x - INTERVAL 'n months'``: the day clamps to the end of a shorter month."""
    x = as_datetime(x)
    y, m = divmod(x.year * 12 + (x.month - 1) - months, 12)
    day = min(x.day, calendar.monthrange(y, m + 1)[1])
    return x.replace(year=y, month=m + 1, day=day)


def ago(as_of, *, days: int = 0, hours: int = 0, minutes: int = 0, months: int = 0) -> Column:
    """``NOW() - interval`` against an explicit clock, as a timestamp_ntz literal."""
    _check_span(days, hours, minutes, months)
    t = months_back(as_of, months) - dt.timedelta(days=days, hours=hours, minutes=minutes)
    return ts_lit(t)


def date_ago(as_of, *, days: int = 0) -> Column:
    """``CURRENT_DATE - interval``: midnight of the clock's day, minus whole days."""
    _check_span(days)
    d = as_datetime(as_of)
    return ts_lit(dt.datetime(d.year, d.month, d.day) - dt.timedelta(days=days))


def month_start(as_of) -> Column:
    """``DATE_TRUNC('month', CURRENT_DATE)``."""
    d = as_datetime(as_of)
    return ts_lit(dt.datetime(d.year, d.month, 1))


def _check_span(*values: int) -> None:
    for v in values:
        if not isinstance(v, int) or isinstance(v, bool) or v < 0:
            raise ValueError(f"interval length must be a non-negative integer, got {v!r}")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Fractional seconds between two timestamps, exact to the microsecond."""
    return (F.timestamp_diff("MICROSECOND", earlier, later).cast("decimal(38,0)") / F.lit(1_000_000)).cast(
        "decimal(38,6)")


# ------------------------------------------------------------ money

def money(c: Column | str) -> Column:
    """Round half up to cents, kept as decimal."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 2).cast("decimal(38,2)")


def total(c: Column | str) -> Column:
    """``COALESCE(SUM(x), 0)`` as decimal(38,2)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)")


def idiv(a: Column, b: Column) -> Column:
    """Exact floor division of a non-negative integer by a positive one.

    ``a - a % b`` is a multiple of ``b``, so the decimal quotient is an exact
    integer (no rounding at any scale)."""
    a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    return ((a - a % b) / b).cast("decimal(38,0)")


def hour_start(c: Column | str) -> Column:
    """``DATE_TRUNC('hour', ts)`` for timestamp_ntz, zone-free."""
    c = F.col(c) if isinstance(c, str) else c
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))


def avg2(c: Column | str) -> Column:
    """Exact mean of a cents-valued (or integer) column, rounded half away from
    zero to two places; NULL over no rows.

    Computed on integer cents (sum and count are ordinary partial aggregates),
    so there is no double rounding and no floating point.
    """
    c = F.col(c) if isinstance(c, str) else c
    # Two sums of longs, the high and the low bits of the cents: each fits for
    # any table, and neither is as slow as a sum of wide decimals.
    each = (c * 100).cast("long")
    high, low = F.sum(F.shiftright(each, 20)), F.sum(each.bitwiseAND(F.lit((1 << 20) - 1)))
    cents = high.cast("decimal(20,0)") * F.lit(1 << 20).cast("decimal(7,0)") + low.cast("decimal(20,0)")
    n = F.count(c).cast("decimal(20,0)")
    q = F.signum(cents).cast("decimal(1,0)") * idiv(F.abs(cents) * 2 + n, n * 2)
    return F.when(n > 0, (q.cast("decimal(36,0)") * F.lit(Decimal("0.01"))).cast("decimal(38,2)"))


def pct(part: Column, whole: Column) -> Column:
    """``ROUND(part / whole * 100, 2)`` for non-negative counts, exact (integer
    arithmetic, half up); NULL when whole is 0 (D8)."""
    p, w = part.cast("long"), whole.cast("long")
    q = idiv(p * 20000 + w, w * 2)
    return F.when(w != 0, (q.cast("decimal(36,0)") * F.lit(Decimal("0.01"))).cast("decimal(38,2)"))


# ------------------------------------------------------------------ F1 - F9

def normalise_phone(c: Column | str) -> Column:
    """digits only; leading 0 -> 254; 254 kept; 9 digits -> 254 prefix."""
    c = F.col(c) if isinstance(c, str) else c
    d = F.regexp_replace(c, r"[^0-9]", "")
    return (F.when(d.startswith("0"), F.concat(F.lit("254"), F.substring(d, 2, 1 << 30)))
            .when(d.startswith("254"), d)
            .when(F.length(d) == 9, F.concat(F.lit("254"), d))
            .otherwise(d))


# Fixed value: the accepted phone pattern.
PHONE_PATTERN = r"^(\+?254|0)[17][0-9]{8}$"


def valid_phone(c: Column | str) -> Column:
    """the phone text matches the accepted pattern (NULL -> false)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(PHONE_PATTERN), F.lit(False))


def amount_matches(amount: Column, expected: Column, tolerance: str = "0.01") -> Column:
    """|expected - amount| <= tolerance."""
    return F.abs(expected - amount) <= F.lit(Decimal(tolerance))


def whole_amount(c: Column) -> Column:
    """the amount sent to the payment API (rounded to a whole number)."""
    return F.round(c, 0).cast("long")


def compact_timestamp(c: Column) -> Column:
    """timestamp -> yyyyMMddHHmmss as bigint."""
    return F.date_format(c, "yyyyMMddHHmmss").cast("long")


def parse_compact_timestamp(c: Column) -> Column:
    """yyyyMMddHHmmss (bigint or text) -> timestamp_ntz; malformed -> NULL."""
    return F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def selling_price(price: Column | str = "price", sale_price: Column | str = "sale_price") -> Column:
    """sale price when set, else price."""
    return F.coalesce(F.col(sale_price) if isinstance(sale_price, str) else sale_price,
                      F.col(price) if isinstance(price, str) else price)


def line_amount(quantity: Column | str = "quantity", unit_price: Column | str = "unit_price") -> Column:
    """quantity * unit_price (discount is ignored, as everywhere in the shop)."""
    q = F.col(quantity) if isinstance(quantity, str) else quantity
    p = F.col(unit_price) if isinstance(unit_price, str) else unit_price
    return q * p


def append_note(notes: Column | str, text: Column) -> Column:
    """``COALESCE(notes,'') || ' | ' || text`` with NULL-skipping concat."""
    n = F.col(notes) if isinstance(notes, str) else notes
    return F.concat(F.coalesce(n, F.lit("")), F.lit(" | "), F.coalesce(text, F.lit("")))


def item_value(items: Column, name: str) -> Column:
    """F8: Value of the first {Name, Value} element whose Name equals ``name``."""
    return F.get(F.filter(items, lambda x: x["Name"] == F.lit(name)), 0)["Value"]


def specs_map(c: Column | str) -> Column:
    """JSON object text -> map<string,string>; text that is not a JSON
    object gives NULL (an empty object an empty map)."""
    c = F.col(c) if isinstance(c, str) else c
    whole = F.startswith(F.ltrim(c), F.lit("{")) & F.try_parse_json(c).isNotNull()
    return F.when(whole, F.from_json(c, "map<string,string>"))


def spec_value(c: Column | str, key: str, dtype: str = "string") -> Column:
    """one attribute of JSON object text as ``dtype``; NULL when the text is
    malformed, the key is missing or the value doesn't fit the type."""
    c = F.col(c) if isinstance(c, str) else c
    name = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(F.try_parse_json(c), f"$['{name}']", dtype)


def specs_with(specs: Column | str, wanted: Mapping[str, str]) -> Column:
    """whether a specs map has all ``wanted`` attributes with these values."""
    specs = F.col(specs) if isinstance(specs, str) else specs
    hits = F.map_filter(specs, lambda k, v: F.coalesce(
        F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])[k] == v, F.lit(False)))
    return F.coalesce(F.size(hits) == len(wanted), F.lit(False)) if wanted else specs.isNotNull()


# ------------------------------------------------------------------ ordering

def desc_pg(c: Column | str) -> Column:
    """DESC with Postgres NULL placement (nulls first) (D3)."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def asc_pg(c: Column | str) -> Column:
    """ASC with Postgres NULL placement (nulls last) (D3)."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def topk(df: DataFrame, order: list[Column], n: int | None, key: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Global top-n. The primary key ascending breaks ties.

    ``orderBy(..).limit(n)`` plans as TakeOrderedAndProject: every partition
    keeps its own n best rows, so only n x partitions rows meet in one task.
    ``n=None`` keeps every row (the full ordered listing).
    """
    ordered = df.orderBy(*order, *[F.col(k).asc_nulls_last() for k in key])
    if n is None:
        return ordered
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise ValueError(f"limit must be a non-negative integer, got {n!r}")
    return ordered.limit(n)


# Order statuses that do not count toward revenue.
OK_STATUS_EXCLUDED = ("cancelled", "failed")


def ok_order(status: Column | str = "status") -> Column:
    """Order counts toward revenue: status not cancelled/failed (NULL -> NULL, i.e. dropped)."""
    s = F.col(status) if isinstance(status, str) else status
    return ~s.isin(*OK_STATUS_EXCLUDED)


def ratio2(num: Column, den: Column) -> Column:
    """``round(num / den, 2)`` for non-negative integers, exact, half up; NULL when den is 0."""
    n, d = num.cast("long"), den.cast("long")
    q = idiv(n * 200 + d, d * 2)
    return F.when(d != 0, (q.cast("decimal(36,0)") * F.lit(Decimal("0.01"))).cast("decimal(38,2)"))




def zero2() -> Column:
    return F.lit(Decimal("0.00")).cast("decimal(38,2)")


def mean2(total_amount: Column, n: Column) -> Column:
    """Mean of cents-valued items from a pre-aggregated sum and count, rounded
    half away from zero to two places (the same result as ``avg2`` on the rows)."""
    cents = (total_amount * 100).cast("decimal(28,0)")
    n = n.cast("decimal(20,0)")
    q = F.signum(cents).cast("decimal(1,0)") * idiv(F.abs(cents) * 2 + n, n * 2)
    return F.when(n > 0, (q.cast("decimal(36,0)") * F.lit(Decimal("0.01"))).cast("decimal(38,2)"))
