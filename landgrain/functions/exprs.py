"""Column expressions: safe casts, ratios, bins, keys, deflation inputs, text parsing and recoding."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def loose(c: str | Column, kind: str) -> Column:
    """Tolerant cast: what cannot be cast is NULL."""
    return col(c).try_cast(kind)


def strict(c: str | Column, kind: str) -> Column:
    """Strict cast for keys: what cannot be cast is an error (ANSI mode)."""
    return col(c).cast(kind)


def loose_date(c: str | Column, form: str = "dd/MM/yyyy") -> Column:
    return F.try_to_timestamp(col(c), F.lit(form)).cast("date")


def divided(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL for a zero denominator."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != math.inf), c)


def finite_all(df: DataFrame) -> DataFrame:
    """``finite`` over every double and float column."""
    kinds = dict(df.dtypes)
    return df.select(*(finite(c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns))


def quarter_label(date: str | Column) -> Column:
    return F.concat(F.year(col(date)).cast("string"), F.lit("Q"), F.quarter(col(date)).cast("string"))


def month_label(date: str | Column) -> Column:
    return F.date_format(col(date), "yyyy-MM")


def key_of(high: str | Column, low: str | Column, base: int) -> Column:
    """Composite key high * base + low."""
    return col(high).cast("bigint") * base + col(low).cast("bigint")


def key_parts(key: str | Column, base: int) -> tuple[Column, Column]:
    key = col(key)
    low = F.pmod(key, F.lit(base))
    return ((key - low) / base).cast("bigint"), low


def largest_of(*cs: str | Column) -> Column:
    """Row-wise maximum of the values that are known."""
    return F.greatest(*(col(c) for c in cs))


def clipped(c: str | Column, low=None, high=None) -> Column:
    c = col(c)
    c = c if low is None else F.when(c.isNotNull(), F.greatest(c, F.lit(low)))
    return c if high is None else F.when(c.isNotNull(), F.least(c, F.lit(high)))


def binned(c: str | Column, edges: list[float], labels: list, closed: str = "right", other=None) -> Column:
    """The label of the bin that holds the value; outside of all bins ``other`` (NULL if not given)."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin")
    c, out = col(c), None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = (c > low) & (c <= high) if closed == "right" else (c >= low) & (c < high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out if other is None else out.otherwise(F.lit(other))


def geometric_edges(low: float, high: float, bins: int) -> list[float]:
    return [low * (high / low) ** (k / bins) for k in range(bins + 1)]


def decade(year: str | Column) -> Column:
    return (F.floor(col(year) / 10) * 10).cast("int")


def building_age(sale_year: str | Column, built: str | Column, low: int = 1900, high: int = 2027) -> Column:
    """Sale year less building year, not below 0, only for a plausible building year."""
    return F.when(col(built).between(low, high), F.greatest(col(sale_year) - col(built), F.lit(0)))


def or_missing(c: str | Column, level: str = "na") -> Column:
    """An explicit level for what is missing."""
    return F.coalesce(col(c), F.lit(level))


def room_class(rooms: str | Column) -> Column:
    """'2' below 3 rooms, '3' below 4, '4' below 5, else '5'."""
    r = col(rooms)
    return F.when(r < 3, "2").when(r < 4, "3").when(r < 5, "4").when(r >= 5, "5")


def position_class(floor: str | Column, height: str | Column) -> Column:
    """ground, top, or the lower, middle or upper third of the building."""
    f, h = col(floor), col(height)
    return (
        F.when(f.isNull() | h.isNull(), None)
        .when(f == 0, "ground")
        .when(f == h, "top")
        .when(3 * f <= h, "lower")
        .when(3 * f <= 2 * h, "middle")
        .otherwise("upper")
    )


def log_with_zero(c: str | Column) -> tuple[Column, Column]:
    """(ln x for x > 0 and 0 for x = 0, indicator of x = 0); missing stays missing."""
    c = col(c)
    return F.when(c > 0, F.ln(F.when(c > 0, c))).when(c == 0, 0.0), (c == 0).cast("int")


def significant(c: str | Column, digits: int = 4) -> Column:
    """Rounded to significant digits; 0 stays 0."""
    c = col(c).cast("double")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(F.when(c != 0, c)))))
    return F.when(c == 0, 0.0).otherwise(F.round(c * scale) / scale)


def log_code(km: str | Column) -> Column:
    """round(25 (ln km + 3)) + 1; 0 for missing."""
    km = col(km)
    return F.coalesce(F.round(25 * (F.ln(F.when(km > 0, km)) + 3)) + 1, F.lit(0)).cast("int")


#: Metres per degree of longitude (at 31.8 degrees north) and latitude.
METRES_X, METRES_Y = 111320 * math.cos(math.radians(31.8)), 110574.0


def metres(lon: str | Column, lat: str | Column) -> tuple[Column, Column]:
    return col(lon) * METRES_X, col(lat) * METRES_Y


def recoded(c: str | Column, codes: dict, other=None) -> Column:
    """A lookup in a small fixed map; unknown codes give ``other``."""
    pairs = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    out = F.try_element_at(pairs, col(c))
    return out if other is None else F.coalesce(out, F.lit(other))


#: Land-use codes and the categories they stand for.
LAND_USE = {
    1: "edu", 2: "health", 3: "relig", 4: "public", 5: "public", 7: "culture", 8: "hotel", 9: "center", 10: "comm",
    11: "comm", 12: "ind", 20: "public", 21: "res", 25: "transport", 29: "roads", 33: "park",
}
#: Substrings of place categories that are not commerce.
NOT_COMMERCE = (
    "school", "learning", "education", "preschool", "college", "university", "hospital", "religio", "worship",
    "church", "mosque", "synagogue", "park", "historic", "monument", "government", "public_service", "community",
    "social", "cemetery", "military", "landmark", "nature", "beach", "mountain", "structure", "bus", "train",
    "station", "airport", "parking", "police", "fire", "library", "museum", "embassy", "courthouse", "post_office",
    "playground", "garden", "forest", "river", "lake", "island", "bridge", "road", "street",
)
#: Hebrew floor words.
ORDINALS = {
    "קרקע": 0, "ראשונה": 1, "שניה": 2, "שנייה": 2, "שלישית": 3, "רביעית": 4, "חמישית": 5, "שישית": 6, "שביעית": 7,
    "שמינית": 8, "תשיעית": 9, "עשירית": 10,
}
UNITS = {
    "אחת": 1, "אחד": 1, "שתים": 2, "שתיים": 2, "שניים": 2, "שלוש": 3, "ארבע": 4, "חמש": 5, "שש": 6, "שבע": 7,
    "שמונה": 8, "תשע": 9,
}
TENS = {"עשרים": 20, "שלושים": 30, "ארבעים": 40, "חמישים": 50}
#: Street-type prefixes.
STREET_TYPES = ("רחוב", "רח", "שדרות", "שד", "דרך", "סמטת", "סמ", "כיכר")


def excluded(c: str | Column, words: tuple[str, ...] = NOT_COMMERCE) -> Column:
    """True for a category, in any case, that holds none of the words; an empty or missing one is False."""
    c = F.lower(F.coalesce(col(c), F.lit("")))
    return (c != "") & ~c.rlike("|".join(words))


# The marks of writing direction inside floor texts, and the blanks and signs that street names are compared without.
DIRECTION_MARKS = "[‎‏]"
NAME_SIGNS = r"[\s\"'`״׳\-.,()]+"


def parsed_floor(text: str | Column) -> Column:
    """The floor number in a floor text: digits, ordinals, teens, tens and tens with units; NULL if unknown."""
    s = F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), DIRECTION_MARKS, ""))
    number = F.regexp_extract(s, r"^(?:קומה\s*)?(-?\d+)$", 1)
    teen = recoded(F.regexp_extract(s, r"^(\S+) עשרה$", 1), UNITS)
    tens = recoded(F.regexp_extract(s, r"^(\S+) ו(\S+)$", 1), TENS)
    units = recoded(F.regexp_extract(s, r"^(\S+) ו(\S+)$", 2), UNITS)
    return F.coalesce(number.try_cast("int"), recoded(s, ORDINALS), teen + 10, recoded(s, TENS), tens + units)


def parsed_once(df: DataFrame, text: str, out: str) -> DataFrame:
    """``parsed_floor`` on distinct texts, joined back; Spark broadcasts the table if it is small."""
    distinct = df.select(text).where(F.col(text).isNotNull()).distinct().withColumn(out, parsed_floor(text))
    return df.join(distinct, text, "left")


def street_key(name: str | Column) -> Column:
    """A street name without blanks, punctuation and a leading street type (if two letters or more remain)."""
    s = F.regexp_replace(col(name), NAME_SIGNS, "")
    return F.regexp_replace(s, "^(" + "|".join(STREET_TYPES) + ")(?=.{2,})", "")


def party_share(columns: list[str], valid: str, least: float = 0.5) -> tuple[Column, Column]:
    """(share of the columns in the valid votes, whether it reaches ``least``)."""
    share = divided(reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0)) for c in columns)), valid)
    return share, F.coalesce(share >= least, F.lit(False))


def place_group(religion: str, boarding: str, fallback: str, other_religions: list, least: float = 40) -> Column:
    """minority, orthodox or other: by the census place's religion, else by the fallback's; then by the boarding share."""
    minority = F.when(F.col(religion).isNotNull(), F.col(religion) != "main").otherwise(F.col(fallback).isin(other_religions))
    return F.when(minority, "minority").when(F.col(boarding) >= least, "orthodox").otherwise("other")


def region_of(city: Column, district: Column, cities: dict, districts: dict, split_city: str, split: Column) -> Column:
    """The cost region: a split city by coordinates, else the city's, else the district's default."""
    return F.when(city == split_city, split).otherwise(F.coalesce(recoded(city, cities), recoded(district, districts)))
