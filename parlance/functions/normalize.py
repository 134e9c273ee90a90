"""Text and label normalisation (F3, F4, F5, F6) as chained ``regexp_replace``.

Java regex replacement strings use ``$n``; a literal digit right after a group
reference is written ``\\d`` so it is not read as part of the group number.
The step with a computed replacement (12h -> 24h) becomes one literal
replacement per hour 00-11 and a plain strip of the suffix for hours >= 12.
Digits are ASCII ``[0-9]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered time normalisation steps (pattern, replacement).
TIME_STEPS = (
    (r"([0-9]{1})(a\.?m\.?|p\.?m\.?)", r"$1 $2"),                                    # am/pm without space
    (r"(^| )([0-9]{1,2}) (a\.?m\.?|p\.?m\.?)", r"$1$2:00 $3"),                      # short to long form
    (r"(^| )(at|from|by|until|after) ?([0-9]{1,2}) ?([0-9]{2})([^0-9]|$)", r"$1$2 $3:$4$5"),  # missing separator
    (r"(^| )([0-9]{2})[;.,]([0-9]{2})", r"$1$2:$3"),                                 # wrong separator
    (r"(^| )(at|from|by|until|after) ?([0-9]{1,2})([;., ]|$)", r"$1$2 $3:00$4"),     # simple full hour
    (r"(^| )([0-9]{1}:[0-9]{2})", r"$1\0$2"),                                        # missing leading 0
)
PM_PATTERN = r"(:[0-9]{2}) ?p\.?m\.?"
HOUR24_STEP = (r"(^| )24:([0-9]{2})", r"$1\0\0:$2")                                 # 24 -> 00

# Text normalisation steps after the time steps.
TEXT_STEPS = (
    (r"n't", " not"),
    (r"(^| )zero(-| )star([s.,? ]|$)", r"$1\0 star$3"),
    (r"(^| )one(-| )star([s.,? ]|$)", r"$1\1 star$3"),
    (r"(^| )two(-| )star([s.,? ]|$)", r"$1\2 star$3"),
    (r"(^| )three(-| )star([s.,? ]|$)", r"$1\3 star$3"),
    (r"(^| )four(-| )star([s.,? ]|$)", r"$1\4 star$3"),
    (r"(^| )five(-| )star([s.,? ]|$)", r"$1\5 star$3"),
    (r"archaelogy", "archaeology"),
    (r"guesthouse", "guest house"),
    (r"(^| )b ?& ?b([.,? ]|$)", r"$1bed and breakfast$2"),
    (r"bed & breakfast", "bed and breakfast"),
)

# Slot-name tests of the label normaliser.
TIME_SLOT_PARTS = ("leaveAt", "arriveBy")
TIME_SLOTS = ("restaurant-book_time",)
GUESTHOUSE_SLOT_PARTS = ("type", "name", "destination", "departure")
BOOLEAN_SLOTS = ("hotel-parking", "hotel-internet")
# slot/value alias of the transcript data set.
LABEL_FIX = {"centre": "center", "areas": "area", "phone number": "number", "price range": "price_range"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise_time(text) -> Column:
    """F3.  Every step needs a digit to match, so texts without one skip the chain (exact)."""
    src = _c(text)
    t = src
    for pat, rep in TIME_STEPS:
        t = F.regexp_replace(t, pat, rep)
    for hour in range(12):
        t = F.regexp_replace(t, f"{hour:02d}{PM_PATTERN}", f"{hour + 12}$1")
    t = F.regexp_replace(t, f"([0-9]{{2}}){PM_PATTERN}", "$1$2")
    return F.when(src.rlike("[0-9]"), F.regexp_replace(t, *HOUR24_STEP)).otherwise(src)


def normalise_text(text) -> Column:
    """F3 then the text steps, in order."""
    t = normalise_time(text)
    for pat, rep in TEXT_STEPS:
        t = F.regexp_replace(t, pat, rep)
    return t


def normalise_label(slot, value) -> Column:
    """empty -> none; time slots -> F3; guesthouse; boolean slots; hotel type."""
    s, v = _c(slot), _c(value)
    is_time = F.lit(False)
    for p in TIME_SLOT_PARTS:
        is_time = is_time | s.contains(p)
    is_time = is_time | s.isin(*TIME_SLOTS)
    gh = F.lit(False)
    for p in GUESTHOUSE_SLOT_PARTS:
        gh = gh | s.contains(p)
    v2 = F.when(gh, F.regexp_replace(v, "guesthouse", "guest house")).otherwise(v)
    return (F.when(v.isin("", "not mentioned"), F.lit("none"))
            .when(is_time, normalise_time(v))
            .when(s.isin(*BOOLEAN_SLOTS) & v2.isin("yes", "free"), F.lit("true"))
            .when(s.isin(*BOOLEAN_SLOTS) & (v2 == "no"), F.lit("false"))
            .when((s == "hotel-type") & (v2 == "hotel"), F.lit("true"))
            .when((s == "hotel-type") & (v2 == "guest house"), F.lit("false"))
            .otherwise(v2))


def fix_label_alias(x) -> Column:
    """stripped slot or value through the 4-entry alias map."""
    t = F.trim(_c(x))
    m = F.create_map(*[y for k, v in LABEL_FIX.items() for y in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, t), t)


def sql_steps_duckdb(expr: str, steps) -> str:
    """DuckDB form of a replacement chain (RE2 rewrite uses ``\\1``)."""
    import re
    for pat, rep in steps:
        r = re.sub(r"\\(.)", r"\1", rep)      # Java literal escapes -> plain characters
        r = r.replace("$", "\\").replace("'", "''")
        p = pat.replace("'", "''")
        expr = f"regexp_replace({expr}, '{p}', '{r}', 'g')"
    return expr


def sql_normalise_time(expr: str) -> str:
    e = sql_steps_duckdb(expr, TIME_STEPS)
    for hour in range(12):
        e = sql_steps_duckdb(e, [(f"{hour:02d}{PM_PATTERN}", f"{hour + 12}$1")])
    e = sql_steps_duckdb(e, [(f"([0-9]{{2}}){PM_PATTERN}", "$1$2")])
    return sql_steps_duckdb(e, [HOUR24_STEP])


def sql_normalise_text(expr: str) -> str:
    return sql_steps_duckdb(sql_normalise_time(expr), TEXT_STEPS)
