"""Reading clock stamps of many spellings with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Minutes east of UTC of the zone labels, whatever the season.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "HKT": 480, "SGT": 480, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
    "AST": -240, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

#: Labels that mean the clock of a place.
ZONE_PLACES = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}

_SEP = "\u0001"
_MONTHS = (
    "JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUNE?|JULY?|AUG(?:UST)?|SEP(?:T(?:EMBER)?)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?"
)
_WEEKDAY = "(?:(?:MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*\\.?,? ?)?"
_JOINT = "[ ,]*(?:AT|T)?[ ,]*"
_CLOCK = (
    r"^(.*?)(?<![0-9:])([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]+)?)?(?: ?([AP])\.? ?M\b\.?)?(?![0-9:])(.*)$"
)
_DATES = [  # pattern, and where year, month and day stand in it
    (rf"^{_WEEKDAY}([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}}){_JOINT}$", "$1 $2 $3"),
    (rf"^{_WEEKDAY}([0-9]{{1,2}})[- ]({_MONTHS})\.?[-, ]+([0-9]{{4}}|[0-9]{{2}}){_JOINT}$", "$3 $2 $1"),
    (rf"^{_WEEKDAY}({_MONTHS})\.? ([0-9]{{1,2}}),? ([0-9]{{4}}){_JOINT}$", "$3 $1 $2"),
    (rf"^{_WEEKDAY}([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}|[0-9]{{2}}){_JOINT}$", "$3 $1 $2"),
]


def with_stamp(df: DataFrame, stamp: str, into: str) -> DataFrame:
    """df plus struct(clock, utc, spelling) of a stamp that tells a day and a clock time, else null.

    clock is the local time as written (timestamp_ntz); utc is the instant if the stamp names its
    zone, else null; spelling tells the kind of stamp. Two-digit years are of this century. Dates
    with slashes have the month before the day. Whole numbers of 10 or 13 digits count seconds or
    milliseconds from 1970, of 14 digits are yyyyMMddHHmmss. Fractions of a second are cut. An
    unknown zone label counts as none. The work is done in steps so that no pattern runs twice.
    """
    c = lambda name: F.col(f"__{name}")
    s, part, ymd, offset = c("s"), c("part"), c("ymd"), c("offset")
    number = lambda column: column.try_cast("int")
    df = df.withColumn("__s", F.upper(F.trim(F.regexp_replace(stamp, r"(?U)\s+", " "))))
    df = df.withColumn("__part", F.split(F.regexp_replace(s, _CLOCK, _SEP.join(f"${i}" for i in range(1, 7))), _SEP))
    df = df.withColumns({"__head": F.trim(F.get(part, F.lit(0))), "__tail": F.regexp_replace(F.trim(F.get(part, F.lit(5))), r"[().]", "")})

    kind = F.lit(None).cast("int")
    for i, (pattern, _) in reversed(list(enumerate(_DATES))):
        kind = F.when(c("head").rlike(pattern), i).otherwise(kind)
    df = df.withColumn("__kind", kind)
    order = F.when(F.lit(False), F.lit(""))
    for i, (pattern, places) in enumerate(_DATES):
        order = order.when(c("kind") == i, F.regexp_replace(c("head"), pattern, places))
    zone = r"^(?:UTC|GMT)? ?([+-])([0-9]{1,2}):?([0-9]{2})?$"
    df = df.withColumns(
        {
            "__ymd": F.split(order, " "),
            "__offset": F.when(c("tail").rlike(zone), F.split(F.regexp_replace(c("tail"), zone, "$1 $2 $3"), " ")),
            "__compact": F.when(s.rlike("^[0-9]{14}$"), F.split(F.regexp_replace(s, "^(....)(..)(..)(..)(..)(..)$", "$1 $2 $3 $4 $5 $6"), " ")),
            "__hour": number(F.get(part, F.lit(1))),
        }
    )
    year, hour = number(F.get(ymd, F.lit(0))), c("hour")
    named = (F.instr(F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"), F.substring(F.get(ymd, F.lit(1)), 1, 3)) + 2) / 3
    minutes = number(F.get(offset, F.lit(1))) * 60 + F.coalesce(number(F.get(offset, F.lit(2))), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in ZONE_MINUTES.items() for x in pair])
    places = F.create_map(*[F.lit(x) for pair in ZONE_PLACES.items() for x in pair])
    df = df.withColumns(
        {
            "__year": F.when(F.length(F.get(ymd, F.lit(0))) == 2, year + 2000).otherwise(year),
            "__month": F.coalesce(number(F.get(ymd, F.lit(1))), named.cast("int")),
            "__hour": F.when((F.get(part, F.lit(4)) == "P") & (hour < 12), hour + 12).when((F.get(part, F.lit(4)) == "A") & (hour == 12), F.lit(0)).otherwise(hour),
            "__minutes": F.coalesce(F.when(F.get(offset, F.lit(0)) == "-", -minutes).otherwise(minutes), table[c("tail")]),
            "__place": places[c("tail")],
            "__count": F.when(s.rlike("^[0-9]{10}$"), s.try_cast("long")).when(s.rlike("^[0-9]{13}$"), F.floor(s.try_cast("long") / 1000)),
        }
    )
    stamp_of = lambda y, mo, d, h, mi, sec: F.when(h < 24, F.try_make_timestamp_ntz(y, mo, d, h, mi, sec))
    df = df.withColumns(
        {
            "__written": stamp_of(c("year"), c("month"), number(F.get(ymd, F.lit(2))), hour, number(F.get(part, F.lit(2))), F.coalesce(number(F.get(part, F.lit(3))), F.lit(0))),
            "__compact": stamp_of(*[number(F.get(c("compact"), F.lit(i))) for i in range(6)]),
            "__counted": F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=c("count").cast("decimal(18,6)")),
        }
    )
    clock = F.coalesce(c("written"), c("compact"), c("counted"))
    utc = F.coalesce(
        c("counted"),
        c("written") - F.make_dt_interval(mins=c("minutes")),
        F.convert_timezone(c("place"), F.lit("UTC"), c("written")),
    )
    spelling = (
        F.when(c("counted").isNotNull(), "count").when(c("compact").isNotNull(), "compact").otherwise(F.concat(F.lit("date"), c("kind")))
    )
    read = F.when(clock.isNotNull(), F.struct(clock.alias("clock"), utc.alias("utc"), spelling.alias("spelling")))
    steps = "s part head tail kind ymd offset compact hour year month minutes place count written counted".split()
    # the generator keeps later filters from being merged into the patterns above and running them again
    return df.withColumn(into, F.explode(F.array(read))).drop(*[f"__{step}" for step in steps])
