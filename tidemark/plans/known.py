"""Queries on attributes as known at event time, and on mixed time stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asknown import History, as_known
from tidemark.operators.zones import normalise_stamps
from tidemark.sources import read_table

NEW_YORK = "America/New_York"


def day_text(day: str | Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def name_history(spark: SparkSession, folder: str) -> History:
    return History(read_table(spark, folder, "crsp_msenames"), "permno", "namedt", "nameendt", ["namedt", "ticker", "ncusip", "comnam"])


def link_history(spark: SparkSession, folder: str) -> History:
    links = read_table(spark, folder, "crsp_ccmxpf_linktable")
    links = links.where(F.col("linktype").isin("LU", "LC") & F.col("linkprim").isin("P", "C"))
    links = links.withColumn("gvkey", F.trim("gvkey").try_cast("bigint"))
    return History(links, "lpermno", "linkdt", "linkenddt", ["gvkey"])


def linked_events(spark: SparkSession, folder: str) -> DataFrame:
    """abnormal_returns with the structs `name` and `link` as known on call_date."""
    events = read_table(spark, folder, "abnormal_returns")
    histories = {"name": name_history(spark, folder), "link": link_history(spark, folder)}
    return as_known(events, "permno", "call_date", histories)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return (
        linked_events(spark, folder)
        .where("name is not null")
        .select(
            "event_id",
            F.col("permno").cast("bigint").alias("permno"),
            F.date_format("name.namedt", "yyyy-MM-dd").alias("namedt"),
            F.coalesce("link.gvkey", F.lit(0)).cast("bigint").alias("gvkey"),
        )
        .distinct()
    )


def _days(text: Column) -> Column:
    return F.coalesce(F.to_date(text), F.to_date(F.lit("0001-01-01")))


def stamped_transcripts(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """transcripts with start_date_str as the instant `utc`. A clock without zone is held against the
    delivery (last_update), the noted New York day and the noted half of the day."""
    calls = read_table(spark, folder, "transcripts").select(*columns, *{"start_date_str", "last_update", "call_date", "is_before_close"} - set(columns))
    delivered = F.try_to_timestamp(F.trim("last_update")).cast("timestamp_ntz")

    def contradictions(utc: Column) -> list[Column]:
        there = F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), utc)
        return [
            delivered < utc,
            F.col("call_date").isNotNull() & (F.to_date("call_date") != F.to_date(there)),
            F.col("is_before_close") != (F.hour(there) < 12),
        ]

    return normalise_stamps(calls, "start_date_str", "utc", contradictions=contradictions)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    there = F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), F.col("utc"))
    return (
        stamped_transcripts(spark, folder, ["event_id"])
        .where("utc is not null and event_id is not null")
        .select(
            "event_id",
            F.date_format("utc", "yyyy-MM-dd HH:mm:ss").alias("start_utc"),
            F.date_format(there, "yyyy-MM-dd").alias("call_day"),
            (F.hour(there) < 12).cast("bigint").alias("before_noon"),
        )
        .distinct()
    )


P1_SQL = """
with ev as (select distinct event_id, permno, cast(call_date as date) d from abnormal_returns where call_date is not null),
nm as (select e.event_id, max(n.namedt) namedt from ev e join crsp_msenames n on n.permno = e.permno
       and (n.namedt is null or n.namedt <= e.d) and (n.nameendt is null or n.nameendt >= e.d) group by 1),
lk as (select e.event_id, max_by(cast(trim(l.gvkey) as bigint), l.linkdt) gvkey from ev e join crsp_ccmxpf_linktable l on l.lpermno = e.permno
       and (l.linkdt is null or l.linkdt <= e.d) and (l.linkenddt is null or l.linkenddt >= e.d)
       where l.linktype in ('LU', 'LC') and l.linkprim in ('P', 'C') group by 1)
select distinct e.event_id, cast(e.permno as bigint) permno, strftime(nm.namedt, '%Y-%m-%d') namedt, coalesce(lk.gvkey, 0) gvkey
from ev e join nm using (event_id) left join lk using (event_id)
"""

#: su: transcripts with the clock t and the instant u (UTC) of every stamp that tells a day and a clock time; no zone is UTC.
STAMPS_SQL = r"""
sr as (select *, upper(trim(regexp_replace(start_date_str, '\s+', ' ', 'g'))) s from transcripts),
sz as (select *, regexp_extract(s, '(?:^|[^A-Z])(Z|UTC|GMT|ET|EST|EDT|CST|CDT|MST|MDT|PST|PDT|BST|CET|CEST|JST|[+-]\d{2}:?\d{2})$', 1) z from sr),
sb as (select *, regexp_replace(trim(left(s, length(s) - length(z))), '^(MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*,? ', '') b from sz),
sc as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, ' AT ', ' '), '(\d)T(\d)', '\1 \2'), '(:\d{2}:\d{2})\.\d+', '\1'), ' ?([AP])\.?M\.?$', ' \1M'), '[, ]+', ' ', 'g') c from sb),
st as (select *, case when regexp_full_match(s, '\d{10}') then make_timestamp(cast(s as bigint) * 1000000) when regexp_full_match(s, '\d{13}') then make_timestamp(cast(s as bigint) // 1000 * 1000000)
 else try_strptime(c, ['%d-%b-%y %I:%M %p', '%d-%b-%Y %I:%M %p', '%d-%b-%y %H:%M', '%d-%b-%Y %H:%M', '%d %B %Y %I:%M %p', '%d %B %Y %H:%M', '%d %b %Y %I:%M %p', '%d %b %Y %H:%M', '%B %d %Y %I:%M %p',
 '%b %d %Y %I:%M %p', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y/%m/%d %H:%M', '%m/%d/%Y %I:%M %p', '%m/%d/%Y %H:%M', '%Y%m%d%H%M%S']) end t from sc),
su as (select *, case when z = 'ET' then timezone('UTC', timezone('America/New_York', t)) when regexp_matches(z, '^[+-]') then
 t - to_minutes(cast((case when z[1] = '-' then -1 else 1 end) * (cast(z[2:3] as int) * 60 + cast(right(z, 2) as int)) as int))
 else t - to_hours(cast(case z when 'EST' then -5 when 'EDT' then -4 when 'CST' then -6 when 'CDT' then -5 when 'MST' then -7 when 'MDT' then -6 when 'PST' then -8 when 'PDT' then -7
 when 'BST' then 1 when 'CET' then 1 when 'CEST' then 2 when 'JST' then 9 else 0 end as int)) end u from st)"""
P4_SQL = f"""with {STAMPS_SQL}, sn as (select event_id, u, timezone('America/New_York', timezone('UTC', u)) n from su where u is not null and event_id is not null)
select distinct event_id, strftime(u, '%Y-%m-%d %H:%M:%S') start_utc, strftime(n, '%Y-%m-%d') call_day, cast(hour(n) < 12 as bigint) before_noon from sn"""

QUERIES = {"p1_found": p1_found, "p4_found": p4_found}
ORACLES = {"p1_found": P1_SQL, "p4_found": P4_SQL}
