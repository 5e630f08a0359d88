"""Customer inputs derived from the given tables, as lazy views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUESTS = """
select event_id,
  case when event_id % 97 = 0 then 'BAD-' || cast(user_id as string)
       else substr(lpad(cast(user_id as string),12,'0'),1,4) || '-' ||
            substr(lpad(cast(user_id as string),12,'0'),5,8) end as national_id,
  case event_id % 6 when 0 then 'John' when 1 then 'Jon' when 2 then 'Johnny'
       when 3 then 'Jone' when 4 then 'Robert' else 'Bob' end || ' Doe' as name,
  case when event_id % 9 = 0 then null
       else 'user.' || cast(user_id as string) ||
            case when event_id % 4 = 0 then '@gmail.com' else '@example.com' end end as email,
  case when event_id % 11 = 0 then null
       else '+1-555-' || lpad(cast((user_id * 7 + event_id % 8) % 10000 as string),4,'0')
       end as phone,
  case event_id % 7 when 0 then 'CRM' when 1 then 'bank' when 2 then 'WEB'
       when 3 then ' mobile ' when 4 then 'PARTNER' when 5 then 'GOVERNMENT'
       else 'TEST' end as source_system,
  case when event_id % 5 = 0 then 'ck-' || cast(event_id % 400 as string)
       else null end as client_key,
  ts as event_ts,
  ts + interval '1' hour as done_ts
from {events}
"""

PROCESSING_LOG = """
select event_id, ts as event_ts, ts + interval '3' second as processed_at,
  value as latency_ms,
  not (event_type = 'error' and event_id % 10 = 0) as ok,
  event_type in ('view','click') as is_duplicate,
  case when event_type in ('view','click') then 'UPDATED' else 'CREATED' end as action
from {events}
"""

MESSAGE = "case when event_id % 13 = 0 then null else repeat('x', cast(user_id * 10 as int)) end"

ERRORS = """
select event_id, ts as event_ts, lpad(cast(user_id as string),12,'0') as national_id,
  case event_id % 8
    when 0 then 'org.springframework.dao.DeadlockLoserDataAccessException'
    when 1 then 'org.springframework.dao.QueryTimeoutException'
    when 2 then 'java.sql.SQLTransientException'
    when 3 then 'org.springframework.dao.DataIntegrityViolationException'
    when 4 then 'jakarta.validation.ConstraintViolationException'
    when 5 then 'java.lang.IllegalArgumentException'
    when 6 then 'com.example.BusinessRuleValidationException'
    else 'java.lang.RuntimeException' end as exception_class,
  """ + MESSAGE + """ as message,
  3 as retry_count
from {events} where event_type = 'error'
"""

# What messages are made of in their place: joined rows get them afterwards.
SHORT_ERRORS = ERRORS.replace(f"{MESSAGE} as message", "user_id")

GOLDEN_CONTACTS = """
select lpad(cast(c_custkey as string),12,'0') as national_id,
  case c_custkey % 5 when 0 then 'John' when 1 then 'Robert' when 2 then 'William'
       when 3 then 'Elizabeth' else 'Michael' end || ' ' ||
  case c_custkey % 7 when 0 then 'Smith' when 1 then 'Johnson' when 2 then 'Ashcraft'
       when 3 then 'Wachs' when 4 then 'Rupert' when 5 then 'Doe' else 'Tymczak' end
    || cast(c_custkey % 50 as string) as name,
  'c.' || cast(c_custkey as string) ||
    case when c_custkey % 2 = 0 then '@gmail.com' else '@example.com' end as email,
  '+1-212-' || lpad(cast(c_custkey % 1000 as string),3,'0') || '-' ||
     lpad(cast((c_custkey * 37) % 10000 as string),4,'0') as phone
from {customer}
"""

INCOMING_CONTACTS = """
select 'in-' || cast(c_custkey as string) as incoming_id,
  case c_custkey % 5 when 0 then 'Jon' when 1 then 'Bob' when 2 then 'Bill'
       when 3 then 'Liz' else 'Mike' end || ' ' ||
  case c_custkey % 7 when 0 then 'Smyth' when 1 then 'Jonson' when 2 then 'Ashcroft'
       when 3 then 'Wachs' when 4 then 'Robert' when 5 then 'Doe' else 'Tymczak' end
    || cast(c_custkey % 50 as string) as name,
  case c_custkey % 4 when 0 then 'c' || cast(c_custkey as string) || '@gmail.com'
       when 1 then ' C.' || cast(c_custkey as string) || '@Example.com '
       when 2 then null else 'x' || cast(c_custkey as string) || '@other.org' end as email,
  case c_custkey % 3 when 0 then '(212) ' when 1 then '917' else '1212' end ||
     lpad(cast(c_custkey % 1000 as string),3,'0') ||
     lpad(cast((c_custkey * 37) % 10000 as string),4,'0') as phone
from {customer}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REQUESTS, events=table(spark, sf_dir, "events"))


def processing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROCESSING_LOG, events=table(spark, sf_dir, "events"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ERRORS, events=table(spark, sf_dir, "events"))


def short_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors before their messages, which may be long, are made: see ``with_message``."""
    return spark.sql(SHORT_ERRORS, events=table(spark, sf_dir, "events"))


def with_message(short: DataFrame) -> DataFrame:
    """The columns of ``errors`` and others from those of ``short_errors`` and others."""
    return short.select(*(F.expr(MESSAGE).alias("message") if c == "user_id" else c for c in short.columns))


def golden_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GOLDEN_CONTACTS, customer=table(spark, sf_dir, "customer"))


def incoming_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(INCOMING_CONTACTS, customer=table(spark, sf_dir, "customer"))


def with_copies(events: DataFrame, every: int) -> DataFrame:
    """``events`` plus a second delivery of each event whose id divides by ``every``."""
    again = events.filter(F.col("event_id") % every == 0)
    return events.unionByName(again)
