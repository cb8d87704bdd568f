"""URL filters by a temporal list join.

A list is a log of dated entries: on ``day`` a ``pattern`` (a host or a parent
domain) was added or removed.  Entries become validity intervals
``[valid_from, valid_to)``, and every capture is judged by the entries that
were active on the day it was fetched.

Captures are first reduced to distinct (host, day), so the as-of join has one
probe per host, day and domain level whatever the number of captures.  Probes
whose pattern has no bit in the bit array of listed patterns are left out
before they are shuffled, the others are joined by pattern and period of
``PERIOD`` days.  Verdicts go back by (host, day); captures without a host or a
day pass by the join.  The list's side of both joins has few rows a key, and
the engine splits a key with many captures (adaptive skew joins).

Of several entries of a pattern on one day an addition wins.  A pattern that
is added twice stays active; one that is removed first is not.  The longest
active pattern names the verdict.  Captures with a null or unusable url or a
null day are never blocked, and stay.  Entries with nulls do nothing.
Repeated captures give repeated rows.  Main path: DataFrame and SQL only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from structgraph.llm.common import bit_array, may_be_in, table

PERIOD = 32
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host(url: str = "url"):
    """Lower-case host of a url (null where there is none)."""
    found = F.lower(F.regexp_extract(F.col(url), _HOST, 1))
    return F.when(found != "", found)


def validity(entries: DataFrame) -> DataFrame:
    """``pattern``, ``valid_from``, ``valid_to`` (null: open) from ``pattern``, ``day``, ``added``."""
    known = entries.where("pattern is not null and day is not null and added is not null")
    daily = known.groupBy("pattern", "day").agg(F.max("added").alias("added"))
    to = F.lead("day").over(W.partitionBy("pattern").orderBy("day"))
    return daily.select("pattern", F.col("day").alias("valid_from"), to.alias("valid_to"), "added").where("added").drop("added")


def as_of(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """All columns of ``captures`` (``host``, ``fetch_day`` among them), ``blocked``, ``pattern``, ``listed_day``."""
    own = captures.drop("blocked", "pattern", "listed_day")
    probes = own.select("host", "fetch_day").where("host is not null and fetch_day is not null").distinct()
    labels = "transform(array(split(host, '[.]')), l -> transform(sequence(1, size(l)), i -> array_join(slice(l, i, size(l)), '.')))[0]"
    levels = probes.select("host", "fetch_day", F.explode(F.expr(labels)).alias("pattern"), F.expr(f"cast(floor(fetch_day / {PERIOD}) as bigint)").alias("period"))
    levels = levels.where(may_be_in(bit_array(intervals.select("pattern").distinct(), "pattern"), "pattern"))
    last = captures.agg(F.max("fetch_day")).scalar()
    open_ = intervals.select("pattern", "valid_from", "valid_to", F.least(F.coalesce(F.col("valid_to") - 1, last), last).alias("until")).where("valid_from <= until")
    spans = open_.select("pattern", "valid_from", "valid_to", F.explode(F.expr(f"sequence(cast(floor(valid_from / {PERIOD}) as bigint), cast(floor(until / {PERIOD}) as bigint))")).alias("period"))
    met = levels.join(spans, ["pattern", "period"]).where("valid_from <= fetch_day AND (valid_to IS NULL OR fetch_day < valid_to)")
    best = met.groupBy("host", "fetch_day").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", F.col("valid_from").alias("listed_day"))).alias("best"))
    known = F.col("host").isNotNull() & F.col("fetch_day").isNotNull()
    out = own.where(known).join(best, ["host", "fetch_day"], "left").select(*own.columns, "best")
    out = out.unionByName(own.where(~known).withColumn("best", F.lit(None).cast(best.schema["best"].dataType)))
    return out.select(*own.columns, F.col("best").isNotNull().alias("blocked"), "best.pattern", "best.listed_day")


def demo_entries(captures: DataFrame) -> DataFrame:
    """A dated list made from the captures' own hosts and their parent domains, by their MD5 digits.

    The tables hold no list.  A third of the names are listed: added, removed
    later, and half of those added again.
    """
    labels = "transform(array(split(host, '[.]')), l -> transform(sequence(1, greatest(size(l) - 1, 1)), i -> array_join(slice(l, i, size(l)), '.')))[0]"
    names = captures.where("host is not null").select(F.explode(F.expr(labels)).alias("pattern")).distinct()
    digit = "cast(instr('0123456789abcdef', substr(md5(pattern), {}, 1)) - 1 as bigint)"
    digits = names.selectExpr("pattern", *(f"{digit.format(i)} AS d{i}" for i in (1, 2, 3, 4)))
    rows = "array(named_struct('day', d2 * 16, 'added', true), named_struct('day', d2 * 16 + 20 + d3 * 8, 'added', false), named_struct('day', if(d4 % 2 = 0, 240 + d4 * 4, d2 * 16), 'added', true))"
    return digits.where("d1 % 3 = 0").selectExpr("pattern", f"inline({rows})")


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.select("page_id", host().alias("host"), F.expr("pmod(page_id * 7919, 365)").cast("long").alias("fetch_day"))
    found = as_of(captures, validity(demo_entries(captures)))
    return found.select("page_id", "host", "fetch_day", "blocked", "pattern", "listed_day")


OP3_SQL = """
WITH c AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host, (page_id * 7919) % 365 AS fetch_day FROM pages),
h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM c WHERE host IS NOT NULL),
levels AS (SELECT host, array_to_string(l[i:], '.') AS pattern, i, len(l) AS n FROM h, range(1, 128) AS r(i) WHERE i <= len(l)),
names AS (SELECT DISTINCT pattern FROM levels WHERE i <= greatest(n - 1, 1)),
d AS (SELECT pattern, strpos('0123456789abcdef', substr(md5(pattern), 1, 1)) - 1 AS d1, strpos('0123456789abcdef', substr(md5(pattern), 2, 1)) - 1 AS d2, strpos('0123456789abcdef', substr(md5(pattern), 3, 1)) - 1 AS d3, strpos('0123456789abcdef', substr(md5(pattern), 4, 1)) - 1 AS d4 FROM names),
e AS (SELECT pattern, d2 * 16 AS day, true AS added FROM d WHERE d1 % 3 = 0 UNION ALL SELECT pattern, d2 * 16 + 20 + d3 * 8, false FROM d WHERE d1 % 3 = 0
  UNION ALL SELECT pattern, CASE WHEN d4 % 2 = 0 THEN 240 + d4 * 4 ELSE d2 * 16 END, true FROM d WHERE d1 % 3 = 0),
g AS (SELECT pattern, day, bool_or(added) AS added FROM e GROUP BY ALL),
v AS (SELECT pattern, day, added, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM g),
m AS (SELECT c.page_id, c.host, c.fetch_day, v.pattern, v.day, row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.pattern) DESC, v.pattern DESC, v.day DESC) AS k
  FROM c JOIN levels l ON l.host = c.host JOIN v ON v.pattern = l.pattern AND v.added AND v.day <= c.fetch_day AND (v.until IS NULL OR c.fetch_day < v.until))
SELECT c.page_id, c.host, cast(c.fetch_day AS BIGINT) AS fetch_day, m.page_id IS NOT NULL AS blocked, m.pattern, cast(m.day AS BIGINT) AS listed_day FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.k = 1
"""
