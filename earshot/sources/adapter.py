"""Raw listening tables derived from the driver's star schema.

The texts run in Spark and in DuckDB alike, but for the expression of ``EPOCH``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("supplier", "part", "lineitem", "orders", "customer")
SPARK_EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)"
DUCKDB_EPOCH = "cast(epoch(o_orderdate) as bigint)"

# The test adapter.
SQL = {
    "artists_raw": """
select cast(s_suppkey as string) artist_id,
  case when s_suppkey%17=3 then null when s_suppkey%29=5 then 'artist_name' else s_name end artist_name
from {supplier}""",
    "tracks_raw": """
select cast(p_partkey as string) track_id,
  case when p_partkey%41=7 then 'nan' else p_name end track_name,
  cast(p_partkey%(select count(*) from {supplier}) as string) artist_id
from {part} where (p_partkey%(select count(*) from {supplier}))%11<>4""",
    "albums_raw": """
select distinct cast(l_suppkey*100+cast(substring(p_brand,7) as int) as string) album_id,
  case when (l_suppkey*100+cast(substring(p_brand,7) as int))%37=11 then null else p_brand end album_name,
  cast(l_suppkey as string) artist_id
from {lineitem} join {part} on p_partkey=l_partkey where l_suppkey%13<>6""",
    "users_raw": """
select case when c_custkey%53=5 then concat('x',cast(c_custkey as string)) else cast(c_custkey as string) end user_id,
  case when c_nationkey=0 then 'US' when c_nationkey=1 then 'RU' when c_nationkey=2 then 'DE'
       when c_nationkey=3 then 'UK' when c_nationkey=4 then 'PL' when c_nationkey=5 then 'BR'
       when c_nationkey between 6 and 14 then null else 'JP' end country,
  cast(case when c_custkey%10<6 then -1 else 15+c_custkey%30 end as string) age,
  case c_mktsegment when 'BUILDING' then 'm' when 'MACHINERY' then 'f' when 'AUTOMOBILE' then 'n'
       when 'FURNITURE' then null else 'm' end gender,
  cast(4000+(c_custkey*7919)%30000 as string) playcount,
  cast(1035849600+c_custkey*1000 as string) registered_unixtime
from {customer}""",
    "les_raw": """
select cast(o_custkey as string) user_id, cast(l_suppkey as string) artist_id,
  cast(l_suppkey*100+cast(substring(p_brand,7) as int) as string) album_id, cast(l_partkey as string) track_id,
  cast({EPOCH}+l_linenumber*60 as string) as {timestamp}
from {lineitem} join {orders} on o_orderkey=l_orderkey join {part} on p_partkey=l_partkey""",
    "genres_raw": """
select row_number() over (order by p_type)-1 genre_id, p_type genre_name from (select distinct p_type from {part}) t""",
    "artist_genre_raw": """
select s_name artist_name, genre_id from (
  select l_suppkey, p_type, row_number() over (partition by l_suppkey order by count(*) desc, p_type) k
  from {lineitem} join {part} on p_partkey=l_partkey where l_suppkey%4<>1 group by l_suppkey, p_type) x
join {supplier} on s_suppkey=l_suppkey join {genres_raw} on genre_name=p_type where k<=3""",
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the raw tables over the Parquet tables in ``sf_dir``."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f"{{{t}}}" in SQL[name]}
    if "{genres_raw}" in SQL[name]:
        frames["genres_raw"] = raw(spark, sf_dir, "genres_raw")
    text = SQL[name].replace("{EPOCH}", SPARK_EPOCH).replace("{timestamp}", "timestamp")
    return spark.sql(text, **frames)


def duckdb_sql(name: str) -> str:
    text = SQL[name].replace("{EPOCH}", DUCKDB_EPOCH).replace("{timestamp}", '"timestamp"')
    for t in (*BASE, "genres_raw"):
        text = text.replace(f"{{{t}}}", t)
    return text.strip()
