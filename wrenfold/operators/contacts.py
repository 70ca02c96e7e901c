"""The contacts view that queries run on: contact records drawn from `customer`, by SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import dealt


def _pick(key: str, values: list[str | None]) -> str:
    arms = " ".join(f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


_K = "CAST(c_custkey AS BIGINT)"
_LOCAL = ["admin", "info", "user", "jane.doe", "no-reply", "user", "first.last", "User", "user", "sales", "user"]
_DOMAIN = ["gmail.com", "gamil.com", "mailinator.com", "acme.xyz", "spamtrap-example.com", "Yahoo.com", "example.org", "yaho.com", "cloud-health.com", "bank.tk", "bad", "outlook.com", "hotmial.com", "real-estate.net"]
_FIRST = ["John", "jane", "Dr. Alice", "MR. Bob", "qwerty", "O'Brien", "Mary-jane", "Prof Carla", "x"]
_LAST = ["Smith", "de la cruz", "", "Johnson", "Miller", "van Buren", "asdfgh", "Brown", "Taylor", "Mc.Donald", "Jackson", "Wzqxkjvbtplmnrd", "Martin"]
_STREET = ["o'neil st; apt <b>3</b>", "main street", "elm AVE {rear}", "2nd st & 3rd", "high road"]
_COMPANY = ["Acme Cloud", "Sunrise Real Estate", "AT&T", "Digital Media", "Bank of Trust", "Green Farm Food", "zzz", "Solar Power", "Public Sector", "Fleet Cargo", "City Hospital", "Web Development"]
_KIND = ["Software", "Group", "", "Labs", "Inc.", "Partners", "Holdings"]

CONTACTS = f"""
SELECT CAST(c_custkey AS BIGINT) AS _row_idx, 'c' || CAST(c_custkey AS STRING) AS id,
  CASE WHEN {_K} % 17 = 0 THEN NULL WHEN {_K} % 19 = 0 THEN 'no at sign' ELSE
    {_pick(_K, _LOCAL)} || CASE WHEN {_K} % 3 = 0 THEN CAST({_K} % 700 AS STRING) ELSE '' END || '@' || {_pick(_K, _DOMAIN)} END AS email,
  {_pick(_K, _FIRST)} || ' ' || {_pick(_K, _LAST)} AS name,
  CASE {_K} % 9 WHEN 0 THEN '98' || lpad(CAST({_K} * 7919 % 100000000 AS STRING), 8, '0') WHEN 1 THEN '555-1234' WHEN 2 THEN '1111111' WHEN 3 THEN '1234567890'
    WHEN 4 THEN '' WHEN 5 THEN '12' WHEN 6 THEN '+1 (202) ' || lpad(CAST({_K} * 31 % 10000000 AS STRING), 7, '0') WHEN 7 THEN NULL ELSE '12121212' END AS phone,
  CAST({_K} % 900 AS STRING) || ' ' || {_pick(_K, _STREET)} AS address,
  {_pick(_K, _COMPANY)} || ' ' || {_pick(_K, _KIND)} AS company,
  'Note ' || CAST({_K} AS STRING) || ': balance "' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) || '"' AS bio,
  't' || CAST(c_nationkey % 5 AS STRING) AS tenant_id
FROM customer
"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey")
    return spark.sql(CONTACTS.replace("FROM customer", "FROM {customer}").replace("elm AVE {rear}", "elm AVE {{rear}}"), customer=customer)
