"""Accounts, tokens and stored credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key fragments worth showing.
INTERESTING = ("GoogleUserId", "firstName", "lastName", "CredentialsState", "services",
               "last_unseen", "authenticator", "account_type", "recovery")


def newest_grants(grants: DataFrame, tie: str, scope_part: str) -> DataFrame:
    """Per authenticator: newest grant, and newest grant whose scope contains a text."""
    newest = F.max(F.struct("expires_unix", (-F.col(tie)).alias("t"), "scope"))
    reads = F.col("scope").contains(scope_part)
    agg = grants.groupBy("authenticator").agg(
        newest.alias("n"), F.max(F.when(reads, F.col("expires_unix"))).alias("last_mail_unix"),
        F.count_if(reads).alias("mail_grants"))
    return agg.select("authenticator", F.col("n.expires_unix").alias("last_grant_unix"),
                      F.substring_index("n.scope", " ", 1).alias("scope_head"), "last_mail_unix", "mail_grants")


def interesting_keys(extras: DataFrame, order: str, k: int) -> DataFrame:
    """First k rows whose key mentions one of the fragments, in row order, keys and values whole."""
    rx = "|".join(INTERESTING).lower()
    return (extras.filter(F.lower("key").rlike(rx)).orderBy(order).limit(k)
            .select(order, "key", "value"))


def distinct_secrets(df: DataFrame, by: list[str], secret: str, account: str) -> DataFrame:
    value = F.when(F.coalesce(F.col(secret), F.lit("")) != "", F.col(secret))
    return df.groupBy(*by).agg(F.countDistinct(value).alias("secrets"), F.count(value).alias("with_secret"),
                               F.countDistinct(account).alias("accounts"))


def newest_logs(logs: DataFrame, account: str, tie: str) -> DataFrame:
    """Newest log per account directory, with the number of logs and their bytes."""
    from tracelake.functions.times import utc_text
    newest = F.max(F.struct("mtime", (-F.col(tie)).alias("t"), "name")).alias("m")
    return logs.groupBy(account).agg(F.count("*").alias("logs"), F.sum("size").alias("bytes"), newest).select(
        account, "logs", "bytes", F.col("m.name").alias("newest_log"), utc_text(F.col("m.mtime")).alias("newest_utc"))


def store_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Stored logins per store and type: plain, encrypted and empty values, sites, users."""
    v = F.col("verdict")
    plain = v.startswith("plain")
    return rows.groupBy(*by).agg(
        F.count("*").alias("entries"), F.count_if(plain).alias("plain"),
        F.count_if(v.startswith("encrypted")).alias("encrypted"), F.count_if(v.isin("empty", "missing")).alias("empty"),
        F.countDistinct(F.when(plain, F.col("site"))).alias("plain_sites"),
        F.countDistinct(F.when(plain & (F.col("user") != ""), F.col("user"))).alias("plain_users"))


def session_cookies(cookies: DataFrame) -> DataFrame:
    """Session cookies with a readable value; the value itself is masked."""
    from tracelake.functions.secrets import mask_kind
    from tracelake.functions.urls import SESSION_COOKIES
    return (cookies.filter(F.col("name").isin(*SESSION_COOKIES) & (F.coalesce(F.length("value"), F.lit(0)) > 0))
            .withColumn("value", mask_kind(F.col("value"), "token")))


def accounts_by_type(accounts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accounts per type: rows, distinct names, and those with a password or token on the device."""
    kept = F.coalesce(F.col("secret"), F.lit("")) != ""
    return accounts.groupBy(*by, "type").agg(F.count("*").alias("accounts"), F.countDistinct("name").alias("names"), F.count_if(kept).alias("with_secret"))


def cookie_stores(cookies: DataFrame, by: list[str]) -> DataFrame:
    """Cookies per store: rows, those that can be read (plain or empty), and distinct hosts."""
    v = F.col("verdict")
    return cookies.groupBy(*by).agg(F.count("*").alias("cookies"), F.count_if(v.startswith("plain") | (v == "empty")).alias("readable"), F.countDistinct("host").alias("hosts"))


def cookie_hosts(cookies: DataFrame, by: list[str]) -> DataFrame:
    """Every host of every store with its cookies, one row each."""
    return cookies.groupBy(*by, "host").agg(F.count("*").alias("cookies"))
