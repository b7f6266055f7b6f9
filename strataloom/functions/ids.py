"""Identifiers, instants as text, slugs: column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(*parts: Column, length: int) -> Column:
    """The first ``length`` hexadecimal digits of the SHA-256 of the parts, parted by ``|``; NULL if any is."""
    return F.substring(F.sha2(F.concat(*[x for p in parts for x in (F.lit("|"), p)][1:]), 256), 1, length)


def record_id(qualifier: str, kind: str, number: Column) -> Column:
    """``qualifier#kind/number``."""
    return F.concat(F.lit(f"{qualifier}#{kind}/"), F.lower(number.cast("string")))


def actor_id(login: Column, email: Column, name: Column) -> Column:
    """An account's id by its login, else by the hash of the mail address or name, else ``unknown/actor``."""
    mail = F.nullif(F.lower(F.trim(F.coalesce(F.nullif(F.trim(email), F.lit("")), name))), F.lit(""))
    return F.when(F.trim(login) != "", F.concat(F.lit("github/user/"), F.lower(F.trim(login)))).when(mail.isNotNull(), F.concat(F.lit("git/email/"), F.substring(F.sha2(mail, 256), 1, 16))).otherwise("unknown/actor")


def edge_id(kind: Column, src: Column, dst: Column) -> Column:
    return F.concat(F.lit("edge/"), kind, F.lit("/"), digest(kind, src, dst, length=20))


def group_id(qualifier: str, members: Column) -> Column:
    """An id of a set of numbers: its least and the hash of all in order."""
    ordered = F.array_sort(F.array_distinct(members))
    return F.concat(F.lit(f"{qualifier}#episode/"), F.get(ordered, 0).cast("string"), F.lit("-"), F.substring(F.sha2(F.array_join(F.transform(ordered, lambda x: x.cast("string")), ","), 256), 1, 12))


def instant(text: Column, strict: bool = False) -> Column:
    """An ISO 8601 text as an instant; without zone it is UTC (the session's zone is to be UTC). Bad text is NULL, or an error if ``strict``."""
    return F.to_timestamp(text) if strict else F.try_to_timestamp(text)


def iso(at: Column) -> Column:
    """An instant as ISO 8601 in UTC, to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def bucket(key: Column, size: int) -> Column:
    """The batch of ``size`` neighbouring numbers that a key is in, the same whatever else there is."""
    return F.floor(key / size).cast("bigint")


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single hyphens between; ``item`` if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("item"))


def unique_slugs(df: DataFrame, text: str, key: str, out: str = "slug") -> DataFrame:
    """``df`` with a slug a row; of rows with the same one all but the first by ``key`` get a number."""
    named = df.withColumn("_s", slug(F.col(text)))
    n = F.row_number().over(Window.partitionBy("_s").orderBy(key))
    return named.withColumn(out, F.when(n == 1, F.col("_s")).otherwise(F.concat_ws("-", "_s", n.cast("string")))).drop("_s")


def host_allowed(url: Column, hosts: Sequence[str]) -> Column:
    """Whether an https address leads to one of ``hosts`` or below; FALSE for what is no address."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    below = F.coalesce(*[F.when((host == h) | host.endswith(f".{h}"), F.lit(True)) for h in hosts], F.lit(False))
    return F.coalesce(url.startswith("https://"), F.lit(False)) & below
