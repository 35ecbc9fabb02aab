"""Resolution of not-modified revisits against the latest earlier full response of the same address.

Records have ``record_id, url, time, kind`` (``response`` or ``revisit``), ``etag``, ``last_modified``,
``headers`` (map of lower-case names) and ``payload``, a body or, to keep bodies out of the sort, the
number under which ``attach`` finds it afterwards. An as-of join by canonical address finds, for every
revisit, the response with the largest ``(time, record_id)`` below its own. The revisit is ``resolved`` if
the validators agree (entity tags compared weakly; only where either side has none, the modification
dates), else ``mismatch``; without an earlier response it is ``orphan``. A resolved revisit takes the
response's headers, with those replaced that a not-modified answer may update (``PERMITTED``).

The join is one sort: records are range-partitioned by (address, time, record), so an address with any
share of all rows is spread over partitions; a window works inside a partition, and the last response of
earlier partitions is carried over by one row per partition and address.

A null address matches only null addresses, a null time sorts first and ties go by record id; validators
that are null or empty are absent, and without a common validator nothing is confirmed (``mismatch``).
Null headers are an empty map. Responses pass with status ``full``; records of other kinds with null.
Repeated rows each get a row; an empty table gives no rows. Further columns are kept, but for those named
``canonical``, ``base_id`` or ``status``, whose place the result's take, and names with an underscore first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.scale import add_salt, hot_keys, replicate
from lexweave.session import cut_lineage

#: Header fields that a not-modified answer may carry and so update. Fixed values of HTTP caching.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: str) -> Column:
    """Lower-case host without ``www.`` or ``m.``, no scheme, fragment, tracking, ending or closing slash."""
    plain = F.regexp_replace(F.regexp_replace(F.col(url), "#.*$", ""), r"^[A-Za-z]+://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, "^[^/?]*", 0)), r"^(www|m)\.", "")
    rest = F.regexp_replace(F.regexp_extract(plain, "^[^/?]*(.*)$", 1), r"([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    tidy = F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "([?&])&+", "$1")
    return F.concat(host, F.regexp_replace(tidy, r"(\.html|/)$", ""))


def _validator(name: str) -> Column:
    text = F.col(name)
    return F.when(text != "", F.regexp_replace(text, "^W/", "") if name.endswith("etag") else text)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with ``canonical``, ``base_id``, ``status``, merged ``headers`` and the base's ``payload``."""
    columns = [c for c in records.columns if c not in ("canonical", "base_id", "status", "headers", "payload")]
    order = ["canonical", "time", "record_id"]
    placed = records.withColumn("canonical", canonical_url("url")).withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    staged = cut_lineage(placed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    full = F.when(
        F.col("kind") == "response",
        F.struct(F.col("record_id").alias("id"), _validator("etag").alias("etag"), _validator("last_modified").alias("modified"), "headers", "payload"),
    )
    # Ranges are contiguous, so at most one address per boundary has rows in several partitions.
    lasting = staged.groupBy("canonical").agg(F.min("_part").alias("_low"), F.max("_part").alias("_high")).where("_low < _high")
    lasting = cut_lineage(lasting.select(F.col("canonical").alias("_address")))
    shared = staged.join(lasting, F.col("canonical").eqNullSafe(F.col("_address")), "left_semi")
    moment = F.when(F.col("kind") == "response", F.struct(F.col("time").isNotNull(), "time", "record_id"))
    last = shared.groupBy(F.col("canonical").alias("_address"), F.col("_part").alias("_at")).agg(F.max_by(full, moment).alias("_last"))
    earlier = Window.partitionBy("_address").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select("_address", "_at", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy("_part", "canonical").orderBy("time", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = staged.withColumn("_seen", F.last(full, ignorenulls=True).over(inside))
    joined = seen.join(handed, F.col("canonical").eqNullSafe(F.col("_address")) & (F.col("_part") == F.col("_at")), "left")
    return _merged(joined.withColumn("_base", F.when(F.col("kind") == "revisit", F.coalesce("_seen", "_before"))), columns)


def attach(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """``resolved`` with the body that its ``payload`` numbers, from ``bodies`` with ``body_id`` and ``body``.

    Each body is shuffled once. One that very many records share is copied once per salt of its number. Of
    repeated numbers in ``bodies`` one row counts; a null or unknown number gives a null body.
    """
    rows = cut_lineage(resolved.withColumnRenamed("payload", "_number"))
    hot = cut_lineage(hot_keys(rows, ["_number"]))
    left = add_salt(rows, hot, ["_number"], ["record_id", "time"])
    held = replicate(bodies.select(F.col("body_id").alias("_number"), "body"), hot, ["_number"])
    one = held.groupBy("_number", "_salt").agg(F.any_value("body").alias("payload"))
    return left.join(one, ["_number", "_salt"], "left").select(*[c for c in rows.columns if c != "_number"], "payload")


def _merged(joined: DataFrame, columns: list[str]) -> DataFrame:
    etag, modified = _validator("etag"), _validator("last_modified")
    both_tags = etag.isNotNull() & F.col("_base.etag").isNotNull()
    same = F.when(both_tags, etag == F.col("_base.etag")).otherwise(F.coalesce(modified == F.col("_base.modified"), F.lit(False)))
    status = F.when(F.col("kind") == "response", "full").when(F.col("kind") == "revisit", F.when(F.col("_base").isNull(), "orphan").when(same, "resolved").otherwise("mismatch"))
    permitted = F.map_filter("headers", lambda name, _: name.isin(*PERMITTED))
    kept = F.map_filter(F.col("_base.headers"), lambda name, _: ~F.map_contains_key(permitted, name))
    resolved = F.col("status") == "resolved"
    return joined.withColumn("status", status).select(
        *columns,
        "canonical",
        F.when(F.col("status").isin("resolved", "mismatch"), F.col("_base.id")).alias("base_id"),
        "status",
        F.when(resolved, F.map_concat(kept, permitted)).otherwise(F.col("headers")).alias("headers"),
        F.when(resolved, F.col("_base.payload")).otherwise(F.col("payload")).alias("payload"),
    )
