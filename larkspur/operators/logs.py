"""Rollups of the question log, whose records hold maps from contacted source to milliseconds and bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import percentiles
from .routing import small

#: A record: its question, mode, stage times, and by contacted source the time, bytes, passages and probes; nodes in error.
RECORD = "query_id string, mode string, stage_ms map<string,double>, contact_ms map<string,double>, request map<string,double>, response map<string,double>, disclosed map<string,long>, probes map<string,long>, errors map<string,string>"


def _total(m: str) -> Column:
    return F.aggregate(F.map_values(F.coalesce(F.col(m), F.create_map().cast("map<string,double>"))), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def transport(log: DataFrame, by: str = "mode") -> DataFrame:
    """Per mode: questions, mean contacts, mean and 95th percentile of the total and of a contact's time, mean bytes a question
    asks and gets, and contacts in error. A record without a contact counts as a question; a missing time isn't averaged."""
    n = F.greatest(F.size("contact_ms"), F.lit(0))
    each = log.select(by, F.element_at("stage_ms", F.lit("total")).alias("total"), n.alias("contacts"), _total("request").alias("asked"), _total("response").alias("got"), F.greatest(F.size("errors"), F.lit(0)).alias("errors"))
    per = each.groupBy(by).agg(F.count("*").alias("questions"), F.avg("contacts").alias("contacts"), F.avg("total").alias("total_ms"), F.avg("asked").alias("request_bytes"), F.avg("got").alias("response_bytes"), F.sum("errors").alias("errors"))
    contact = log.select(by, F.explode("contact_ms").alias("node", "ms"))
    parts = [
        percentiles(each, [by], "total", {"total_p95": 0.95}), contact.groupBy(by).agg(F.avg("ms").alias("contact_ms")), percentiles(contact, [by], "ms", {"contact_p95": 0.95}),
    ]
    for k, part in enumerate(parts):
        per = per.join(small(part.withColumnRenamed(by, f"by{k}")), F.col(by).eqNullSafe(F.col(f"by{k}")), "left").drop(f"by{k}")
    return per


def modelled_latency(log: DataFrame, round_trip_ms: float = 40.0, bits_per_second: float = 100e6) -> DataFrame:
    """Per question: the device's own time and that of its slowest source: round trip, work and transfer. Contacts go in parallel."""
    answer = F.map_entries(F.coalesce("contact_ms", F.create_map().cast("map<string,double>")))
    one = lambda e: F.lit(round_trip_ms) + e["value"] + F.coalesce(F.element_at("response", e["key"]), F.lit(0.0)) * 8000.0 / bits_per_second
    device = F.coalesce(F.element_at("stage_ms", F.lit("embed")), F.lit(0.0)) + F.coalesce(F.element_at("stage_ms", F.lit("routing")), F.lit(0.0))
    return log.select("query_id", (device + F.coalesce(F.array_max(F.transform(answer, one)), F.lit(0.0))).alias("latency"), F.size(answer).alias("contacts"))


def privacy_summary(log: DataFrame) -> DataFrame:
    """What left the device for each source: contacts, bytes sent and got, mean time, passages disclosed, probes, errors."""
    at = lambda m, zero: F.coalesce(F.element_at(m, F.col("node")), F.lit(zero))
    each = log.select("*", F.explode("contact_ms").alias("node", "ms")).select("node", "ms", at("request", 0.0).alias("asked"), at("response", 0.0).alias("got"), at("disclosed", 0).alias("disclosed"), at("probes", 0).alias("probes"), F.element_at("errors", F.col("node")).isNotNull().cast("long").alias("errors"))
    return each.groupBy("node").agg(F.count("*").alias("contacts"), F.avg("ms").alias("ms"), *(F.sum(c).alias(n) for c, n in (("asked", "request_bytes"), ("got", "response_bytes"), ("disclosed", "disclosed"), ("probes", "probes"), ("errors", "errors"))))
