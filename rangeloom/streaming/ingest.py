"""Dense tracks from streams of timed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bins(events: DataFrame, chrom: str, time: str, value: str, bin_seconds: int, late: str = "10 minutes", origin: str = "1970-01-01") -> DataFrame:
    """Bins (``chrom, bin, value``: mean, ``n``) of a stream, or of a batch, of events.

    A bin is final once the watermark, ``late`` behind the latest event, has
    passed its end; events that come later are left out.  State is a row for
    each open bin and chromosome.
    """
    known = events.where(F.col(time).isNotNull() & F.col(chrom).isNotNull()).withWatermark(time, late)
    span = F.window(time, f"{bin_seconds} seconds")
    made = known.groupBy(F.col(chrom).alias("chrom"), span.alias("w")).agg(F.avg(F.nanvl(F.col(value).cast("double"), F.lit(None))).alias("value"), F.count(value).alias("n"))
    at = (F.unix_timestamp("w.start") - F.unix_timestamp(F.lit(origin).cast("timestamp"))) / bin_seconds
    return made.select("chrom", F.floor(at).alias("bin"), "value", "n")


def write_track(bins: DataFrame, path: str, checkpoint: str):
    """Append final bins to a Parquet track; the checkpoint makes each written once."""
    return bins.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("chrom").trigger(availableNow=True).start()
