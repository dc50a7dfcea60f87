"""G35 as a stream over the events file."""

from massweave.operators import histogram as hg
from massweave.queries._base import query, table
from massweave.queries.stats import hist_sql
from massweave.streaming import hist_stream as hs


@query("g35_stream_hist", "WITH " + hist_sql("events", "event_type", "value") + " SELECT event_type, bin, count, under, over FROM h")
def g35_stream(spark, sf):
    batch = table(spark, sf, "events").select("event_type", "value")
    rng = hg.pilot_range(batch, ["event_type"], "value")
    stream = (spark.readStream.schema(table(spark, sf, "events").schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
              .select("event_type", "value"))
    state = hs.fold_available(hs.stream_hist(stream, ["event_type"], "value", rng), ["event_type"])
    return state.select("event_type", "bin", "count", "under", "over")
