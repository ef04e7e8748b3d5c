"""spacegauge: audit, on Spark, how ready every analytics workspace is for natural-language querying."""
