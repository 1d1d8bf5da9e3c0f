"""Customer-feedback analytics on Spark: enrichment, lineage, hourly features, spike forecast."""
