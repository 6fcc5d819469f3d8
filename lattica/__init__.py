"""Set-enrichment, identifier and network analytics expressed as Spark plans."""
