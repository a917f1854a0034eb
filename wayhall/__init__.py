"""Building accessibility analytics on Spark: extraction, spatial matching, graph assembly, routing and export."""
