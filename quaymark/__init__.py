"""quaymark: market-signal analytics and corpus operators as Spark DataFrame plans."""
