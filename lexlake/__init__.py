"""Analytics over dated, versioned records and document corpora, as Spark jobs."""
