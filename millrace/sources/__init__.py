"""Files as DataFrames: listings, records, texts, office documents, and the catalog of sources."""
