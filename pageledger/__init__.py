"""pageledger: corpora of paged technical documents as Spark tables."""
