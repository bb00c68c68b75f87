"""A relational query API over DataFrames: filters, paging, relationships, aggregates, time travel, vectors, writes."""
