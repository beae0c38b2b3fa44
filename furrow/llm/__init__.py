"""Operations of a training-data pipeline: deduplication, filters, privacy, sharding, packing, tokens."""
