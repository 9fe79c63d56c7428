"""Operations of a training-data pipeline: deduplication, scoring, tokenising and packing of documents."""
