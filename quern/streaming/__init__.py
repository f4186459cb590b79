"""Time buckets over event streams, an extension: pipelines themselves run on tables."""
