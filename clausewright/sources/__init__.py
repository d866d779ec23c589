"""Source registry, raw-document readers and the fetch cache."""
