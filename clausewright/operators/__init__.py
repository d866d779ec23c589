"""DataFrame-level operators: chunking, validation, indexing, search, fusion, checking, answers."""
