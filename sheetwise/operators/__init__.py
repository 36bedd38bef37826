"""DataFrame operators: ownership, review, rereads, evidence, keys, layout and summaries."""
