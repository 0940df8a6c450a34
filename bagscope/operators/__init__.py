"""DataFrame-in, DataFrame-out operators over sequences, k-mers, clones, vectors and scores."""
