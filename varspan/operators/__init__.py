"""DataFrame operators over alignments, signatures, depth and calls."""
