"""Empty on purpose: snapshots are built whole and published at once; no query works on a stream."""
