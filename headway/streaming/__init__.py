"""The online job as a stream."""
