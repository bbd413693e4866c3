"""Named queries: importing this package registers those of both modules."""
