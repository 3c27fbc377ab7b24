"""Documents in, matches out."""

from pathloom.sources.readers import from_stdin, from_strings, read_documents
from pathloom.sources.writers import collect, discard, write_matches

__all__ = ["collect", "discard", "from_stdin", "from_strings", "read_documents", "write_matches"]
