"""Pure functions on the bytes of one document: what is not regular and so no SQL expression."""
