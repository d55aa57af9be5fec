"""Document stores: reading, addressing, writing."""
