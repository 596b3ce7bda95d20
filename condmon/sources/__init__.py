"""Landing of raw files, identity checks, and keyed table writes."""
