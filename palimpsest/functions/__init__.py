"""Column functions: hashes, codecs, times of day, phases."""
