"""Windows over event time, in batch and in streams."""
