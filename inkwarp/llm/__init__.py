"""inkwarp.llm: operators for training-data text."""
