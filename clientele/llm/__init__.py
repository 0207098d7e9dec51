"""Training-data operators: decontamination, quality, near copies, shards, packing, secrets, fingerprints, URLs,
repeated passages and toxicity. Nothing else in the library imports this package."""
