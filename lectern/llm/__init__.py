"""Training-data operators: tokens, packing, language, scoring, dedup, sharding, licences, decontamination."""
