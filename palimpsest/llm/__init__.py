"""Training-data operators: search, sharding, joins, decontamination, encoding, classifiers, packing."""
