"""palimpsest: sensitive-data discovery, entity resolution and pseudonymisation on Spark."""
