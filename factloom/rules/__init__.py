"""Rule tables: keyword lists, patterns, tiers and weights that results depend on."""
