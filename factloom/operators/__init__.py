"""DataFrame operators: evidence, dedupe, joins, radar, scoring, pool, discovery, reports, quality."""
