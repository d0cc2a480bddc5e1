"""Training-data operators: scoring, rules, archives, joins, tokens, packing."""
