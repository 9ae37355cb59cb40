"""What happens within one document, in plain Python: reading names and labels, resolving persons, propagation, surrogates."""
