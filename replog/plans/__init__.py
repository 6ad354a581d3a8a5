"""Plan shapes that the operators share: line-order state, pairing, islands, as-of and range joins."""
