"""Column functions: normalisation, validators, risk, lookups."""
