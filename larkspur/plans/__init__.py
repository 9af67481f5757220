"""Query plans: grams, and the boolean gram plans of regular expressions."""
