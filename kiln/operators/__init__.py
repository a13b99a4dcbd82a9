"""DataFrame operators: profile, pii, standard, mapping, cleaning, quality, delivery."""
