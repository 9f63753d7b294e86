"""DataFrame operators for labelled text tables: clean, split, featurise, fit, score, evaluate and monitor."""
