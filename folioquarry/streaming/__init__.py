"""streaming of folioquarry."""
