"""sources of folioquarry."""
