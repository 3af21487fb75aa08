"""operators of folioquarry."""
