"""functions of folioquarry."""
