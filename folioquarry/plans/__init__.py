"""plans of folioquarry."""
