"""Writers (K1-K9). All are distributed DataFrame writes; nothing is collected."""
