"""splitfold sources."""
