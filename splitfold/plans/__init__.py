"""splitfold plans."""
