"""splitfold streaming."""
