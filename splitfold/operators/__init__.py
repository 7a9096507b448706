"""splitfold operators."""
