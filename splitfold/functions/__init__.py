"""splitfold functions."""
