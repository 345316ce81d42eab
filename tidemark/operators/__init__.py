"""Dataset operators: cleaning, imputation, encoding, metrics, policy, screening."""
