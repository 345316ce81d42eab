"""The registered queries and, where SQL can say the same, their SQL."""
