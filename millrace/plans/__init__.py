"""The relational, window, text and event queries and their SQL."""
