"""DataFrame operators on utterances, words, gold acts and unit tables."""
