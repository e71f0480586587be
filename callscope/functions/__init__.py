"""Column functions on utterance text, gold tags and turn events."""
