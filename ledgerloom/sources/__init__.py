"""Reading and writing; nothing else touches storage."""
