"""Tables to read, make and write."""
