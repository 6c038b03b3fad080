"""Training-data operators on whole document tables; nothing outside this subpackage imports it."""
