"""Jobs to run over whole tables: each module has a command line, a config file beside it and a function that takes a session."""
