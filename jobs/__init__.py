"""Jobs to be run from a command line, each with a configuration file beside it."""
