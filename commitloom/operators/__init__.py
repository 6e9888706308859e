"""DataFrame -> DataFrame operators; lazy, and free of actions unless the docstring says so."""
