"""Where the domain tables come from and where reports go."""
