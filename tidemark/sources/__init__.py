"""Where the roles of the view pipeline come from."""
