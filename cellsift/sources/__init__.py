"""Where counts come from and go to."""
