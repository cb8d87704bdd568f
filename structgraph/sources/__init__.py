"""Where files and graphs come from and go to."""
