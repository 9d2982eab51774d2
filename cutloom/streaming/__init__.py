"""Reading growing graph folders as streams."""
